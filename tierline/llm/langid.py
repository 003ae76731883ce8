"""Language ID: multinomial naive Bayes over hashed character n-grams.

``fit`` counts the n-grams (1 to 3 characters of the lower-cased text, hashed
to ``BUCKETS``) of every labelled row per language: each task adds up its own
languages x buckets table, Spark sums the tables.  The log-probability matrix
(languages x buckets, a size that does not follow the data) is broadcast;
``predict`` scores batches of texts by sparse gathers and segment sums.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when no labelled row exists.  Texts of any length are read
whole, in pieces that overlap by two characters.  Ties go to the language that
sorts first.  Null labels are not learned from.  Other columns pass through;
the two result columns replace columns of the same names.

The score compares the learned languages with each other and runs to 1 for any
text of some length.  ``explain`` measures beside it how well the chosen
language fits at all: the mean log-probability of the n-grams of the text's
letters, without what the model learned from the row itself.  ``limits`` takes
each language's usual value from all its labelled rows; a text is ``explained``
that comes nearer to it than to chance (every bucket alike), less the error
that a mean over few n-grams has.  A text without letters outside of words
with digits gives no value and counts as explained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm import chargrams
from tierline.llm.common import bounded_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Added to every count.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Standard errors by which a text's mean may be off.
ERRORS = 3
#: Runs of a-z and digits with a digit, and what is neither letter nor mark.
_CODES, _GAPS = "[a-z0-9]*[0-9][a-z0-9]*", r"[^\p{L}\p{M}]+"


@dataclass
class Model:
    langs: list[str]
    #: languages x buckets
    logp: np.ndarray
    prior: np.ndarray
    #: languages x buckets, as counted
    counts: np.ndarray


def grams(text: str) -> Iterator[np.ndarray]:
    return chargrams.grams(text, ORDERS, BUCKETS)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from every row whose label and text are not null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for text, label in zip(b["t"], b["l"], strict=True):
                if label not in seen:
                    seen[label], docs[label] = np.zeros(BUCKETS, np.int64), 0
                docs[label] += 1
                for g in grams(text):
                    seen[label] += np.bincount(g, minlength=BUCKETS)
        for label, n in seen.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"l": label, "b": np.append(at, -1).astype(np.int32), "n": np.append(n[at], docs[label])})

    rows = (bounded_batches(labelled).select(F.lower(F.col(text_col)).alias("t"), F.col(label_col).cast("string").alias("l"))
            .where(F.col("t").isNotNull() & F.col("l").isNotNull())
            .mapInPandas(count, "l string, b int, n long")
            .groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows["l"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    docs = np.zeros(len(langs))
    row = rows["l"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    b, n = rows["b"].to_numpy(int), rows["n"].to_numpy(float)
    counts[row[b >= 0], b[b >= 0]] = n[b >= 0]
    docs[row[b < 0]] = n[b < 0]
    smooth = counts + SMOOTHING
    return Model(langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32),
                 np.log(docs / docs.sum()) if len(langs) else docs, counts)


def _score(texts, model: Model) -> pd.DataFrame:
    """Posterior of the best language of each text: one gather and one
    segment sum per language over the sparse n-gram list of the batch."""
    total = np.tile(model.prior, (len(texts), 1))
    rows, held, size = [], [], 0

    def flush():
        nonlocal rows, held, size
        if held:
            flat = np.concatenate(held)
            starts = np.cumsum([0] + [len(g) for g in held[:-1]])
            for k in range(len(model.langs)):
                np.add.at(total[:, k], rows, np.add.reduceat(model.logp[k].take(flat), starts, dtype=np.float64))
        rows, held, size = [], [], 0

    for i, text in enumerate(texts):
        for g in grams(text) if text else ():
            rows.append(i)
            held.append(g)
            size += len(g)
            if size > 2_000_000:
                flush()
    flush()
    best = total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return pd.DataFrame({"lang_pred": [model.langs[k] for k in best], "score": 1.0 / p.sum(axis=1)})


def _count(text: str) -> np.ndarray:
    seen = np.zeros(BUCKETS, np.int64)
    for g in grams(text):
        seen += np.bincount(g, minlength=BUCKETS)
    return seen


def _fit(texts, letters, labels, langs, model: Model, totals: np.ndarray) -> pd.DataFrame:
    at = {x: k for k, x in enumerate(model.langs)}
    rows = []
    for text, part, label, lang in zip(texts, letters, labels, langs, strict=True):
        own = label == lang
        times = _count(part) if text else np.zeros(0, np.int64)
        b = np.flatnonzero(times)
        if not len(b):
            rows.append((0, None, None, own))
            continue
        held, total, times = model.counts[at[lang]][b], totals[at[lang]], times[b]
        if own:
            mine = _count(text)
            held, total = held - mine[b], total - mine.sum()
        logp = np.log((held + SMOOTHING) / (total + SMOOTHING * BUCKETS))
        n = times.sum()
        mean = times @ logp / n
        rows.append((n, mean, times @ (logp - mean) ** 2 / n, own))
    return pd.DataFrame(rows, columns=["n", "mean", "variance", "own"])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (posterior, 0 to 1)."""
    if not model.langs:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _score(texts, shared.value)

    return _predicted(df, text_col, scored).drop("__p")


def _predicted(df: DataFrame, text_col: str, scored) -> DataFrame:
    text = F.col(text_col)
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = bounded_batches(df).withColumn("__p", scored(F.when(known, F.lower(text)).otherwise(F.lit(""))))
    return found.withColumns({
        "lang_pred": F.when(known, F.col("__p.lang_pred")).otherwise(F.lit(UNKNOWN)),
        "score": F.when(known, F.col("__p.score")).otherwise(F.lit(0.0))})


def explain(df: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang", out: str = "fit") -> DataFrame:
    """``predict``, and ``out``: number of n-grams of letters, mean and variance
    of their log-probability in ``lang_pred``, and whether the model learned
    from the row under that language.  Labelled rows are taken for rows that
    the model learned from.  One Python worker a task does both."""
    kind = "n: bigint, mean: double, variance: double, own: boolean"
    if not model.langs:
        return predict(df, model, text_col).withColumn(out, F.lit(None).cast(f"struct<{kind}>"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"struct<lang_pred: string, score: double, {kind}>")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        totals = model.counts.sum(axis=1)
        for texts, letters, labels in batches:
            best = _score(texts, model)
            yield pd.concat([best, _fit(texts, letters, labels, best["lang_pred"], model, totals)], axis=1)

    def called(text: Column) -> Column:
        letters = F.trim(F.regexp_replace(F.regexp_replace(text, _CODES, " "), _GAPS, " "))
        return scored(text, letters, F.col(label_col).cast("string"))

    return (_predicted(df, text_col, called)
            .withColumn(out, F.struct(*[F.col(f"__p.{x.split(':')[0]}") for x in kind.split(", ")])).drop("__p"))


def limits(found: DataFrame, fit: str = "fit") -> dict[str, tuple[float, float]]:
    """Least mean and usual variance of each language, from the rows of
    ``explain`` that the model learned from."""
    rows = (found.where(F.col(f"{fit}.own") & (F.col(f"{fit}.n") > 0)).groupBy("lang_pred")
            .agg(F.percentile_approx(f"{fit}.mean", 0.5).alias("mean"), F.percentile_approx(f"{fit}.variance", 0.5).alias("variance"))
            .collect())                                   # one row a language
    chance = -float(np.log(BUCKETS))
    return {r["lang_pred"]: (min(r["mean"], (r["mean"] + chance) / 2), r["variance"]) for r in rows}


def explained(least: dict[str, tuple[float, float]], fit: str = "fit") -> Column:
    """Whether ``lang_pred`` explains the text of a row of ``explain``."""
    if not least:
        return F.lit(True)
    low, variance = (F.try_element_at(F.create_map(*[F.lit(x) for lang, pair in least.items() for x in (lang, float(pair[i]))]), F.col("lang_pred"))
                     for i in (0, 1))
    return F.coalesce(F.col(f"{fit}.mean") >= low - ERRORS * F.sqrt(variance / F.col(f"{fit}.n")), F.lit(True))
