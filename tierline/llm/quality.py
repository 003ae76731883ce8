"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed character n-grams (2 to 4, case kept) and of
n-grams over two "same as before" sequences (words against the word before,
lines against the lines before).  Each indicator is scaled by its class
log-count ratio; a linear hinge-loss model on the scaled rows, brought to unit
length, is fitted by dual coordinate descent; a logistic curve fitted on rows
kept out of the descent turns margins into scores.

``fit`` learns from at most ``max_rows`` labelled rows (default
``MAX_ROWS``), those with the smallest hash of the document id; every text is
scored, whole.

Defined results: a null text is the empty text; an empty text has the model's
score for no features.  Labels other than 0 and 1, and null labels, are left
out; several labels of one document all count.  With labels of one class only
the score is that class's share, without labels 0.5.  Other columns pass
through; ``score`` and ``predicted`` replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.chargrams import grams
from tierline.llm.common import bounded_batches, word_hashes

MAX_ROWS = 6000
ORDERS = (2, 3, 4)
BUCKETS = 1 << 17
#: Indicators after the n-gram buckets: runs of equal words and lines.
RUNS = (2, 3, 6)
SIZE = BUCKETS + 2 * len(RUNS)
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
_PART_FOR_CURVE = 5


@dataclass
class Model:
    #: weight x ratio, and ratio squared, per feature
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float


def _repeats(values: np.ndarray) -> int:
    """Length of the longest run of equal neighbours."""
    if len(values) == 0:
        return 0
    cut = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return int(np.diff(cut).max())


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted indicators of a text.  ``seen``: a reusable array of SIZE False."""
    for g in grams(text, ORDERS, BUCKETS):
        seen[g] = True
    raw = text.encode("utf-8", "surrogatepass")
    words = _repeats(word_hashes(raw))
    lines = raw.split(b"\n")
    _, counts = np.unique(np.array([hash(x) for x in lines if x.strip()], np.int64), return_counts=True)
    same = int(counts.max()) if len(counts) else 0
    for k, run in enumerate(RUNS):
        seen[BUCKETS + k] = words >= run
        seen[BUCKETS + len(RUNS) + k] = same >= run
    out = np.flatnonzero(seen)
    seen[out] = False
    return out.astype(np.int32)


def descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on unit rows of scaled
    indicators plus a constant; costs weigh both classes alike."""
    x = []
    for idx in rows:
        v = ratio[idx]
        norm = np.sqrt(v @ v)
        x.append(v / norm if norm > 0 else v)
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            idx, v = rows[i], x[i]
            gradient = y[i] * (w[idx] @ v + b) - 1.0
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps."""
    hit, miss = (label > 0).sum(), (label <= 0).sum()
    target = np.where(label > 0, (hit + 1) / (hit + 2), 1 / (miss + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0]))
        at = at - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn from ``labels`` (id, 0/1) joined with the texts of ``docs``."""
    chosen = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
              .orderBy(F.xxhash64("k"), "k", "y").limit(max_rows))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SIZE, bool)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "y": b["y"], "f": [features(t, seen).tobytes() for t in b["t"]]})

    texts = bounded_batches(docs).select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # the sample has at most max_rows rows of two numbers
    got = (texts.join(F.broadcast(chosen), "k").mapInPandas(extract, "k long, y int, f binary").toPandas()
           .sort_values(["k", "y", "f"], ignore_index=True))
    rows = [np.frombuffer(f, np.int32) for f in got["f"]]
    y = got["y"].to_numpy(int) * 2 - 1
    nothing = np.zeros(SIZE)
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(nothing, nothing, 0.0, 1.0, float(np.log(share / (1 - share))))
    kept = np.arange(len(y)) % _PART_FOR_CURVE == 0
    if len(set(y[~kept].tolist())) < 2 or len(set(y[kept].tolist())) < 2:
        kept[:] = False
    use = np.flatnonzero(~kept)
    count = {}
    for side in (1, -1):
        own = [rows[i] for i in use if y[i] == side]
        n = np.bincount(np.concatenate(own), minlength=SIZE) + SMOOTHING
        count[side] = n / n.sum()
    ratio = np.log(count[1] / count[-1])
    w, b = descent([rows[i] for i in use], y[use], ratio)
    model = Model((w * ratio).astype(np.float64), ratio ** 2, b, 1.0, 0.0)
    curve = np.flatnonzero(kept) if kept.any() else use
    model.slope, model.offset = _curve(np.array([_margin(rows[i], model) for i in curve]), y[curve])
    return model


def _margin(idx: np.ndarray, model: Model) -> float:
    norm = np.sqrt(model.square[idx].sum())
    return float(model.weight[idx].sum() / norm + model.bias if norm > 0 else model.bias)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, seen = shared.value, np.zeros(SIZE, bool)
        for texts in batches:
            margins = np.array([_margin(features(t, seen), m) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(m.slope * margins + m.offset, -30, 30))))

    return (bounded_batches(df).withColumn("score", scored(F.coalesce(F.col(text_col), F.lit(""))))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
