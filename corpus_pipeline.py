"""The corpus pipeline: five stages from raw documents to token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
``run`` applies them to the ``documents`` table.

Rows with null texts have no language and go at the first stage.  A stage
decides on the rows it is given; repeated rows are decided alike, except that
near-duplicate removal keeps one row of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.llm import bpe, decontaminate, langid, ngram_join, pii
from tierline.llm.common import numbered, staged, table
from tierline.llm.queries import PATTERN, RANKS

#: A document whose best language has less than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the labelled rows; rejects texts without a
    letter, those whose best language has less than LEAST_SCORE, and those that
    no language explains.  Stays: every column as it was."""
    model = langid.fit(docs)
    found = staged(langid.explain(docs, model, out="__fit"), "language")
    least = langid.limits(found, "__fit")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & langid.explained(least, "__fit"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 one
    row stays: that with the smallest document id, and of several such rows the
    first.  Rows with repeated ids or none take part as any other; a null id
    comes after all others.  Texts without words are linked with nothing."""
    rows = numbered(docs, "__row")
    groups = (ngram_join.join(rows, id_col="__row", n=5, num=80, den=100)
              .select(F.col("doc_id").alias("__row"), "component_id"))
    first = (rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("first"))
             .select("first.__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the error budget, go;
    items without an id count as any other."""
    marked = decontaminate.match(docs, table(spark, sf_dir, "benchmark"), out="__matches", null_ids=True)
    return marked.where(F.size("__matches") == 0).drop("__matches")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal-data span becomes its kind in angle brackets; n_chars
    follows the new text."""
    return (pii.redact(docs, pii.fit(docs))
            .withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, decoded again as a check: doc_id, lang, source,
    n_tokens, ids_sha256, and whether decoding gives back the text."""
    return bpe.round_trip(docs, RANKS, PATTERN).select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("byte_bpe", token_ids),
]

#: Byte-pair merges, the trained language model and the trained field have no
#: SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
