"""Helpers shared by the operators: table reads, staged tables, text batches
and word hashes.

Python parts work on Arrow batches inside tasks.  Texts reach them as UTF-8
bytes; a batch is cut into slices of a few MB, and one very long text is cut
at white space, so memory does not follow the longest document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.session import scratch_dir

#: Largest slice of text that a task works on at once.
SLICE_BYTES = 4 << 20
_WORD_CACHE_MAX = 100_000
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it again.  Cuts lineage:
    a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffle_cleanup(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, col: str) -> DataFrame:
    """``df`` with a number of its own for every row in ``col``.  It follows
    from the row's file and its place there, so every reading and every retry
    gives the same; what is not files as read is written first."""
    if not df._jdf.queryExecution().analyzed().children().isEmpty() or not df.inputFiles():
        df = staged(df, "numbered")
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = sorted(r[0] for r in rows.select("__file").distinct().collect())          # names only
    starts = df.sparkSession.createDataFrame([(f, n << 40) for n, f in enumerate(files)], "__file string, __start long")
    return (rows.join(F.broadcast(starts), "__file").withColumn(col, F.col("__start") + F.col("__at"))
            .select(*df.columns, col))


class shuffle_cleanup:
    """Drop the shuffle files of the jobs inside as soon as each job ends, so
    that disk holds one step's shuffle and not the sum over all steps."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY, "false")
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *exc):
        self.spark.conf.set(self.KEY, self.before)


#: Largest Arrow batch that a task hands to Python, in bytes.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keep the session's Arrow batches small: a batch exists several times at
    once (JVM, Arrow, pandas), in every task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col, n: int):
    """crc32 of the value as text, mod ``n`` (null: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``limit`` (or one row)."""
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE_MAX:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


_words = _Words()


def pieces(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """``text`` cut at ASCII white space into pieces of about ``limit`` bytes."""
    at = 0
    while len(text) - at > limit:
        m = _SPACE.search(text, at + limit)
        if not m:
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:] if at else text


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text.
    ``bytes.split`` cuts at exactly these characters."""
    get = _words.__getitem__
    parts = []
    for piece in pieces(text):
        w = piece.split()
        parts.append(np.fromiter(map(get, w), np.uint64, len(w)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (doubling: a window
    of 2w is two windows of w)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done = None, 0
    level, w = words, 1
    rest = width
    while rest:
        if rest & 1:
            part = level[done:done + n] * _power(done) if done else level[:n].copy()
            out = part if out is None else out + part
            done += w
        rest >>= 1
        if rest:
            level = level[:len(level) - w] + level[w:] * _power(w)
            w *= 2
    return mix(out)


def ordinals(lengths: np.ndarray) -> np.ndarray:
    """Row number of each element when rows of ``lengths`` are laid end to end."""
    return np.repeat(np.arange(len(lengths)), lengths)
