"""Token counts by a separator scan over flat token files.

A flat token file is a run of unsigned little-endian ids; an end-of-document
id ends each document, and nothing else tells documents apart.  ``scan`` reads
the files in blocks of ``BLOCK_TOKENS`` ids, each a task's small piece of work,
and searches a block for the separator in one vectorised comparison.  Two
passes stitch documents over block boundaries: the first gives each block's
separators and last separator; a prefix scan over these summaries (running
count, running last position; in two levels, so that one huge file is not one
task's window) gives each block what stands before it; the second pass emits
each document at the block that ends it.

Files are read and written through pyarrow's filesystems, so folders may be
local (shared), HDFS or object stores.  ``write_tokens`` makes such files from
texts: one file per task, named by the attempt, so that a repeated attempt
never touches another's file; only files of finished attempts are listed.

Defined results: an empty file holds no document; two separators in a row hold
an empty document; ids after the last separator are a document that is not
closed.  A null or empty text is a document of no tokens.  Repeated and null
document ids are rows like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import bounded_batches, shuffle_partitions, staged

BLOCK_TOKENS = 1 << 21
#: Blocks scanned together before the scan over their totals.
_CHUNK = 1024


def write_tokens(docs: DataFrame, folder: str, make: Callable[[], Callable[[str], list[int]]], separator: int,
                 dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every whole text as ids and a separator below ``folder``.
    Returns (file, ordinal, doc_id): which document stands where.  ``make``
    builds the tokenizer in the task."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        encode, at, out = make(), 0, None
        try:
            for b in batches:
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                for text in b["t"]:
                    out.write(np.array([*encode(text), separator], dtype).tobytes())
                yield pd.DataFrame({"file": f"{folder}/{name}", "ordinal": np.arange(at, at + len(b)), "doc_id": b["i"]})
                at += len(b)
        finally:
            if out is not None:
                out.close()

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # written out, so that the listing names the files of the attempts that counted
    return staged(rows.mapInPandas(write, "file string, ordinal long, doc_id long"), "token-files")


def _read(file: str, block: int, dtype: np.dtype, block_tokens: int) -> tuple[np.ndarray, int, bool]:
    """A block's ids, the position of its first id, and whether it is the last."""
    fs, path = pyarrow.fs.FileSystem.from_uri(file)
    size = fs.get_file_info(path).size // dtype.itemsize
    first = block * block_tokens
    with fs.open_input_file(path) as f:
        raw = f.read_at(min(block_tokens, size - first) * dtype.itemsize, first * dtype.itemsize)
    return np.frombuffer(raw, dtype), first, first + block_tokens >= size


def scan(files: DataFrame, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of the token files named in column ``file``: file, ordinal,
    start (position of its first id), n_tokens, closed."""
    spark, kind = files.sparkSession, np.dtype(dtype)
    tasks = 2 * shuffle_partitions(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                fs, path = pyarrow.fs.FileSystem.from_uri(file)
                n = -(-(fs.get_file_info(path).size // kind.itemsize) // block_tokens)
                yield pd.DataFrame({"file": file, "block": np.arange(n)})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, block in zip(b["file"], b["block"], strict=True):
                ids, first, _ = _read(file, block, kind, block_tokens)
                at = np.flatnonzero(ids == separator)
                yield pd.DataFrame({"file": [file], "block": [block], "n": [len(at)],
                                    "last": [first + at[-1] if len(at) else -1]})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, block, n, last in zip(b["file"], b["block"], b["n"], b["last"], strict=True):
                ids, first, final = _read(file, block, kind, block_tokens)
                ends = first + np.flatnonzero(ids == separator)
                starts = np.concatenate(([last], ends)) + 1
                stop = first + len(ids)
                if final and starts[-1] < stop:
                    ends = np.append(ends, stop)
                starts = starts[:len(ends)]
                yield pd.DataFrame({"file": file, "ordinal": n + np.arange(len(ends)), "start": starts,
                                    "n_tokens": ends - starts, "closed": ends < stop})

    blocks = files.select("file").distinct().mapInPandas(cut, "file string, block long")
    found = staged(blocks.repartition(tasks, "file", "block")
                   .mapInPandas(look, "file string, block long, n long, last long"), "token-blocks")
    found = found.withColumn("chunk", F.floor(F.col("block") / _CHUNK))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (found.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
              .select("file", "chunk", F.sum("n").over(over).alias("chunk_n"), F.max("last").over(over).alias("chunk_last")))
    before = (found.withColumns({"in_n": F.sum("n").over(inside), "in_last": F.max("last").over(inside)})
              .join(chunks.hint("merge"), ["file", "chunk"])
              .select("file", "block", (F.coalesce("in_n", F.lit(0)) + F.coalesce("chunk_n", F.lit(0))).alias("n"),
                      F.greatest(F.coalesce("in_last", F.lit(-1)), F.coalesce("chunk_last", F.lit(-1))).alias("last")))
    return (before.repartition(tasks, "file", "block")
            .mapInPandas(emit, "file string, ordinal long, start long, n_tokens long, closed boolean"))


def token_counts(docs: DataFrame, folder: str, make: Callable[[], Callable[[str], list[int]]], separator: int,
                 dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every text, counted in the files written for it."""
    listed = write_tokens(docs, folder, make, separator, dtype, id_col, text_col)
    # the listing packs small on disk and is one row a document in memory
    return (scan(listed, separator, dtype).join(listed.hint("merge"), ["file", "ordinal"])
            .select("doc_id", "n_tokens"))
