"""Landing into the bronze envelope.

The envelope is the fixed six-column bronze shape shared by every ingest
kind: ``id, tenant_id, ingested_at, source, payload (JSON), metadata (JSON)``.
Landing is one projection per batch -- no per-record statements -- and ids are
derived deterministically from (batch, source, position) so that a retried task
writes the same ids.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions.jsonx import TO_JSON_OPTS, is_json, json_elements
from tierline.functions.text import source_table_name, tenant_slug
from tierline.session import bounded_batches, cut_lineage, staged
from tierline.sources.blocks import BLOCK, split_starts
from tierline.sources.files import file_row_number

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("ingested_at", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("payload", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
])
ENVELOPE_COLUMNS = [f.name for f in ENVELOPE_SCHEMA.fields]
#: What a table name has no room for: all but letters and digits of any script.
NOT_WORD = r"[\W_]"
#: Characters of all files' headers that are sent to every task.
BROADCAST_HEADERS = 64 << 20
#: Bytes from which on a line is not read as one value without need.
LONG_LINE = 64 << 20


def bronze_table_name(source: str, tenant_id: str) -> str:
    """S11 ``bronze_{slug}.{safe source}`` for one name on the driver."""
    return f"bronze_{re.sub('[^a-z0-9]', '_', tenant_id.lower())}.{re.sub(NOT_WORD, '_', source.lower())}"


def record_id(batch_id, source, position, ordinal: Column | None = None) -> Column:
    """H5: stable id from (batch, source, position); survives task retry.

    The first half is the record's ordinal in the batch, the second a hash of
    the position, so ids of one batch sort in landing order and the last of
    two records with one key is the one that landed last.
    """
    order = F.lpad(F.lower(F.hex((position if ordinal is None else ordinal).cast("long"))), 16, "0")
    return F.concat(order, F.sha2(F.concat_ws("|", F.lit(str(batch_id)), F.lit(source),
                                              position.cast("string")), 256).substr(1, 16))


def _meta_col(metadata) -> Column:
    if metadata is None:
        return F.lit("{}")
    if isinstance(metadata, dict):
        return F.lit(json.dumps(metadata, separators=(",", ":")))
    return F.to_json(metadata, TO_JSON_OPTS) if not isinstance(metadata, str) else F.col(metadata)


def envelope(df: DataFrame, source: str, tenant_id: str, batch_id: str,
             ingested_at: str, metadata=None, position: str | Column | None = None,
             payload: Column | None = None) -> DataFrame:
    """S1 one bronze row per input row.

    ``payload`` defaults to the whole row as JSON (nulls kept, microsecond
    timestamps), minus the ``position`` column when that is given by name.  ``position`` is a per-batch unique ordinal used for the id;
    without one, ``monotonically_increasing_id`` (deterministic for a fixed
    input split) is used.  Narrow: no shuffle.
    """
    pos = (F.col(position) if isinstance(position, str) else position) \
        if position is not None else F.monotonically_increasing_id()
    data_cols = [c for c in df.columns if not (isinstance(position, str) and c == position)]
    body = payload if payload is not None else F.to_json(F.struct(*[F.col(c) for c in data_cols]),
                                                         TO_JSON_OPTS)
    return df.select(
        record_id(batch_id, source, pos).alias("id"),
        F.lit(tenant_id).alias("tenant_id"),
        F.lit(ingested_at).alias("ingested_at"),
        F.lit(source).alias("source"),
        body.alias("payload"),
        _meta_col(metadata).alias("metadata"),
    )


@dataclass
class Landing:
    """Result of a landing: accepted envelope rows, rejected raw rows, and a
    one-row run record (S12)."""
    bronze: DataFrame
    rejects: DataFrame
    run: DataFrame


def landing_run(bronze: DataFrame, rejects: DataFrame, run_id: str,
                started_at: str, target_table: str) -> DataFrame:
    """S12 one run row: records_in / out / rejected and status
    (success when nothing was rejected, partial when some landed, else failed).
    One aggregation over both sides; nothing is collected."""
    flags = (bronze.select(F.lit(1).alias("ok"))
             .unionByName(rejects.select(F.lit(0).alias("ok"))))
    agg = flags.agg(F.count(F.lit(1)).alias("records_in"),
                    F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("records_out"))
    return agg.select(
        F.lit(run_id).alias("id"),
        F.lit(started_at).alias("started_at"),
        F.lit(target_table).alias("target_table"),
        F.col("records_in"),
        F.col("records_out"),
        (F.col("records_in") - F.col("records_out")).alias("records_rejected"),
        F.when(F.col("records_in") == F.col("records_out"), "success")
         .when(F.col("records_out") > 0, "partial").otherwise("failed").alias("status"),
    )


def _ends_open(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell when it starts ``inside`` one.
    A quote opens a cell where the cell starts, closes it unless another one
    follows, and is an ordinary character anywhere else."""
    if b'"' not in line:
        return inside
    pieces = line.split(b'"')                                        # what stands before each quote, and the rest
    now, closed = inside, False
    if not inside:
        pieces[0] = b"," + pieces[0]
    for piece in pieces[:-1]:
        now, closed = not now and (piece.endswith(b",") if piece else closed), now
    return now


def _by_split(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """(file, start of the split) and rows of it, in order, at most ``rows``
    at once.  The rows of a split follow each other in one task."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            file, at = part.column("_file"), part.column("_blk").to_numpy()
            names = file.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), part.num_rows]
            for a, b in itertools.pairwise(cuts):
                yield (file[a].as_py(), int(at[a])), part.slice(a, b - a)


def _csv_splits(lines: DataFrame, rows: int) -> DataFrame:
    """A row per split: for both states it can start in, the state it ends in
    (_o, _i) and the records that start in it (_n_o, _n_i)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_pylist([{"_file": key[0], "_blk": key[1], "_o": state[0], "_i": state[1], "_n_o": n[0], "_n_i": n[1]}], schema)

        key, state, n = None, [False, True], [0, 0]
        for own, part in _by_split(batches, rows):
            if own != key:
                if key is not None:
                    yield row()
                key, state, n = own, [False, True], [0, 0]
            for line in part.column("value").to_pylist():
                blank = line in (b"", b"\r")
                if state[0] == state[1]:
                    if not state[0] and not blank:
                        n = [n[0] + 1, n[1] + 1]
                    if b'"' in line:
                        state = [_ends_open(line, state[0])] * 2
                    continue
                if not blank:                       # one of the two is outside
                    n[state.index(False)] += 1
                if b'"' in line:
                    state = [_ends_open(line, state[0]), _ends_open(line, state[1])]
        if key is not None:
            yield row()

    schema = pa.schema([("_file", pa.string()), ("_blk", pa.int64()), ("_o", pa.bool_()), ("_i", pa.bool_()), ("_n_o", pa.int64()), ("_n_i", pa.int64())])
    return lines.mapInArrow(scan, "_file string, _blk long, _o boolean, _i boolean, _n_o long, _n_i long")


def _csv_records(lines: DataFrame, starts: DataFrame, rows: int) -> DataFrame:
    """_file, _row (from 0, the header) and _text of every record that is not
    empty; ``starts`` has a row per split.  Records inside a split are put
    together there and staged, the few over split ends by a grouping."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, at, own = None, False, -1, []   # own: lines of the record at hand
        whole = True                                 # it starts in this split
        for now, part in _by_split(batches, rows):
            out: list[tuple[int, bytes, bool]] = []
            if now != key:
                if inside:
                    yield batch(key, [(at, b"\n".join(own), False)])
                key, own, whole = now, [], False
                inside, at = part.column("_inside")[0].as_py(), part.column("_before")[0].as_py() - 1
            for line in part.column("value").to_pylist():
                if inside:
                    own.append(line)
                    if b'"' in line and not _ends_open(line, True):
                        inside = False
                        out.append((at, b"\n".join(own), whole))
                elif line not in (b"", b"\r"):
                    at += 1
                    if b'"' in line and _ends_open(line, False):
                        inside, own, whole = True, [line], True
                    else:
                        out.append((at, line, True))
            if out:
                yield batch(key, out)
        if inside and own:
            yield batch(key, [(at, b"\n".join(own), False)])

    def batch(key, out):
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.string()), pa.array([key[1]] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                                           pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.bool_())], ["_file", "_blk", "_row", "_text", "_whole"])

    at = starts.select(F.col("_file").alias("_sf"), F.col("_blk").alias("_sb"), "_inside", "_before")
    placed = lines.join(F.broadcast(at), (F.col("_file") == F.col("_sf")) & (F.col("_blk") == F.col("_sb"))).drop("_sf", "_sb")
    found = placed.mapInArrow(scan, "_file string, _blk long, _row long, _text binary, _whole boolean")
    found = staged(found.withColumn("_text", F.col("_text").cast("string")), "csv-records")
    over = (found.filter(~F.col("_whole")).groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("_blk", "_text"))).alias("_parts"))
            .select("_file", "_row", F.array_join(F.transform("_parts", lambda x: x["_text"]), "\n").alias("_text")))
    return found.filter("_whole").select("_file", "_row", "_text").unionByName(over).withColumn("_text", F.regexp_replace("_text", "\r$", ""))


def land_csv(spark: SparkSession, path: str, source: str, tenant_id: str,
             batch_id: str, ingested_at: str) -> Landing:
    """S2 CSV landing: header row, every value stays text, payload = row as a
    JSON object, metadata ``{"format":"csv","row_number":i}`` with i 0-based
    per file.

    Files are read in splits, also where quoted cells hold newlines (in the
    header too): a scan over the quotes finds the state that each split starts
    in, a second one the records.  They are parsed once and staged.  One scan serves
    files whose headers differ; each file's first record names its cells
    (of equal names the last counts).  Short rows land with '' in the cells
    they lack, as empty cells do.  Rows with a value beyond the header go to
    ``rejects``.  Quotes inside quotes are doubled; a quote that is never
    closed makes the rest of its file one record.
    """
    target = bronze_table_name(source, tenant_id)
    bounded_batches(spark)
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk")))
    starts = split_starts(_csv_splits(lines, BLOCK))
    records = _csv_records(lines, starts, BLOCK)
    header = records.filter("_row = 0").select(F.col("_file").alias("_of"), F.col("_text").alias("_header"))
    # commas of a header record: at least as many as it has cells
    most, size = header.agg(F.max(F.length("_header") - F.length(F.translate("_header", ",", ""))), F.sum(F.length("_header") + F.length("_of"))).first()
    if most is None:
        empty = spark.createDataFrame([], ENVELOPE_SCHEMA)
        rej = spark.createDataFrame([], "file string, row_number long, raw string")
        return Landing(empty, rej, landing_run(empty, rej, batch_id, ingested_at, target))
    names = [f"_c{i}" for i in range(most + 2)]
    schema = ", ".join(f"{c} string" for c in names)
    options = {"escape": '"', "mode": "PERMISSIVE", "maxColumns": str(max(20480, 2 * len(names)))}

    def cells(c: str) -> Column:
        parsed = F.from_csv(F.col(c), schema, options)
        return F.array(*[parsed[x] for x in names])

    full = F.transform(F.col("_cells"), lambda x: F.coalesce(x, F.lit("")))
    width = F.array_max(F.transform("_cells", lambda x, i: F.when(x.isNotNull(), i + 1)))
    header = (header.withColumn("_cells", cells("_header")).select("_of", F.slice(full, 1, F.coalesce(width, F.lit(1))).alias("_names"))
              .withColumn("_keep", F.filter(F.sequence(F.lit(0), F.size("_names") - 1), lambda i: ~F.array_contains(
                  F.slice("_names", i + 2, F.size("_names")), F.get("_names", i)))))
    # a frame of one row per file
    rows = (records.filter("_row > 0").withColumn("_row_number", F.col("_row") - 1)
            .join(F.broadcast(header) if size <= BROADCAST_HEADERS else header, F.col("_file") == F.col("_of"))
            .withColumn("_cells", cells("_text"))
            .withColumn("_bad", F.exists(F.slice("_cells", F.size("_names") + 1, len(names)), lambda x: x.isNotNull())))
    payload = F.to_json(F.map_from_arrays(
        F.transform("_keep", lambda i: F.get("_names", i)),
        F.transform("_keep", lambda i: F.coalesce(F.get("_cells", i), F.lit("")))))
    rows = staged(rows.select("_file", "_row_number", "_bad", F.when(~F.col("_bad"), payload).alias("payload"), F.when(F.col("_bad"), F.col("_text")).alias("raw")), "csv-rows")
    meta = F.to_json(F.struct(F.lit("csv").alias("format"), F.col("_row_number").alias("row_number")))
    bronze = rows.filter(~F.col("_bad")).select(
        record_id(batch_id, source, F.concat_ws("#", F.col("_file"), F.col("_row_number")), F.col("_row_number")).alias("id"),
        F.lit(tenant_id).alias("tenant_id"), F.lit(ingested_at).alias("ingested_at"),
        F.lit(source).alias("source"), "payload", meta.alias("metadata"))
    rejects = rows.filter("_bad").select(F.col("_file").alias("file"), F.col("_row_number").alias("row_number"), "raw")
    return Landing(bronze, rejects, landing_run(bronze, rejects, batch_id, ingested_at, target))


#: What a character does to the depth, by its code.
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_ESCAPED = re.compile(rb"\\.", re.S)
#: No depth: more than any.
_NO_DEPTH = 1 << 60


class _Pieces:
    """Pieces between commas: their text with the commas again, where each
    starts and ends in it, and what their quotes and brackets do."""

    def __init__(self, values: pa.Array):
        self.text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b",")[0].as_py()
        length = pc.binary_length(values).to_numpy().astype(np.int64)
        self.ends = np.cumsum(length + 1) - 1
        self.starts = self.ends - length
        codes = np.frombuffer(_ESCAPED.sub(b"__", self.text) if b"\\" in self.text else self.text, np.uint8)
        self.quotes = np.flatnonzero(codes == ord('"'))
        self.brackets = np.flatnonzero(_STEP[codes])
        self.steps = _STEP[codes[self.brackets]]
        self.odd = np.searchsorted(self.quotes, self.brackets) & 1

    def inside(self, now: bool) -> np.ndarray:
        """Whether each piece starts inside a string when the first does or does not."""
        return (np.searchsorted(self.quotes, self.starts) & 1) != now

    def depth(self, now: bool, deep: int) -> np.ndarray:
        """Depth at the end of each piece, from the state and depth before the first."""
        total = np.concatenate([[0], np.cumsum(np.where(self.odd == now, self.steps, 0))])
        return deep + total[np.searchsorted(self.brackets, self.ends)]

    def after(self, now: bool) -> bool:
        return bool(now) != bool(len(self.quotes) & 1)


def _json_splits(pieces: DataFrame, rows: int) -> DataFrame:
    """A row per split: for both states it can start in, the state it ends in
    (_o, _i), how much deeper it ends (_n_o, _n_i), and the least depth at the
    end of a piece but its last (_m_o, _m_i); the bracket it starts with, and
    its last character."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_pylist([{"_file": key[0], "_blk": key[1], "_o": state[0], "_i": state[1], "_n_o": deep[0], "_n_i": deep[1],
                                                "_m_o": least[0], "_m_i": least[1], "_left": left, "_right": right}], schema)

        key = None
        for own, part in _by_split(batches, rows):
            p, values = _Pieces(part.column("value")), part.column("value")
            if own != key:
                if key is not None:
                    yield row()
                key, state, deep, least = own, [False, True], [0, 0], [_NO_DEPTH, _NO_DEPTH]
                left = re.match(rb"\s*([\[{]?)", values[0].as_py())[1].decode()
            else:
                least = [min(x, y) for x, y in zip(least, deep, strict=True)]
            for k in (0, 1):
                depth = p.depth(state[k], deep[k])
                least[k], deep[k] = min([least[k], *depth[:-1].min(initial=_NO_DEPTH, keepdims=True).tolist()]), int(depth[-1])
            state = [p.after(state[0]), p.after(state[1])]
            right = values[-1].as_py().rstrip()[-1:].decode("latin-1")
        if key is not None:
            yield row()

    fields = [("_file", pa.string()), ("_blk", pa.int64()), ("_o", pa.bool_()), ("_i", pa.bool_()), *((c, pa.int64()) for c in ("_n_o", "_n_i", "_m_o", "_m_i")),
              ("_left", pa.string()), ("_right", pa.string())]
    schema = pa.schema(fields)
    return pieces.mapInArrow(scan, "_file string, _blk long, _o boolean, _i boolean, _n_o long, _n_i long, _m_o long, _m_i long, _left string, _right string")


def _json_cut(pieces: DataFrame, starts: DataFrame, rows: int) -> DataFrame:
    """_file, _blk, _at (number in the split, -1 for what goes on from an
    earlier one), _text and _whole of every part, or what of it stands in the
    split.  ``starts`` has a row per split."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []                          # own: text of the part at hand
        at, whole, head, tail = -1, False, False, False

        def batch(out):
            texts = [re.sub(rb"^\s*[\[{]", b"", t) if head and n == 0 else t for n, t, _ in out]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.string()), pa.array([key[1]] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                                               pa.array(texts, pa.binary()), pa.array([x[2] for x in out], pa.bool_())], ["_file", "_blk", "_at", "_text", "_whole"])

        def last():
            text = b",".join(own)
            return batch([(at, re.sub(rb"[\]}]\s*$", b"", text) if tail else text, whole and tail)])

        for now, part in _by_split(batches, rows):
            if now != key:
                if own:
                    yield last()
                key, own, at, whole = now, [], -1, False
                inside, deep, head, tail = (part.column(c)[0].as_py() for c in ("_inside", "_before", "_head", "_tail"))
                opening = head
            else:
                opening = False
            p = _Pieces(part.column("value"))
            depth = p.depth(inside, deep)
            first = ~p.inside(inside) & (np.concatenate([[deep], depth[:-1]]) == 1)
            first[0] |= opening
            inside, deep, first = p.after(inside), int(depth[-1]), np.flatnonzero(first)
            if not len(first):
                own.append(p.text)
                continue
            cuts, out = p.starts[first].tolist(), []
            if first[0] > 0:
                own.append(p.text[:cuts[0] - 1])
            if own:
                out.append((at, b",".join(own), whole))
            out += [(at + 1 + n, p.text[x:y - 1], True) for n, (x, y) in enumerate(itertools.pairwise(cuts))]
            if out:
                yield batch(out)
            at, own, whole = at + len(cuts), [p.text[cuts[-1]:]], True
        if own:
            yield last()

    at = starts.select(F.col("_file").alias("_sf"), F.col("_blk").alias("_sb"), "_inside", "_before", "_head", "_tail")
    placed = pieces.join(F.broadcast(at), (F.col("_file") == F.col("_sf")) & (F.col("_blk") == F.col("_sb"))).drop("_sf", "_sb")
    return placed.mapInArrow(scan, "_file string, _blk long, _at long, _text binary, _whole boolean")


def _json_parts(spark: SparkSession, files: list[str]) -> DataFrame:
    """What stands between the outermost brackets of files that are one JSON
    array or object, cut at the commas there: _file, _array, _part (from 0),
    _text.  Files of any other shape are left out.

    Files are read in splits of pieces between commas.  A scan says what the
    quotes and brackets of a split do, so where every split starts; a second
    one cuts it: pieces that start at depth one outside of a string start a
    part.  Parts over split ends are put together by a grouping."""
    bounded_batches(spark)
    pieces = (spark.read.option("lineSep", ",").text(files)
              .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk")))
    splits = cut_lineage(_json_splits(pieces, BLOCK))                     # a row per split
    least = F.when(F.col("_inside"), F.col("_m_i")).otherwise(F.col("_m_o"))
    deeper = F.when(F.col("_inside"), F.col("_n_i")).otherwise(F.col("_n_o"))
    splits = splits.join(split_starts(splits), ["_file", "_blk"]).withColumns({
        "_ends": F.col("_before") + deeper, "_least": F.col("_before") + least,
        "_head": F.col("_blk") == F.min("_blk").over(Window.partitionBy("_file")), "_tail": F.col("_blk") == F.max("_blk").over(Window.partitionBy("_file"))})
    # one pair of brackets around all of it: depth stays above zero up to the last piece and ends at zero there
    shape = splits.groupBy("_file").agg(
        F.max(F.when(F.col("_head"), F.col("_left"))).alias("_opens"), F.max(F.when(F.col("_tail"), F.col("_right"))).alias("_closes"),
        F.max(F.when(F.col("_tail"), F.col("_ends"))).alias("_end"), F.min("_least").alias("_least"),
        F.min(F.when(~F.col("_tail"), F.col("_ends"))).alias("_between"))
    shape = cut_lineage(shape.filter("_end = 0 and _least > 0 and coalesce(_between, 1) > 0 and ((_opens = '[' and _closes = ']') or (_opens = '{' and _closes = '}'))")
                        .select("_file", (F.col("_opens") == "[").alias("_array")))
    found = _json_cut(pieces, splits.join(shape, "_file"), BLOCK)
    found = staged(found.withColumn("_text", F.col("_text").cast("string")), "json-parts")
    count = found.groupBy("_file", "_blk").agg((F.max("_at") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.join(F.broadcast(count.select("_file", "_blk", before.alias("_before"))), ["_file", "_blk"]).withColumn("_part", F.col("_before") + F.col("_at"))
    over = (found.filter(~F.col("_whole")).groupBy("_file", "_part").agg(F.array_sort(F.collect_list(F.struct("_blk", "_text"))).alias("_parts"))
            .select("_file", "_part", F.array_join(F.transform("_parts", lambda x: x["_text"]), ",").alias("_text")))
    found = found.filter("_whole").select("_file", "_part", "_text").unionByName(over)
    return found.join(F.broadcast(shape), "_file")


def _with_long_lines(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files below ``path`` that hold a line of ``LONG_LINE`` bytes or more, and
    all others if there are any such: read with that most length, what is read
    does not add up to their size."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    large = [unquote(r[0]) for r in listed.filter(F.col("_size") >= LONG_LINE).collect()]       # names alone are read
    if not large:
        return [], []
    lines = (spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", str(LONG_LINE)).text(large)
             .groupBy(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
             .agg(F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("_read")))
    short = {unquote(r[0]) for r in lines.filter(F.col("_read").isin(F.col("_size"), F.col("_size") + 1)).select("_file").collect()}
    long = [f for f in large if f not in short]
    return long, [f for f in (unquote(r[0]) for r in listed.collect()) if f not in set(long)] if long else []


def land_json(spark: SparkSession, path: str, source: str, tenant_id: str,
              batch_id: str, ingested_at: str) -> Landing:
    """S3 JSON landing.

    Per file: when the whole text is one JSON document, an object is one record
    and an array is one record per element; otherwise every non-blank line is
    one record.  A line's payload is its text as it stands (key order, number
    spelling, repeated keys); array elements keep key order and number kinds.
    Lines that are not one whole JSON value go to ``rejects`` (the reference
    fails the whole upload, quirk Q14; ours lands the rest, status partial).

    Files are read in splits.  Those that can be one document of several lines
    or elements (named on the driver) are cut at their outermost commas by two
    scans over quotes and brackets; they are documents if every part is a JSON
    value (or member).  Only an object document, which is one record, is put
    together again.  Lines and parts are parsed once and staged.  Files with a
    line of ``LONG_LINE`` bytes are only read by lines if they are no document.
    """
    def by_line(files: str | list[str]) -> DataFrame:
        lines = file_row_number(spark.read.text(files).select("value"), "_line")
        return staged(lines.filter(F.trim("value") != "").withColumn("_ok", is_json("value")), "json-lines")

    long, others = _with_long_lines(spark, path)
    linewise = by_line(others if long else path) if others or not long else None
    head = F.substring(F.ltrim("value"), 1, 1)
    files = list(long)
    if linewise is not None:
        per_file = linewise.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_ok", "_line").alias("_first_ok"),
                                                 F.min_by(head, "_line").alias("_head"))
        maybe = per_file.filter(((F.col("_n") == 1) & (F.col("_head") == "[")) | (~F.col("_first_ok") & F.col("_head").isin("[", "{")))
        files += [unquote(r[0]) for r in maybe.select("_file").collect()]
    recs = None
    if files:
        parts = _json_parts(spark, files)
        empty = F.trim(F.regexp_replace("_text", r"\s+", "")) == ""
        whole = F.when(F.col("_array"), is_json("_text")).otherwise(is_json(F.concat(F.lit("{"), "_text", F.lit("}"))))
        # nothing between the brackets is fine, an empty part beside others is not
        parts = parts.withColumns({"_empty": empty, "_valid": whole})
        element = F.get(json_elements(F.concat(F.lit("["), "_text", F.lit("]"))), F.lit(0))
        parts = staged(parts.withColumn("_text", F.when(F.col("_array") & F.col("_valid") & ~F.col("_empty"), element).otherwise(F.col("_text"))), "json-records")
        good = (parts.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_valid") & ~F.col("_empty"), 1).otherwise(0)).alias("_good"),
                                           F.max("_empty").alias("_any_empty"))
                .filter("_n = _good or (_n = 1 and _any_empty)").select("_file"))
        good = cut_lineage(good)
        rest = set(long) - {unquote(r[0]) for r in good.collect()} if long else None
        if rest:                                     # no document: their lines, however long
            linewise = by_line(sorted(rest)) if linewise is None else linewise.unionByName(by_line(sorted(rest)))
        parts = parts.join(F.broadcast(good), "_file", "left_semi")
        elements = parts.filter("_array and not _empty").select("_file", F.col("_part").alias("_pos"), F.col("_text").alias("payload"))
        objects = (parts.filter(~F.col("_array")).groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_part", "_text"))).alias("_members"))
                   .select("_file", F.lit(0).cast("long").alias("_pos"),
                           F.concat(F.lit("{"), F.array_join(F.transform("_members", lambda x: x["_text"]), ","), F.lit("}")).alias("payload")))
        recs = elements.unionByName(objects)
        linewise = None if linewise is None else linewise.join(F.broadcast(good), "_file", "left_anti")
    if linewise is None:
        linewise = spark.createDataFrame([], "value string, _file string, _line long, _ok boolean")
    landed = linewise.filter("_ok").select("_file", F.col("_line").alias("_pos"), F.trim("value").alias("payload"))
    recs = landed if recs is None else recs.unionByName(landed)
    bronze = recs.select(
        record_id(batch_id, source, F.concat_ws("#", F.col("_file"), F.col("_pos")), F.col("_pos")).alias("id"),
        F.lit(tenant_id).alias("tenant_id"), F.lit(ingested_at).alias("ingested_at"),
        F.lit(source).alias("source"), "payload", F.lit("{}").alias("metadata"))
    rejects = linewise.filter(~F.col("_ok")).select(
        F.col("_file").alias("file"), F.col("_line").alias("row_number"), F.col("value").alias("raw"))
    target = bronze_table_name(source, tenant_id)
    return Landing(bronze, rejects, landing_run(bronze, rejects, batch_id, ingested_at, target))


__all__ = ["ENVELOPE_SCHEMA", "ENVELOPE_COLUMNS", "envelope", "land_csv", "land_json",
           "landing_run", "Landing", "bronze_table_name", "record_id", "source_table_name",
           "tenant_slug"]
