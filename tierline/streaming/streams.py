"""Structured Streaming forms of landing and refresh.

* T1 ``land_stream``: files -> envelope projection -> append Parquet sink.
* T2 ``refresh_stream``: bronze stream -> ``foreachBatch`` flatten + bucketed
  upsert into silver (one job per micro-batch, not one statement per record).
* T3 ``debounce_stream``: per key, fire when >= 30 s since the last fired
  event; events wait in keyed state for the watermark
  (``transformWithStateInPandas`` with event-time timers).
* T4 ``daily_counts_stream``: event-time day windows with a watermark in
  update mode, merged into a keyed table per micro-batch.

All sinks and checkpoints live in folders passed by the caller (below the
shared checkpoint root on a cluster); ``availableNow`` runs drain what is
there and stop, so retries resume from the checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tierline.functions.jsonx import TO_JSON_OPTS, is_json
from tierline.operators import gold as gold_tables
from tierline.operators.flatten import flatten_select
from tierline.sources.files import file_row_number
from tierline.sources.landing import record_id
from tierline.sources.sinks import read_changes, upsert_table

DEBOUNCE_US = 30 * 1_000_000


def _read(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if path.endswith(".parquet"):
        # a single file: stream its folder filtered to that file name
        path, name = path.rsplit("/", 1)
        r = r.option("pathGlobFilter", name)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def _stream_id(batch: DataFrame) -> str:
    """The running stream's id, which its checkpoint holds."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write_epoch(df: DataFrame, batch: DataFrame, epoch: int, path: str, parts: list[str]) -> None:
    """Write what a micro-batch gives to a folder of its own, by stream and
    epoch: streams never meet, and a replay replaces its first try."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts)
     .parquet(f"{path.rstrip('/')}/stream={_stream_id(batch)}/epoch={epoch}"))


def land_stream(spark: SparkSession, src: str, schema, sink: str, checkpoint: str, source: str,
                tenant_id: str, position: str | None, ingested_at: str | None = None, fmt: str = "parquet",
                rejects: str | None = None):
    """T1 streaming landing of records into the bronze envelope.

    ``fmt="parquet"``: typed files, payload = the row as JSON, id from the
    ``position`` column.  ``fmt="text"``: JSON lines; each line that is one
    JSON value is one record, its payload the line as it stands; other
    non-blank lines go to the folder ``rejects`` (default ``<sink>_rejects``)
    with file and line number.  Ids come from file and line number (a file is
    read in one micro-batch), so a replayed batch lands the same ids.

    Any number of streams, of either form, may share a sink: each batch is
    written to ``stream=<id>/epoch=<n>`` (the id is kept in the checkpoint, so
    a new checkpoint is a new stream), and a replay replaces that folder only.
    """
    ts = F.lit(ingested_at) if ingested_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")

    def enveloped(df: DataFrame, record: Column, body: Column) -> DataFrame:
        env = df.select(record.alias("id"), F.lit(tenant_id).alias("tenant_id"), ts.alias("ingested_at"),
                        F.lit(source).alias("source"), body.alias("payload"), F.lit("{}").alias("metadata"))
        return env.withColumn("ingest_date", F.substring("ingested_at", 1, 10))

    if fmt == "text":
        rows = spark.readStream.text(src).select(
            "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"))
        bad = rejects or f"{sink.rstrip('/')}_rejects"

        def land(batch: DataFrame, epoch: int) -> None:
            lines = file_row_number(batch, "_line").filter(F.trim("value") != "").withColumn("_ok", is_json("value"))
            pos = F.concat_ws("#", F.col("_file"), F.col("_line"))
            good = enveloped(lines.filter("_ok"), record_id("stream", source, pos, F.col("_line")), F.trim("value"))
            out = lines.filter(~F.col("_ok")).select(F.col("_file").alias("file"), F.col("_line").alias("row_number"),
                                                     F.col("value").alias("raw"))
            _write_epoch(good, batch, epoch, sink, ["ingest_date"])
            _write_epoch(out, batch, epoch, bad, [])
    else:
        rows = _read(spark, src, schema)

        def land(batch: DataFrame, epoch: int) -> None:
            env = enveloped(batch, record_id("stream", source, F.col(position)),
                            F.to_json(F.struct(*[F.col(c) for c in batch.columns]), TO_JSON_OPTS))
            _write_epoch(env, batch, epoch, sink, ["ingest_date"])

    return (rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


@dataclass
class Gold:
    """A gold table that ``refresh_stream`` keeps: rows and sums by group."""
    path: str
    groups: list[str]
    sums: list[str]
    n_buckets: int | None = None


def refresh_stream(spark: SparkSession, bronze_path: str, bronze_schema, fields: list[tuple[str, str]],
                   pk: str, silver_path: str, checkpoint: str, n_buckets: int | None = None,
                   order_by: list | None = None, downstream: list | None = None,
                   gold: list[Gold] | None = None, deleted: str | None = None, max_files: int | None = None):
    """T2 on-change silver refresh: every micro-batch of new bronze rows is
    flattened (W10) and upserted into the bucketed silver table (W3).

    ``gold`` tables follow by deltas: the upsert's change set, kept below
    ``<checkpoint>_changes`` by epoch, is all they read, and only changed
    groups are rewritten; a replayed batch applies what its first try did not.
    ``deleted`` names a boolean field: rows where it is true remove their key.
    Each ``downstream(spark, silver_path)`` runs after that, in order, once per
    micro-batch (tables that need all of silver)."""
    s = _read(spark, bronze_path, bronze_schema, max_files)

    def apply(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        rows = flatten_select(batch, fields, pk)
        log = f"{checkpoint.rstrip('/')}_changes/{_stream_id(batch)}/{epoch}" if gold else None
        upsert_table(own, silver_path, rows, pk, n_buckets, order_by=order_by or [pk], deleted=deleted, log=log)
        for g in gold or []:
            gold_tables.apply(own, g.path, gold_tables.delta(read_changes(own, log), g.groups, g.sums), g.groups, epoch, g.n_buckets)
        for step in downstream or []:
            step(own, silver_path)

    return (s.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class _Debounce(StatefulProcessor):
    """One key's events in time order: ``buffer`` holds those that the
    watermark has not reached, ``mark`` the last fired time and the last event
    that has been judged.  A timer stands at the first event in the buffer."""

    def __init__(self, id_type: str):
        self.id_type = id_type

    def init(self, handle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", f"last long, t long, id {self.id_type}")
        self.buffer = handle.getListState("buffer", f"t long, id {self.id_type}")

    def _advance(self, key, waiting: list, watermark_us: int, late: list) -> Iterator[pd.DataFrame]:
        ready = sorted(e for e in waiting if e[0] <= watermark_us)
        rest = [e for e in waiting if e[0] > watermark_us]
        if ready or not rest:
            self.buffer.clear()
        if rest:
            self.buffer.put(rest)
            self.handle.registerTimer(-(-min(rest)[0] // 1000))
        mark = self.mark.get()
        last, seen = (mark[0], (mark[1], mark[2])) if mark else (None, None)
        fired = []
        for event in ready:
            if seen is not None and event < seen:
                late.append(event)
                continue
            seen = event
            if last is None or event[0] - last >= DEBOUNCE_US:
                fired.append(event)
                last = event[0]
        if seen is not None:
            self.mark.update((last, *seen))
        out = [(*e, False) for e in fired] + [(*e, True) for e in late]
        if out:
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "event_id": pd.Series([e[1] for e in out], dtype=object),
                                "fired_us": [e[0] for e in out], "late": [e[2] for e in out]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = list(self.buffer.get()) if self.buffer.exists() else []
        for part in rows:
            waiting += zip(part["t"].tolist(), part["id"].tolist())
        yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = list(self.buffer.get()) if self.buffer.exists() else []
        if waiting:
            yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass


#: State of many keys is kept on disk, with timers.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounce_stream(spark: SparkSession, src: str, schema, key: str, ts: str, id_col: str,
                    sink: str, checkpoint: str, max_files: int | None = None, lateness: str = "0 seconds"):
    """T3 streaming debounce of events that arrive in any order.

    Events wait per key, in state, until the watermark (``lateness`` behind
    the newest event) has passed them, and are then judged in time order
    (equal times by id), so how they are spread over micro-batches does not
    matter.  An event that comes behind the watermark is judged at once if its
    key has judged none after it; else it is late.

    The sink (``stream=``/``epoch=`` folders as in ``land_stream``) holds key,
    event_id, fired_us and ``late``: false for fired events, true for late
    ones, of which every one is written.  A run that ends leaves the events of
    the last ``lateness`` in state for the next run; ``debounce_pending`` gives
    what of them would fire if nothing else came.  Rows without a time or a key
    of null keep to Spark's grouping; rows without a time are dropped.
    """
    s = _read(spark, src, schema, max_files)
    types = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    # the millisecond that holds the event, rounded up, is what the watermark counts
    s = (s.filter(F.col(ts).isNotNull()).withColumn("_t", micros)
         .withColumn("_ets", F.timestamp_millis(F.ceil(F.col("_t") / 1000).cast("long"))).withWatermark("_ets", lateness))
    # the operator gets no event-time column: it would not see rows behind the watermark
    s = s.filter(F.col("_ets").isNotNull()).select(F.col(key).alias("key"), F.col("_t").alias("t"), F.col(id_col).alias("id"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    try:
        out = s.groupBy("key").transformWithStateInPandas(
            statefulProcessor=_Debounce(types[id_col]), outputStructType=f"key {types[key]}, event_id {types[id_col]}, fired_us long, late boolean",
            outputMode="Append", timeMode="EventTime")
        return (out.writeStream.foreachBatch(lambda batch, epoch: _write_epoch(batch, batch, epoch, sink, []))
                .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def debounce_pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, event_id, fired_us of the events still in a stopped stream's state
    that would fire if the stream ended here."""
    def state(name: str) -> DataFrame:
        reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        return reader.load()

    mark = state("mark").select(F.col("key.key").alias("key"), F.col("value.last").alias("last"), F.struct("value.t", "value.id").alias("seen"))
    waiting = state("buffer").select(F.col("key.key").alias("key"), F.col("list_element.t").alias("t"), F.col("list_element.id").alias("id"))
    rows = (waiting.join(mark, waiting["key"].eqNullSafe(mark["key"]), "left").drop(mark["key"])
            .filter(F.col("seen").isNull() | (F.struct("t", "id") >= F.col("seen"))))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fold(events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values(["t", "id"], ignore_index=True)
        last, t, fired = events["last"].iloc[0], events["t"].to_numpy(), []
        at = 0 if pd.isna(last) else int(np.searchsorted(t, int(last) + DEBOUNCE_US))
        while at < len(t):
            fired.append(at)
            at = int(np.searchsorted(t, int(t[at]) + DEBOUNCE_US))
        out = events.iloc[fired]
        return pd.DataFrame({"key": out["key"], "event_id": out["id"], "fired_us": out["t"]})

    return rows.select("key", "t", "id", "last").groupBy("key").applyInPandas(
        fold, f"key {types['key']}, event_id {types['id']}, fired_us long")


def daily_counts_stream(spark: SparkSession, src: str, schema, ts: str, group: str, sink: str,
                        checkpoint: str, watermark: str = "1 day", n_buckets: int = 8):
    """T4 per event-time day and group: event count, emitted in update mode
    and merged into the sink table keyed by (day, group)."""
    s = _read(spark, src, schema)
    s = s.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark)
    agg = s.groupBy(F.window("_ets", "1 day").alias("w"), F.col(group)).agg(F.count(F.lit(1)).alias("n"))
    agg = agg.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), group, "n")

    def apply(batch: DataFrame, epoch: int) -> None:
        upsert_table(batch.sparkSession, sink, batch, ["day", group], n_buckets)

    return (agg.writeStream.outputMode("update").foreachBatch(apply)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
