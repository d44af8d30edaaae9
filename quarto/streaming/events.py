"""Event-time streaming over the event table: additions beside the archive, and its rate limits and ingest loop."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quarto.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, root: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream; their zoneless time is cast, as watermarks need."""
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    return s.load(root, format="parquet", recursiveFileLookup="false", pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


def rate_limit(events: DataFrame, seconds: int = 60, most: int = 2) -> DataFrame:
    """Users and fixed windows with more than ``most`` requests."""
    g = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "user_id").agg(F.count("*").alias("requests"))
    return g.where(F.col("requests") > most).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "requests")


def lockouts(events: DataFrame, failures: int = 5, seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """(user_id, locked_at): each error that makes ``failures`` within the last ``seconds``, which starts the count anew.

    A user's state is dropped once the watermark is ``seconds`` beyond the last error.
    """

    def step(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        out, last = [], 0
        for t in sorted(x for b in batches for x in b.us.tolist()):
            recent = [r for r in recent if r > t - seconds * 1_000_000] + [t]
            last = max(last, t)
            if len(recent) >= failures:
                out.append(t)
                recent = []
        state.update((recent,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "locked_us": out})

    e = events.withWatermark("ts", late).where("event_type = 'error'").select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, locked_us long", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now into files of the checkpoint folder and returns them as a table.

    In ``update`` mode the last row of each of ``keys`` counts, in ``complete``
    mode the last batch, in ``append`` mode every row. No row passes the driver.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/_at={number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema if mode == "complete" else StructType([*stream.schema.fields, StructField("_at", IntegerType())])).parquet(path)
    if mode == "update" and keys:
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("x")).select(*keys, *(f"x.{c}" for c in rest))
    return rows.select(*stream.columns)


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, ids: list[str], transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """§2.15: idempotent micro-batch ingest of rows told apart by ``ids``: rows that are there already are left out, others of the same ``key`` are added to it.

    A batch that is run again replaces its own partitions (key and batch, which
    the checkpoint and its number tell), so neither a repeated batch nor the
    same rows by another stream change anything. Only ids of the batch's keys
    are read.
    """
    mark = f"{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, number: int) -> None:
        own = f"{mark}-{number}"
        rows = transform(batch).dropDuplicates(ids)
        try:
            there = batch.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("_batch", StringType())])).parquet(path)
            there = there.where(F.col("_batch") != own).join(rows.select(key).distinct(), key, "left_semi").select(*ids)
            rows = rows.join(there, ids, "left_anti")
        except AnalysisException:  # the first batch: no path yet
            pass
        rows.withColumn("_batch", F.lit(own)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "_batch").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ingest path."""
    return spark.read.parquet(path).drop("_batch")


def _s(f, mode, *keys):
    return lambda spark, root: run_to_table(f(event_stream(spark, root)), mode, list(keys))


QUERIES = {"st01_tumbling": _s(tumbling, "update", "start", "event_type"), "st02_sliding": _s(sliding, "update", "start"), "st03_sessions": _s(sessions, "complete"), "st04_rate_limit": _s(lambda e: rate_limit(e, 3600, 1), "update", "user_id", "start"), "st05_lockouts": _s(lambda e: lockouts(e, 2, 86_400), "append")}
ORACLE = {
    "st01_tumbling": "select date_trunc('hour', ts) as start, event_type, count(*) events, round(sum(value), 2) as value from events group by 1, 2",
    "st02_sliding": "select s as start, count(*) events from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) s from events) group by 1",
    "st03_sessions": "with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end n from events), b as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) g from a) select user_id, min(ts) as start, count(*) events from b group by user_id, g",
    "st04_rate_limit": "select user_id, date_trunc('hour', ts) as start, count(*) requests from events group by 1, 2 having count(*) > 1",
}
ORACLE["st05_lockouts"] = """with recursive e as (select user_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts) n from events where event_type = 'error'),
    r as (select user_id, n, us, us held, false locked from e where n = 1 union all select e.user_id, e.n, e.us, case when r.held > e.us - 86400000000 then null else e.us end, coalesce(r.held > e.us - 86400000000, false) from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select user_id, us locked_us from r where locked"""
