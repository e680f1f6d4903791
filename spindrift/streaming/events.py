"""Structured Streaming over the event log: validation, enrichment, windows, dwell, once-per-session events. Extensions; results equal the batch operators'."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators import telemetry as M

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The events of a folder or file of Parquet, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path).withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))


def validated(stream: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good events, and rejected ones with their reason."""
    marked = M.validated(stream, known)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def enriched(stream: DataFrame, items: DataFrame) -> DataFrame:
    """Events with their item's category and supplier: a join with a table that doesn't stream."""
    return M.enrich(stream, items)


def daily(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts by day and type; events up to `late` behind are taken in."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("day.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def once(stream: DataFrame, by: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(by)


def impressions(stream: DataFrame, items: str, most: int = 12) -> DataFrame:
    """A row for each of the first items shown, with its place."""
    return stream.select("event_id", "ts", "user_id", F.posexplode(F.slice(items, 1, most)).alias("place", "item_id")).withColumn("place", F.col("place") + 1)


def dwell(stream: DataFrame, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """Rows user_id, item_id, started_at, dwell_ms: from a user's view of an item to their next event on it. State is the open views of a bucket of keys, each dropped a day after it when the watermark passes.

    Keys are dealt to `buckets` by a hash, and all keys of a bucket are handled at once, as a call for each key takes far longer than its rows.
    """
    day, none = 86_400_000_000, np.iinfo(np.int64).min  # what stands for no time

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        micros = lambda x: x.to_numpy("datetime64[us]").astype(np.int64)
        held = np.frombuffer(state.get[0], np.int64).reshape(4, -1) if state.exists else np.zeros((4, 0), np.int64)
        parts = [] if state.hasTimedOut else [x for x in batches if len(x)]
        new = pd.concat(parts) if parts else None
        n = held.shape[1]
        if new is None:
            (nobody, users, items, at), is_open, came = held, np.ones(n, bool), np.zeros(n, bool)
        else:
            new = new.sort_values(["ts", "event_id"])
            nobody, users, items, at = (np.r_[old, own] for old, own in zip(held, (new["nobody"].to_numpy(np.int64), new["user_id"].to_numpy(np.int64), new["item_id"].to_numpy(np.int64), micros(new["ts"])), strict=True))
            is_open, came = np.r_[np.ones(n, bool), (new["event_type"] == "view").to_numpy(bool)], np.r_[np.zeros(n, bool), np.ones(len(new), bool)]
        order = np.lexsort((items, users, nobody))  # stable: an open view stands before its key's new events
        nobody, users, items, at, is_open, came = (x[order] for x in (nobody, users, items, at, is_open, came))
        last = np.r_[(users[1:] != users[:-1]) | (items[1:] != items[:-1]) | (nobody[1:] != nobody[:-1]), np.ones(min(1, len(users)), bool)]
        ended = np.flatnonzero(is_open & ~last)
        ended = ended[(at[ended] != none) & (at[ended + 1] != none)]
        milliseconds = np.trunc((at[ended + 1] - at[ended]) / 1000).astype(np.int64)
        out = pd.DataFrame({"user_id": pd.arrays.IntegerArray(users[ended].copy(), nobody[ended] > 0), "item_id": items[ended], "started_at": pd.to_datetime(at[ended], unit="us"), "dwell_ms": milliseconds})
        now = state.getCurrentWatermarkMs() * 1000
        kept = np.flatnonzero(is_open & last & (at != none) & (came | (at + day >= now)))
        if len(kept):
            state.update((np.stack([nobody[kept], users[kept], items[kept], at[kept]]).tobytes(),))
            state.setTimeoutTimestamp(max(int(at[kept].min() + day) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield out

    keyed = stream.withWatermark("ts", late).where("item_id IS NOT NULL").withColumns({"nobody": F.col("user_id").isNull().cast("long"), "user_id": F.coalesce("user_id", F.lit(0).cast("long"))}).withColumn("bucket", F.pmod(F.hash("user_id", "item_id"), F.lit(buckets))).groupBy("bucket")
    return keyed.applyInPandasWithState(step, "user_id long, item_id long, started_at timestamp, dwell_ms long", "views binary", "append", GroupStateTimeout.EventTimeTimeout)


def refined(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows event_id, user_id, query, next_query, refined: each query of a user when the next comes, and whether that differs. State is the user's last query, dropped when the watermark passes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last, out = (tuple(state.get) if state.exists else None), []
        for number, query in zip(rows["event_id"], rows["query"], strict=True):
            if last is not None:
                out.append((last[0], key[0], last[1], query, last[1] != query))
            last = int(number), query
        state.update(last)
        state.setTimeoutTimestamp(max(int(rows["ts"].max().value // 1_000_000) + 400 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "query", "next_query", "refined"])

    keyed = stream.where("query IS NOT NULL").withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "event_id long, user_id long, query string, next_query string, refined boolean", "event_id long, query string", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that the stream has now, written to Parquet below the shared folder `checkpoint`, as a table.

    Each batch is a folder of its number, so a batch that comes again replaces itself; in complete mode the last batch has all rows.
    """
    spark, path = stream.sparkSession, f"{checkpoint}/drained-{uuid.uuid4().hex}"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last.append(number)

    done = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={max(last)}" if mode == "complete" else f"{path}/rows")
    return rows.select(*stream.columns)


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each batch to `write`, with its number: a batch that comes again has the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
