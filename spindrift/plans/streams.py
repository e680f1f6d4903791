"""Streams run to their end; their results equal the batch queries'."""

from __future__ import annotations

from spindrift.plans import bindings as B
from spindrift.plans.registry import query
from spindrift.session import shared_uri, table
from spindrift.streaming import events as E

W = B.with_sql


def stream(spark, sf):
    return E.event_stream(spark, f"{sf}/[e]vents.parquet", table(spark, sf, "events").schema)


@query(W(B.EVENTS, B.ITEMS) + "SELECT event_id, log.item_id, event_type, coalesce(category, '') AS category, supplier_id FROM log LEFT JOIN items ON log.item_id = items.item_id WHERE event_type IN ('view', 'click', 'purchase') AND log.item_id IS NOT NULL AND value BETWEEN 0 AND 1e6")
def stream_ingest(spark, sf):
    good, _ = E.validated(stream(spark, sf), ["view", "click", "purchase"])
    return E.drained(E.enriched(good, B.items(spark, sf)).select("event_id", "item_id", "event_type", "category", "supplier_id"), shared_uri(spark))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark, sf):
    timed = stream(spark, sf).withColumn("ts", E.F.col("ts").cast("timestamp"))
    return E.drained(E.daily(timed), shared_uri(spark), "complete")


def timed(spark, sf):
    return stream(spark, sf).withColumn("ts", E.F.col("ts").cast("timestamp"))


@query(W(B.EVENTS) + ", d AS (SELECT user_id, item_id, ts, event_type, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000 AS dwell_ms FROM log WHERE item_id IS NOT NULL WINDOW w AS (PARTITION BY user_id, item_id ORDER BY ts, event_id)) SELECT user_id, item_id, ts AS started_at, dwell_ms::BIGINT AS dwell_ms, dwell_ms < 5000 AS quick_back FROM d WHERE event_type = 'view' AND dwell_ms IS NOT NULL")
def stream_dwell(spark, sf):
    """Views of an item with the time to the user's next event on it: keyed state."""
    rows = E.drained(E.dwell(timed(spark, sf)), shared_uri(spark))
    return rows.select("user_id", "item_id", E.F.col("started_at").cast("timestamp_ntz").alias("started_at"), "dwell_ms", (E.F.col("dwell_ms") < 5000).alias("quick_back"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark, sf):
    """Each user's event types, once each, as scroll depths and comparisons are recorded once in a session."""
    return E.drained(E.once(timed(spark, sf), ["user_id", "event_type"], "400 days").select("user_id", "event_type"), shared_uri(spark))


@query(W(B.EVENTS) + "SELECT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_type' WHEN item_id IS NULL THEN 'no_item' ELSE 'value_range' END AS reject_reason, event_id FROM log WHERE event_type NOT IN ('view', 'click', 'purchase') OR item_id IS NULL OR value < 0 OR value > 1e6")
def stream_rejects(spark, sf):
    _, bad = E.validated(stream(spark, sf), ["view", "click", "purchase"])
    return E.drained(bad.select("reject_reason", "event_id"), shared_uri(spark))


@query("SELECT event_id, user_id, event_id * 3 + place - 1 AS item_id, place::INTEGER AS place FROM (SELECT event_id, user_id, unnest(range(1, least(event_id % 20, 12) + 1)) AS place FROM events WHERE event_type = 'view')")
def stream_impressions(spark, sf):
    """The first twelve of the items that a view shows; a view shows up to nineteen, numbered from three times its own number."""
    shown = E.F.when(E.F.col("event_id") % 20 > 0, E.F.transform(E.F.sequence(E.F.lit(1).cast("long"), E.F.col("event_id") % 20), lambda i: E.F.col("event_id") * 3 + i - 1)).otherwise(E.F.array().cast("array<bigint>"))
    rows = E.impressions(stream(spark, sf).where("event_type = 'view'").drop("item_id").withColumn("items", shown), "items")
    return E.drained(rows.select("event_id", "user_id", "item_id", "place"), shared_uri(spark))


@query(W(B.EVENTS) + ", s AS (SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM log) SELECT event_id, user_id, event_type AS query, next AS next_query, event_type <> next AS refined FROM s WHERE next IS NOT NULL")
def stream_refined(spark, sf):
    """Each user's queries (their event types stand for them) with the one after, as it comes: keyed state."""
    return E.drained(E.refined(timed(spark, sf).withColumn("query", E.F.col("event_type"))), shared_uri(spark))
