"""Telemetry: sessions, health figures, labels, user-item features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORTLIST, VIEWED = ["favorite_added", "compare_added", "cart_added"], ["view", "click"]


def micros(column: Column) -> Column:
    """Microseconds since the epoch; stored times have no zone and are taken as UTC."""
    return F.unix_micros(column.cast("timestamp"))


def sessionize(events: DataFrame, gap: int) -> DataFrame:
    """Events with session: the number of the user's session, which ends after `gap` seconds without an event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    passed = micros(F.col("ts")) - micros(F.lag("ts").over(order))
    fresh = F.when(passed <= gap * 1_000_000, 0).otherwise(1)
    return events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("fresh")


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places, 0 without b."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)


def health(events: DataFrame) -> DataFrame:
    """One row of counts by type and ratios, in one pass. Ratios may exceed 1: events are counted independently."""
    count = {k: F.count_if(F.col("event_type") == k) for k in ("view", "click", "purchase", "signup", "error")}
    return events.agg(*[v.alias(f"n_{k}") for k, v in count.items()], ratio(count["click"], count["view"]).alias("click_through_rate"), ratio(count["purchase"], count["click"]).alias("purchase_after_click"), ratio(count["error"], F.count("*")).alias("error_share"))


def user_item_features(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """Counts by user and item of events (user_id, item_id, event_type, value, ts) and purchases (user_id, item_id, ts), mean value, last time.

    A purchase that is both an event and a row of purchases counts twice, as both are recorded.
    """
    both = events.select("user_id", "item_id", "event_type", "value", "ts").unionByName(purchases.select("user_id", "item_id", F.lit("purchase").alias("event_type"), F.lit(None).cast("double").alias("value"), "ts"))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return both.where("item_id IS NOT NULL").groupBy("user_id", "item_id").agg(kind("view").alias("view_count"), kind("click").alias("click_count"), kind("purchase").alias("purchase_count"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("avg_value"), F.max("ts").alias("last_at"))


def graded(events: DataFrame, by: list[str]) -> DataFrame:
    """Label of each group: 3 with a purchase, 2 with a click, 1 with a view, else 0."""
    has = lambda k: F.bool_or(F.col("event_type") == k)
    return events.groupBy(*by).agg(F.when(has("purchase"), 3).when(has("click"), 2).when(has("view"), 1).otherwise(0).alias("label"))


def without(rows: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key isn't among the others."""
    return rows.join(others.select(*by).distinct(), by, "left_anti")


def refined(events: DataFrame) -> DataFrame:
    """Each event with the user's type before it in the session, and whether it changed."""
    order = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    return events.withColumn("before", F.lag("event_type").over(order)).withColumn("refined", F.coalesce(F.col("before") != F.col("event_type"), F.lit(False)))


def dwell(events: DataFrame, quick_ms: int) -> DataFrame:
    """Views with the milliseconds to the user's next event in the session (null at its end), and whether they left quickly."""
    order = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    spent = ((micros(F.lead("ts").over(order)) - micros(F.col("ts"))) / 1000).cast("long")
    return events.withColumn("dwell_ms", spent).where("event_type = 'view'").withColumn("quick_back", F.coalesce(F.col("dwell_ms") < quick_ms, F.lit(False)))


def enrich(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with category and supplier of their item, empty where the item is unknown."""
    return events.join(items.select("item_id", "category", "supplier_id"), "item_id", "left").withColumn("category", F.coalesce("category", F.lit("")))


def bucket(event_type: Column) -> Column:
    return F.when(event_type.isin("view", "click"), "browse").when(event_type == "purchase", "order").when(event_type == "signup", "account").otherwise("other")


def validated(events: DataFrame, known: list[str]) -> DataFrame:
    """Events with reject_reason: unknown type, value out of range, or null for good ones."""
    why = F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(known), "unknown_type").when(F.col("item_id").isNull(), "no_item").when(~F.col("value").between(0, 1e6), "value_range")
    return events.withColumn("reject_reason", why)
