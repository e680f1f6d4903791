"""Recorded actions: which count, how they are shown, what they say about items, and what is exported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V

ACTIVITY_TYPES = [t for types in V.ACTIVITY_FILTERS.values() for t in types]


def activity_filter(event_type: Column) -> Column:
    """The filter that an event type belongs to; all for types that belong to none."""
    return reduce(lambda c, x: c.when(event_type.isin(x[1]), x[0]), list(V.ACTIVITY_FILTERS.items())[1:], F.when(event_type.isin(V.ACTIVITY_FILTERS["search"]), "search")).otherwise("all")


def quoted(query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("«"), query, F.lit("»"))).otherwise(V.NO_QUERY)


def activity(events: DataFrame, items: DataFrame) -> DataFrame:
    """Rows event_id, event_type, filter, title of the events (event_id, event_type, item_id, query) that are shown. items: item_id, title."""
    shown = events.where(F.col("event_type").isin(ACTIVITY_TYPES))
    named = shown.join(items.select("item_id", F.col("title").alias("__title")), "item_id", "left")
    subject = F.coalesce("__title", F.col("item_id").cast("string"), F.lit(V.NO_ITEM))
    kind = F.col("event_type")
    of = lambda table: F.try_element_at(T.literal_map(table), kind)
    title = F.coalesce(of(V.PLAIN_TITLES), F.concat(of(V.ITEM_TITLES), F.lit(": "), subject), F.concat(of(V.QUERY_TITLES), F.lit(" "), quoted(F.col("query"))))
    return named.select("event_id", "event_type", activity_filter(kind).alias("filter"), title.alias("title"))


def rejected(events: DataFrame) -> DataFrame:
    """Events with reject_reason: a type that isn't recorded, a quantity out of 1 to 999, a negative price, a rank or page below 1; null for good ones. Nulls of the latter are allowed."""
    why = F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(V.EVENT_TYPES), "event_type")
    why = why.when(~F.col("quantity").between(1, 999), "quantity").when(F.col("price") < 0, "price").when(F.col("rank_position") < 1, "rank_position").when(F.col("results_page") < 1, "results_page")
    return events.withColumn("reject_reason", why)


def query_changes(events: DataFrame) -> DataFrame:
    """Rows event_id, query, next_query, refined, abandoned, one for each search of a user's session: the query after it, whether that differs, and whether, if so, nothing was done in between.

    events: event_id, user_id, session, ts, event_type, query. Anything but searches, their results and impressions is an interaction.
    """
    order = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    is_search = F.col("event_type") == "search_submitted"
    passive = F.col("event_type").isin("search_submitted", "search_results_rendered", "search_impression")
    numbered = events.withColumn("search", F.sum(is_search.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    searches = numbered.where("search > 0").groupBy("user_id", "session", "search").agg(F.min_by(F.struct("event_id", "ts", F.trim(F.coalesce("query", F.lit(""))).alias("query")), F.struct("ts", "event_id")).alias("s"), F.count_if(~passive).alias("done"))
    following = F.lead("s.query").over(Window.partitionBy("user_id", "session").orderBy("search"))
    out = searches.withColumn("next_query", following)
    refined = F.coalesce((F.col("s.query") != "") & (F.col("next_query") != "") & (F.col("s.query") != F.col("next_query")), F.lit(False))
    return out.select("s.event_id", "s.query", "next_query", refined.alias("refined"), (refined & (F.col("done") == 0)).alias("abandoned"))


#: Count columns of user-item features, and the event type that each counts.
COUNTS = {
    "click_count": "result_clicked",
    "open_count": "result_opened",
    "favorite_count": "favorite_added",
    "compare_count": "comparison_added",
    "cart_add_count": "cart_added",
    "cart_remove_count": "cart_removed",
    "purchase_count": "purchase_completed",
    "pogo_count": "quick_back",
}


def user_item_features(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """Rows user_id, item_id, the counts, avg_dwell_ms and last_action_at of events (user_id, item_id, event_type, dwell_ms, ts) and purchases (user_id, item_id, ts).

    A purchase counts in purchase_count whether it is an event or a row of purchases; dwell is that of views that ended, 0 without any.
    """
    bought = purchases.select("user_id", "item_id", F.lit("purchase_completed").alias("event_type"), F.lit(None).cast("double").alias("dwell_ms"), "ts")
    both = events.select("user_id", "item_id", "event_type", F.col("dwell_ms").cast("double"), "ts").unionByName(bought).where("item_id IS NOT NULL")
    counts = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in COUNTS.items()]
    dwell = F.avg(F.when(F.col("event_type") == "product_view_ended", F.col("dwell_ms")))
    return both.groupBy("user_id", "item_id").agg(*counts, F.round(F.coalesce(dwell, F.lit(0.0)), 2).alias("avg_dwell_ms"), F.max("ts").alias("last_action_at"))


def relevance(impressions: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Rows session_id, item_id, position, query, clicked, viewed, purchased, label, one for each impression (session_id, item_id, position) of a known session (session_id, query).

    Labels: 3 bought, 2 put on a short list, 1 clicked or viewed, else 0, by the events (session_id, item_id, event_type) of the session on the item.
    """
    has = lambda types: F.coalesce(F.bool_or(F.col("event_type").isin(types)), F.lit(False))
    flags = events.where("item_id IS NOT NULL").groupBy("session_id", "item_id").agg(has(["result_clicked"]).alias("clicked"), has(V.VIEWED_TYPES).alias("viewed"), has(["purchase_completed"]).alias("purchased"), has(V.SHORTLIST_TYPES).alias("listed"))
    rows = impressions.join(sessions, "session_id").join(flags, ["session_id", "item_id"], "left")
    on = {c: F.coalesce(c, F.lit(False)) for c in ("clicked", "viewed", "purchased", "listed")}
    label = F.when(on["purchased"], 3).when(on["listed"], 2).when(on["clicked"] | on["viewed"], 1).otherwise(0)
    return rows.select("session_id", "item_id", "position", "query", *[on[c].cast("int").alias(c) for c in ("clicked", "viewed", "purchased")], label.alias("label"))


def label_shares(rows: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Rows of the group, label, n, share: how labels are distributed in each group."""
    counted = rows.groupBy(by, label).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def scope(rows: DataFrame, scopes: list[tuple[str, DataFrame]], every: bool = False) -> DataFrame:
    """Rows whose column is among the values of the first scope (column, frame of that column) that isn't empty; with `every`, of all that aren't. Without any, all rows."""
    for column, values in scopes:
        if values.isEmpty():
            continue
        rows = rows.join(values.select(column).distinct(), column, "left_semi")
        if not every:
            break
    return rows


def best_of_variants(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Of hits (by, doc_id, variant, score) of several variants of a query each document's best (the least variant of equals), the `limit` best of each query."""
    best = rows.groupBy(*by, "doc_id").agg(F.min_by(F.struct("variant", "score"), F.struct(-F.col("score"), F.col("variant"))).alias("b")).select(*by, "doc_id", "b.variant", "b.score")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def most_frequent(rows: DataFrame, by: list[str], place: str, n: int) -> DataFrame:
    """The n most frequent values with their counts, equals in the order of their first `place`: partial counts, then a top-n."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("first_place"))
    return counted.orderBy(F.desc("n"), "first_place").limit(n)


def allowed(rows: DataFrame, *filters: DataFrame) -> DataFrame:
    """Rows that are in every one of the filters, each a frame of the columns that it restricts."""
    return reduce(lambda df, f: df.join(f.distinct(), f.columns, "left_semi"), filters, rows)


def labelled(reasons: Column) -> Column:
    """Reasons as they are shown; those without a label stay."""
    return F.transform(reasons, lambda r: T.mapped(r, V.REASON_LABELS))
