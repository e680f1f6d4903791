"""Queries of catalogue and telemetry analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import catalog as C
from spindrift.operators import telemetry as M
from spindrift.plans import bindings as B
from spindrift.plans.registry import query
from spindrift.session import table

W = B.with_sql


@query("SELECT (SELECT count(*) FROM part) AS n_items, (SELECT count(DISTINCT p_type) FROM part) AS n_categories, (SELECT count(*) FROM supplier) AS n_suppliers, (SELECT count(*) FROM lineitem) AS n_purchases")
def catalog_summary(spark, sf):
    counts = [table(spark, sf, "part").agg(F.count("*").alias("n_items"), F.count_distinct("p_type").alias("n_categories")), table(spark, sf, "supplier").agg(F.count("*").alias("n_suppliers")), table(spark, sf, "lineitem").agg(F.count("*").alias("n_purchases"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


@query("SELECT count(*) AS n, max(o_orderdate) AS last_at FROM orders")
def catalog_signature(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_at"))


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_categories(spark, sf):
    return C.top_counts(table(spark, sf, "part").select(F.col("p_type").alias("category")), ["category"], 6)


@query("SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80")
def popular_items(spark, sf):
    return C.top_counts(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id")), ["item_id"], 80)


@query("SELECT s_suppkey AS supplier_id, s_name AS name, count(DISTINCT p_partkey) AS n_items, count(l_orderkey) AS n_sales FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def supplier_demand(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    joined = table(spark, sf, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, sf, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name")).agg(F.count_distinct("p_partkey").alias("n_items"), F.count("l_orderkey").alias("n_sales"))


SALES = "sales AS (SELECT l_suppkey AS supplier_id, p_type AS category, l_partkey AS item_id FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _sales(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("supplier_id"), F.col("p_type").alias("category"), F.col("l_partkey").alias("item_id"))


@query(W(SALES) + "SELECT supplier_id, count(DISTINCT item_id) AS n_items, count(*) AS n_sales FROM sales WHERE category IN (SELECT category FROM sales WHERE supplier_id = 1) AND supplier_id <> 1 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 6")
def supplier_competitors(spark, sf):
    return C.competitors(_sales(spark, sf), 1, 6)


@query(W(SALES) + "SELECT category, count(*) AS n_sales, count(DISTINCT supplier_id) AS n_suppliers FROM sales WHERE item_id NOT IN (SELECT item_id FROM sales WHERE supplier_id = 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def supplier_opportunities(spark, sf):
    sales = _sales(spark, sf)
    own = sales.where("supplier_id = 1").select("item_id").distinct()
    return sales.join(own, "item_id", "left_anti").groupBy("category").agg(F.count("*").alias("n_sales"), F.count_distinct("supplier_id").alias("n_suppliers")).orderBy(F.desc("n_sales"), "category").limit(6)


@query(W(B.ITEMS, B.PURCHASES) + "SELECT i.item_id, title, category, supplier, count(*) AS n_purchases, count(DISTINCT user_id) AS n_buyers FROM purchases p JOIN items i ON p.item_id = i.item_id WHERE supplier IS NOT NULL GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1 LIMIT 12")
def hot_items(spark, sf):
    bought = B.purchases(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_purchases"), F.count_distinct("user_id").alias("n_buyers"))
    return B.items(spark, sf).where("supplier IS NOT NULL").join(bought, "item_id").select("item_id", "title", "category", "supplier", "n_purchases", "n_buyers").orderBy(F.desc("n_purchases"), "item_id").limit(12)


FEED = f"""{B.PURCHASES},
fav AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM (SELECT DISTINCT json_extract_string(props, '$.k')::BIGINT AS item_id FROM events WHERE event_type = 'click' AND user_id = 7) QUALIFY place <= 18),
bought AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM (SELECT DISTINCT item_id FROM purchases WHERE user_id = 7) QUALIFY place <= 24),
popular AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS place FROM (SELECT item_id, count(*) AS n FROM purchases GROUP BY 1) QUALIFY place <= 80),
latest AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey DESC) AS place FROM part QUALIFY place <= 80),
every AS (SELECT *, 0 AS priority, 'favorite' AS reason FROM fav UNION ALL SELECT *, 1, 'purchased' FROM bought UNION ALL SELECT *, 2, 'popular' FROM popular UNION ALL SELECT *, 3, 'latest' FROM latest),
feed AS (SELECT item_id, arg_min(reason, priority * 1000 + place) AS reason, min(priority) AS priority, arg_min(place, priority * 1000 + place)::BIGINT AS place FROM every GROUP BY 1)"""


def _feed(spark, sf):
    ranked = lambda df, n, *order: df.orderBy(*order).limit(n).select("item_id", F.row_number().over(C.Window.orderBy(*order)).cast("long").alias("place"))  # noqa: E731  at most n rows
    bought = B.purchases(spark, sf)
    sources = [
        ("favorite", ranked(B.event_log(spark, sf).where("event_type = 'click' AND user_id = 7").select("item_id").distinct(), 18, "item_id")),
        ("purchased", ranked(bought.where("user_id = 7").select("item_id").distinct(), 24, "item_id")),
        ("popular", ranked(bought.groupBy("item_id").agg(F.count("*").alias("n")), 80, F.desc("n"), F.col("item_id"))),
        ("latest", ranked(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")), 80, F.desc("item_id"))),
    ]
    return C.priority_union(sources, "item_id")


@query(W(FEED) + "SELECT item_id, reason, priority, place FROM feed")
def feed_union(spark, sf):
    return _feed(spark, sf)


@query(W(FEED) + "SELECT item_id, reason, (SELECT count(*) FROM feed) AS total FROM feed ORDER BY priority, place, item_id LIMIT 9 OFFSET 18")
def feed_page(spark, sf):
    return C.page(_feed(spark, sf), 18, 9, F.col("priority"), F.col("place"), F.col("item_id")).select("item_id", "reason", "total")


RELATED = f"""{B.ITEMS},
w AS (SELECT item_id, category, supplier_id, list_distinct(string_split(lower(title), ' ')) AS words, list_distinct([lower(brand), size::VARCHAR]) AS attributes FROM items),
pairs AS (
  SELECT a.item_id AS probe_id, b.item_id, round(CASE WHEN a.category = b.category THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN a.supplier_id = b.supplier_id THEN 0.2::DOUBLE ELSE 0 END
         + least(len(list_intersect(a.words, b.words)) * 0.12::DOUBLE, 0.24::DOUBLE) + least(len(list_intersect(a.attributes, b.attributes)) * 0.1::DOUBLE, 0.2::DOUBLE), 4) AS score,
         array_to_string(list_filter([CASE WHEN a.category = b.category THEN 'same_category' END, CASE WHEN a.supplier_id = b.supplier_id THEN 'same_supplier' END, CASE WHEN list_has_any(a.words, b.words) THEN 'title_overlap' END, CASE WHEN list_has_any(a.attributes, b.attributes) THEN 'attribute_overlap' END], lambda r: r IS NOT NULL), ',') AS reasons
  FROM w a JOIN w b ON a.item_id <> b.item_id AND (a.category = b.category OR a.supplier_id = b.supplier_id) WHERE a.item_id IN (1, 2, 3, 5, 8))"""


@query(W(RELATED) + "SELECT probe_id, item_id, score, reasons, (row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, item_id))::INTEGER AS rank FROM pairs QUALIFY rank <= 6")
def related_items(spark, sf):
    items = B.items(spark, sf).withColumns({"words": F.array_distinct(F.split(F.lower("title"), " ")), "attributes": F.array_distinct(F.array(F.lower("brand"), F.col("size").cast("string")))})
    return C.related(items, spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8)], "item_id long"), 6)


@query(W(B.PURCHASES) + "SELECT user_id, order_id, item_id, quantity, bought_at FROM purchases WHERE user_id = 7 ORDER BY bought_at DESC, order_id, item_id, quantity LIMIT 20")
def recent_purchases(spark, sf):
    return B.purchases(spark, sf).where("user_id = 7").select("user_id", "order_id", "item_id", "quantity", "bought_at").orderBy(F.desc("bought_at"), "order_id", "item_id", "quantity").limit(20)


@query(W(B.ITEMS, B.PURCHASES) + "SELECT p.order_id, p.item_id, i.title, i.category FROM purchases p JOIN items i ON p.item_id = i.item_id")
def purchase_lookup(spark, sf):
    return B.purchases(spark, sf).join(B.items(spark, sf), "item_id").select("order_id", "item_id", "title", "category")


ENTRIES = "e AS (SELECT p_size AS set_id, p_partkey AS item_id, unnest([{'k': 'brand', 'v': p_brand}, {'k': 'type', 'v': p_type}, {'k': CASE WHEN p_partkey % 3 = 0 THEN 'name' ELSE 'size' END, 'v': p_name}]) AS a FROM part)"


@query(W(ENTRIES) + "SELECT set_id, a.k AS key, count(DISTINCT a.v) + CASE WHEN count(DISTINCT item_id) < any_value(n) THEN 1 ELSE 0 END AS n_values, count(DISTINCT a.v) + CASE WHEN count(DISTINCT item_id) < any_value(n) THEN 1 ELSE 0 END > 1 AS differs FROM e JOIN (SELECT set_id, count(DISTINCT item_id) AS n FROM e GROUP BY 1) USING (set_id) GROUP BY 1, 2")
def attr_compare(spark, sf):
    third = F.when(F.col("p_partkey") % 3 == 0, "name").otherwise("size")
    pair = lambda k, v: F.struct(k.alias("key"), F.col(v).alias("value"))
    entries = table(spark, sf, "part").select(F.col("p_size").alias("set_id"), F.col("p_partkey").alias("item_id"), F.inline(F.array(pair(F.lit("brand"), "p_brand"), pair(F.lit("type"), "p_type"), pair(third, "p_name"))))
    return C.differing_attributes(entries)


@query("SELECT l_returnflag AS flag, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_items, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def cart_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_items"), F.sum("l_quantity").alias("quantity"))


@query("""WITH o AS (SELECT n_nationkey AS left_id, unnest(string_split(lower(n_name || ' ' || r_name), ' ')) AS word FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT a.left_id, b.left_id AS right_id, count(*) AS overlap FROM (SELECT DISTINCT * FROM o) a JOIN (SELECT DISTINCT * FROM o) b ON a.word = b.word GROUP BY 1, 2)
SELECT left_id, right_id, overlap, (row_number() OVER (PARTITION BY left_id ORDER BY overlap DESC, right_id))::INTEGER AS rank FROM c QUALIFY rank <= 6""")
def name_overlap(spark, sf):
    regions = table(spark, sf, "region")
    names = table(spark, sf, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("left_id"), F.split(F.lower(F.concat_ws(" ", "n_name", "r_name")), " ").alias("words"))
    return C.overlapping(names, names.withColumnRenamed("left_id", "right_id"), 6)


@query(W(B.EVENTS) + """SELECT count_if(event_type = 'view') AS n_view, count_if(event_type = 'click') AS n_click, count_if(event_type = 'purchase') AS n_purchase, count_if(event_type = 'signup') AS n_signup, count_if(event_type = 'error') AS n_error,
round(count_if(event_type = 'click') / count_if(event_type = 'view'), 4) AS click_through_rate, round(count_if(event_type = 'purchase') / count_if(event_type = 'click'), 4) AS purchase_after_click, round(count_if(event_type = 'error') / count(*), 4) AS error_share FROM log""".replace("count_if(", "(count(*) FILTER (WHERE ").replace(") AS n_", ")) AS n_").replace("'click') / ", "'click'))::DOUBLE / ").replace("'purchase') / ", "'purchase'))::DOUBLE / ").replace("'error') / count(*)", "'error'))::DOUBLE / count(*)").replace("'view'), 4)", "'view')), 4)").replace("'click'), 4)", "'click')), 4)"))
def event_health(spark, sf):
    return M.health(B.event_log(spark, sf))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def event_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(W(B.EVENTS, B.PURCHASES) + """, u AS (SELECT user_id, item_id, event_type, value, ts FROM log UNION ALL SELECT user_id, item_id, 'purchase', NULL, bought_at FROM purchases)
SELECT user_id, item_id, count(*) FILTER (WHERE event_type = 'view') AS view_count, count(*) FILTER (WHERE event_type = 'click') AS click_count, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count, round(coalesce(avg(value), 0), 4) AS avg_value, max(ts) AS last_at FROM u WHERE item_id IS NOT NULL GROUP BY 1, 2""")
def user_item_features(spark, sf):
    return M.user_item_features(B.event_log(spark, sf), B.purchases(spark, sf).withColumnRenamed("bought_at", "ts"))


@query(W(B.SESSIONS) + "SELECT user_id, session, item_id, CASE WHEN bool_or(event_type = 'purchase') THEN 3 WHEN bool_or(event_type = 'click') THEN 2 WHEN bool_or(event_type = 'view') THEN 1 ELSE 0 END AS label FROM sessions GROUP BY 1, 2, 3")
def ltr_labels(spark, sf):
    return M.graded(B.sessions(spark, sf), ["user_id", "session", "item_id"])


@query(W(B.SESSIONS) + "SELECT user_id, session, count(*) AS n_events, min(ts) AS started_at, max(ts) AS ended_at FROM sessions GROUP BY 1, 2")
def sessionize(spark, sf):
    return B.sessions(spark, sf).groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


@query(W(B.SESSIONS) + "SELECT DISTINCT user_id, session FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM sessions v WHERE v.user_id = s.user_id AND v.session = s.session AND v.event_type = 'view')")
def sessions_no_impressions(spark, sf):
    found = B.sessions(spark, sf)
    return M.without(found.select("user_id", "session").distinct(), found.where("event_type = 'view'"), ["user_id", "session"])


@query(W(B.SESSIONS) + ", r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS before FROM sessions) SELECT event_id, before, coalesce(before <> event_type, false) AS refined FROM r")
def refined_queries(spark, sf):
    return M.refined(B.sessions(spark, sf)).select("event_id", "before", "refined")


@query(W(B.SESSIONS) + ", d AS (SELECT *, ((epoch_us(lead(ts) OVER (PARTITION BY user_id, session ORDER BY ts, event_id)) - epoch_us(ts)) // 1000)::BIGINT AS dwell_ms FROM sessions) SELECT event_id, dwell_ms, coalesce(dwell_ms < 3600000, false) AS quick_back FROM d WHERE event_type = 'view'")
def dwell(spark, sf):
    return M.dwell(B.sessions(spark, sf), 3_600_000).select("event_id", "dwell_ms", "quick_back")


@query(W(B.EVENTS, B.ITEMS) + "SELECT event_id, log.item_id, coalesce(category, '') AS category, supplier_id FROM log LEFT JOIN items ON log.item_id = items.item_id")
def enrich_events(spark, sf):
    return M.enrich(B.event_log(spark, sf), B.items(spark, sf)).select("event_id", "item_id", "category", "supplier_id")


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type = 'purchase' THEN 'order' WHEN event_type = 'signup' THEN 'account' ELSE 'other' END AS bucket, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1")
def activity_buckets(spark, sf):
    return table(spark, sf, "events").groupBy(M.bucket(F.col("event_type")).alias("bucket")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@query(W(B.EVENTS) + "SELECT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_type' WHEN item_id IS NULL THEN 'no_item' WHEN value < 0 OR value > 1e6 THEN 'value_range' END AS reject_reason, count(*) AS n FROM log GROUP BY 1")
def event_validation(spark, sf):
    return M.validated(B.event_log(spark, sf), ["view", "click", "purchase"]).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS user_id, o_orderkey IS NOT NULL AS has_order, coalesce(n, 0)::BIGINT AS n_lines FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def membership_flags(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("user_id"), F.col("n").isNotNull().alias("has_order"), F.coalesce("n", F.lit(0)).alias("n_lines"))
