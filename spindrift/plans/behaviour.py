"""Queries of recorded actions, their export and what is made of them.

The driver's event log has few types, so each event gets one of the recorded types (and a foreign one), a query, a position and a quantity by
its number: `actions` binds the log to the domain, it leaves no row out.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.operators import behaviour as H
from spindrift.operators import catalog as C
from spindrift.operators import ranking as R
from spindrift.operators import spelling as S
from spindrift.operators import telemetry as M
from spindrift.plans import bindings as B
from spindrift.plans import search as Q
from spindrift.plans.registry import query
from spindrift.session import table

W = B.with_sql

TYPES = [*V.EVENT_TYPES, "compare_viewed"]
TEXTS = [q for _, q in Q.ASKED]


def actions(spark, sf):
    n = F.col("event_id")
    kind = F.get(T.literal_array(TYPES), (n % len(TYPES)).cast("int"))
    asked = F.when(n % 7 != 0, F.get(T.literal_array(TEXTS), (F.floor(n / 3) % len(TEXTS)).cast("int")))
    named = {"event_type": kind, "query": asked, "rank_position": (n % 40).cast("int"), "results_page": (n % 40 / 9).cast("int"), "quantity": (n % 1100).cast("int"), "price": F.col("value") - 1, "dwell_ms": F.round(F.col("value") * 1000), "session_id": F.concat_ws("-", "user_id", "session")}
    return B.sessions(spark, sf).withColumns(named)


def texts_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ACTIONS = f"""{B.SESSIONS},
actions AS (
  SELECT * EXCLUDE (event_type), ({texts_sql(TYPES)})[event_id % {len(TYPES)} + 1] AS event_type,
         CASE WHEN event_id % 7 <> 0 THEN ({texts_sql(TEXTS)})[(event_id // 3) % {len(TEXTS)} + 1] END AS query,
         (event_id % 40)::INTEGER AS rank_position, ((event_id % 40) // 9)::INTEGER AS results_page, (event_id % 1100)::INTEGER AS quantity,
         value - 1 AS price, round(value * 1000) AS dwell_ms, user_id || '-' || session AS session_id FROM sessions)"""


def in_sql(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def case_sql(pairs) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


FILTER_SQL = "CASE " + " ".join(f"WHEN event_type IN {in_sql(v)} THEN '{k}'" for k, v in V.ACTIVITY_FILTERS.items()) + " ELSE 'all' END"


@query(W(ACTIONS, B.ITEMS) + f"""SELECT event_id, event_type, {FILTER_SQL} AS filter, coalesce({case_sql(V.PLAIN_TITLES)}, {case_sql(V.ITEM_TITLES)} || ': ' || coalesce(title, actions.item_id::VARCHAR, '{V.NO_ITEM}'),
  {case_sql(V.QUERY_TITLES)} || ' ' || CASE WHEN coalesce(query, '') <> '' THEN '«' || query || '»' ELSE '{V.NO_QUERY}' END) AS title
FROM actions LEFT JOIN items ON actions.item_id = items.item_id WHERE event_type IN {in_sql(H.ACTIVITY_TYPES)}""")
def activity_titles(spark, sf):
    return H.activity(actions(spark, sf), B.items(spark, sf))


@query(W(ACTIONS) + f"SELECT {FILTER_SQL} AS filter, count(*) AS n, max(ts) AS last_at FROM actions GROUP BY 1")
def activity_filters(spark, sf):
    return actions(spark, sf).groupBy(H.activity_filter(F.col("event_type")).alias("filter")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@query(W(ACTIONS) + f"""SELECT CASE WHEN event_type NOT IN {in_sql(V.EVENT_TYPES)} THEN 'event_type' WHEN quantity NOT BETWEEN 1 AND 999 THEN 'quantity' WHEN price < 0 THEN 'price' WHEN rank_position < 1 THEN 'rank_position' WHEN results_page < 1 THEN 'results_page' END AS reject_reason,
count(*) AS n, min(event_id) AS first_event FROM actions GROUP BY 1""")
def action_validation(spark, sf):
    return H.rejected(actions(spark, sf)).groupBy("reject_reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(W(ACTIONS) + """, n AS (SELECT *, sum(CASE WHEN event_type = 'search_submitted' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS search FROM actions),
s AS (SELECT user_id, session, search, min(event_id) FILTER (WHERE event_type = 'search_submitted') AS event_id, trim(coalesce(min(query) FILTER (WHERE event_type = 'search_submitted'), '')) AS query,
  count(*) FILTER (WHERE event_type NOT IN ('search_submitted', 'search_results_rendered', 'search_impression')) AS done FROM n WHERE search > 0 GROUP BY 1, 2, 3),
l AS (SELECT *, lead(query) OVER (PARTITION BY user_id, session ORDER BY search) AS next_query FROM s),
r AS (SELECT *, coalesce(query <> '' AND next_query <> '' AND query <> next_query, false) AS refined FROM l)
SELECT event_id, query, next_query, refined, refined AND done = 0 AS abandoned FROM r""")
def query_changes(spark, sf):
    return H.query_changes(actions(spark, sf))


@query(W(ACTIONS, B.PURCHASES) + f""", u AS (SELECT user_id, item_id, event_type, dwell_ms, ts FROM actions UNION ALL SELECT user_id, item_id, 'purchase_completed', NULL, bought_at FROM purchases)
SELECT user_id, item_id, {', '.join(f"count(*) FILTER (WHERE event_type = '{kind}') AS {name}" for name, kind in H.COUNTS.items())},
round(coalesce(avg(dwell_ms) FILTER (WHERE event_type = 'product_view_ended'), 0), 2) AS avg_dwell_ms, max(ts) AS last_action_at FROM u WHERE item_id IS NOT NULL GROUP BY 1, 2""")
def action_features(spark, sf):
    return H.user_item_features(actions(spark, sf), B.purchases(spark, sf).withColumnRenamed("bought_at", "ts"))


RELEVANCE = f"""{ACTIONS},
shown AS (SELECT session_id, item_id, rank_position AS position FROM actions WHERE event_type = 'search_impression' AND item_id IS NOT NULL),
asked_in AS (SELECT session_id, arg_min(query, (ts, event_id)) AS query FROM actions WHERE query IS NOT NULL GROUP BY 1),
flags AS (SELECT session_id, item_id, bool_or(event_type = 'result_clicked') AS clicked, bool_or(event_type IN {in_sql(V.VIEWED_TYPES)}) AS viewed, bool_or(event_type = 'purchase_completed') AS purchased, bool_or(event_type IN {in_sql(V.SHORTLIST_TYPES)}) AS listed
  FROM actions WHERE item_id IS NOT NULL GROUP BY 1, 2),
relevance AS (SELECT shown.session_id, shown.item_id, position, query, coalesce(clicked, false)::INTEGER AS clicked, coalesce(viewed, false)::INTEGER AS viewed, coalesce(purchased, false)::INTEGER AS purchased,
  (CASE WHEN purchased THEN 3 WHEN listed THEN 2 WHEN clicked OR viewed THEN 1 ELSE 0 END)::INTEGER AS label
  FROM shown JOIN asked_in USING (session_id) LEFT JOIN flags ON flags.session_id = shown.session_id AND flags.item_id = shown.item_id)"""


def relevance(spark, sf):
    acts = actions(spark, sf)
    shown = acts.where("event_type = 'search_impression' AND item_id IS NOT NULL").select("session_id", "item_id", F.col("rank_position").alias("position"))
    asked = acts.where("query IS NOT NULL").groupBy("session_id").agg(F.min_by("query", F.struct("ts", "event_id")).alias("query"))
    return H.relevance(shown, asked, acts)


@query(W(RELEVANCE) + "SELECT * FROM relevance")
def query_relevance(spark, sf):
    return relevance(spark, sf)


@query(W(RELEVANCE) + ", c AS (SELECT query, label, count(*) AS n FROM relevance GROUP BY 1, 2) SELECT query, label, n, round(n / sum(n) OVER (PARTITION BY query), 6) AS share FROM c")
def label_distribution(spark, sf):
    return H.label_shares(relevance(spark, sf), "query")


@query(W(RELEVANCE) + """, f AS (SELECT *, -(CASE WHEN position = 0 THEN 999 ELSE position END)::DOUBLE AS score FROM relevance),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id, position) AS a, row_number() OVER (PARTITION BY session_id ORDER BY label DESC, item_id, position) AS b FROM f),
h AS (SELECT *, CASE WHEN a <= 10 AND label >= 2 THEN 1 ELSE 0 END AS hit FROM r), p AS (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY session_id ORDER BY a ROWS UNBOUNDED PRECEDING) / a END AS precision FROM h),
e AS (SELECT session_id, sum(CASE WHEN a <= 10 THEN (pow(2, label) - 1) / log2(a + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN (pow(2, label) - 1) / log2(b + 1) ELSE 0 END) AS ideal, max(hit) AS hit, coalesce(max(CASE WHEN hit = 1 THEN 1.0::DOUBLE / a END), 0) AS rr, coalesce(avg(precision), 0) AS ap FROM p GROUP BY 1)
SELECT count(*) AS n_groups, round(coalesce(avg(CASE WHEN ideal > 0 THEN dcg / ideal END), 0), 6) AS ndcg, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM e""")
def position_baseline(spark, sf):
    """Ranking by position alone; a position that isn't known (0 here) is 999."""
    rows = relevance(spark, sf).withColumns({"score": R.position_score(F.when(F.col("position") > 0, F.col("position"))), "key": F.struct("item_id", "position")})
    return R.metrics(rows, "session_id", "label", "score", "key", 10)


@query(W(ACTIONS, B.PURCHASES) + """, last AS (SELECT session_id, user_id, min(ts) AS t FROM actions WHERE user_id = 7 GROUP BY 1, 2 ORDER BY t DESC, session_id LIMIT 20)
SELECT 'events' AS part, count(*) AS n, min(event_id) AS first_id FROM actions WHERE session_id IN (SELECT session_id FROM last)
UNION ALL SELECT 'purchases', count(*), min(order_id) FROM purchases WHERE user_id IN (SELECT user_id FROM last) AND org_id IN (SELECT org_id FROM purchases WHERE user_id = 7)""")
def export_scope(spark, sf):
    """What is exported for a user's 20 latest sessions: the sessions' events, and purchases of both the sessions' users and their organisations."""
    acts, bought = actions(spark, sf), B.purchases(spark, sf)
    last = acts.where("user_id = 7").groupBy("session_id", "user_id").agg(F.min("ts").alias("t")).orderBy(F.desc("t"), "session_id").limit(20)
    orgs = bought.where("user_id = 7").select("org_id")
    events = H.scope(acts, [("session_id", last), ("user_id", last)])
    purchases = H.scope(bought, [("user_id", last), ("org_id", orgs)], every=True)
    size = lambda df, part, key: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.min(key).alias("first_id"))
    return size(events, "events", "event_id").unionByName(size(purchases, "purchases", "order_id"))


@query(W(B.PURCHASES) + "SELECT user_id, org_id, count(*) AS n, min(order_id) AS first_place FROM purchases GROUP BY 1, 2 ORDER BY 3 DESC, 4 LIMIT 120")
def top_buyers(spark, sf):
    return H.most_frequent(B.purchases(spark, sf), ["user_id", "org_id"], "order_id", 120)


@query(W(B.PURCHASES) + "SELECT user_id, count(*) AS n_purchases, count(DISTINCT order_id) AS n_orders, count(DISTINCT item_id) AS n_items, round(sum(amount), 2) AS amount FROM purchases GROUP BY 1")
def user_counts(spark, sf):
    return B.purchases(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_purchases"), F.count_distinct("order_id").alias("n_orders"), F.count_distinct("item_id").alias("n_items"), F.round(F.sum("amount"), 2).alias("amount"))


@query(W(ACTIONS, B.ITEMS) + ", r AS (SELECT user_id, log.item_id, title, category, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM actions log JOIN items ON log.item_id = items.item_id WHERE event_type IN ('result_clicked', 'result_opened', 'product_view_started')) SELECT user_id, item_id, title, category, ts, rank::INTEGER AS rank FROM r WHERE rank <= 8")
def recent_views(spark, sf):
    seen = actions(spark, sf).where(F.col("event_type").isin("result_clicked", "result_opened", "product_view_started")).select("user_id", "item_id", "ts", "event_id")
    return C.top_per_group(seen.join(B.items(spark, sf), "item_id"), ["user_id"], [F.desc("ts"), F.col("event_id")], 8).select("user_id", "item_id", "title", "category", "ts", "rank")


COLLECTIONS = f"""{ACTIONS},
held AS (SELECT user_id, item_id, kind, priority, max(ts) AS last_at FROM (
  SELECT user_id, item_id, ts, 'favorite' AS kind, 0 AS priority FROM actions WHERE event_type = 'favorite_added' UNION ALL
  SELECT user_id, item_id, ts, 'compare', 1 FROM actions WHERE event_type = 'comparison_added' UNION ALL
  SELECT user_id, item_id, ts, 'cart', 2 FROM actions WHERE event_type = 'cart_added') WHERE item_id IS NOT NULL GROUP BY 1, 2, 3, 4),
placed_in AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY last_at DESC, item_id) AS place FROM held),
one AS (SELECT user_id, item_id, min(priority * 1000000 + place) AS o FROM placed_in GROUP BY 1, 2)"""


@query(W(COLLECTIONS, B.ITEMS) + ", r AS (SELECT user_id, one.item_id, title, (['favorite', 'compare', 'cart'])[(o // 1000000)::INTEGER + 1] AS kind, row_number() OVER (PARTITION BY user_id ORDER BY o, one.item_id) AS rank FROM one JOIN items ON one.item_id = items.item_id) SELECT user_id, item_id, title, kind, rank::INTEGER AS rank FROM r WHERE rank <= 8")
def collection_items(spark, sf):
    """Each user's favourites, compared and carted items, newest first, an item once, eight in all."""
    acts = actions(spark, sf)
    kinds = ["favorite_added", "comparison_added", "cart_added"]
    held = acts.where(F.col("event_type").isin(kinds) & F.col("item_id").isNotNull()).groupBy("user_id", "item_id", (F.array_position(T.literal_array(kinds), F.col("event_type")) - 1).alias("priority")).agg(F.max("ts").alias("at"))
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "priority").orderBy(F.desc("at"), "item_id")))
    one = placed.groupBy("user_id", "item_id").agg(F.min(F.struct("priority", "place")).alias("o")).join(B.items(spark, sf).select("item_id", "title"), "item_id")
    ranked = C.top_per_group(one, ["user_id"], [F.col("o"), F.col("item_id")], 8)
    return ranked.select("user_id", "item_id", "title", F.get(T.literal_array(["favorite", "compare", "cart"]), F.col("o.priority").cast("int")).alias("kind"), "rank")


@query(W(ACTIONS) + """, h AS (SELECT user_id, query AS label, 0 AS priority, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, query) AS place FROM actions WHERE query IS NOT NULL GROUP BY 1, 2),
g AS (SELECT DISTINCT user_id, p_type AS label, 1 AS priority, dense_rank() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT user_id FROM actions), (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3)),
u AS (SELECT user_id, label, min(priority * 1000 + place) AS o FROM (SELECT * FROM h UNION ALL SELECT * FROM g) GROUP BY 1, 2)
SELECT user_id, label, (row_number() OVER (PARTITION BY user_id ORDER BY o, label))::INTEGER AS rank FROM u QUALIFY rank <= 6""")
def search_chips(spark, sf):
    """Each user's queries, newest first, then suggestions, distinct, the first six."""
    asked = actions(spark, sf).where("query IS NOT NULL").groupBy("user_id", F.col("query").alias("label")).agg(F.max("ts").alias("last"))
    own = asked.withColumns({"priority": F.lit(0), "place": F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "label"))}).drop("last")
    some = table(spark, sf, "part").select(F.col("p_type").alias("label")).distinct().orderBy("label").limit(3)
    given = some.withColumns({"priority": F.lit(1), "place": F.row_number().over(Window.orderBy("label"))})  # three rows
    every = own.unionByName(asked.select("user_id").distinct().join(F.broadcast(given)))
    one = every.groupBy("user_id", "label").agg(F.min(F.struct("priority", "place")).alias("o"))
    return C.top_per_group(one, ["user_id"], [F.col("o"), F.col("label")], 6).select("user_id", "label", "rank")


@query(W(B.ITEMS) + "SELECT item_id, title FROM items WHERE category IN ('STANDARD', 'ECONOMY', 'PROMO') AND supplier_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND item_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 10)")
def filtered_items(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("STANDARD", "ECONOMY", "PROMO")], "category string")
    suppliers = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier_id"))
    bought = table(spark, sf, "lineitem").where("l_quantity >= 10").select(F.col("l_partkey").alias("item_id"))
    return H.allowed(B.items(spark, sf), F.broadcast(kinds), suppliers, bought).select("item_id", "title")


@query("SELECT p_partkey AS item_id, p_name AS title FROM part ORDER BY p_partkey DESC, p_name LIMIT 50")
def newest_items(spark, sf):
    """What an empty query gives: the newest items (the largest keys, as parts have no time), then titles."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")).orderBy(F.desc("item_id"), "title").limit(50)


@query("SELECT 'category' AS kind, p_type AS name, (row_number() OVER (ORDER BY p_type))::INTEGER AS rank FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'region', r_name, (row_number() OVER (ORDER BY r_name))::INTEGER FROM region")
def dimension_lists(spark, sf):
    ordered = lambda df, kind: df.select(F.lit(kind).alias("kind"), "name", F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy("name")).alias("rank"))  # noqa: E731  a small dimension
    return ordered(table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct(), "category").unionByName(ordered(table(spark, sf, "region").select(F.col("r_name").alias("name")), "region"))


@query(W(B.ITEMS, f"""w AS (SELECT item_id, category, list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || category), '[0-9a-zа-яё]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$'))) AS words FROM items),
c AS (SELECT unnest(words) AS token, count(*) AS n, count(DISTINCT category) AS n_categories FROM w GROUP BY 1)""") + "SELECT token, n, n_categories FROM c WHERE n >= CASE WHEN (SELECT count(*) FROM items) < 25 THEN 1 ELSE 2 END")
def item_vocabulary(spark, sf):
    """Tokens of titles and categories with the items and categories that have them, those of one item left out unless there are few items."""
    items = B.items(spark, sf)
    least = F.when(F.col("n_items") < 25, 1).otherwise(2)
    words = items.select("category", F.explode(F.array_distinct(T.spelling_tokens(F.concat_ws(" ", "title", "category")))).alias("token"))
    counted = words.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("category").alias("n_categories"))
    return counted.join(F.broadcast(items.agg(F.count("*").alias("n_items")))).where(F.col("n") >= least).select("token", "n", "n_categories")


SPELLED, SYNONYMS = [("bollt", "bolt"), ("stel", "steel"), ("smal gear", "small gear")], [("red", "blue"), ("gear", "small")]


@query(W(B.ITEMS) + f"""SELECT DISTINCT token FROM (
SELECT unnest(list_filter(regexp_extract_all(lower(t), '[0-9a-zа-яё]+'), lambda t: length(t) >= 3)) AS token FROM (SELECT unnest({texts_sql([x for p in SPELLED + SYNONYMS for x in p])}) AS t)
UNION ALL SELECT token FROM (SELECT token, count(*) AS n FROM (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[0-9a-zа-яё]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')))) AS token FROM items) GROUP BY 1) WHERE n >= 2)""")
def spell_vocabulary(spark, sf):
    """The words that spelling may correct to: those of known corrections, of synonyms, and of several titles."""
    pairs = [spark.createDataFrame(x, "a string, b string") for x in (SPELLED, SYNONYMS)]
    return S.vocabulary_of(B.items(spark, sf).select(T.spelling_tokens(F.col("title")).alias("words")), pairs, 2).select("token")


NAME_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-zа-я0-9]+'), lambda t: length(t) > 2 AND t NOT IN {in_sql(V.NAME_STOP_WORDS)}))"


@query(f"""WITH a AS (SELECT s_suppkey AS supplier_id, {NAME_WORDS.format("s_name")} AS w FROM supplier), o AS (SELECT c_custkey AS org_id, {NAME_WORDS.format("replace(c_name, 'Customer', 'Supplier')")} AS w FROM customer)
SELECT org_id, supplier_id, len(list_intersect(o.w, a.w)) AS overlap FROM o JOIN a ON list_has_any(list_filter(o.w, lambda t: t <> 'supplier'), list_filter(a.w, lambda t: t <> 'supplier'))""")
def supplier_names(spark, sf):
    """Suppliers that share a word of their name with an organisation, besides the one that all names have."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), T.name_tokens(F.col("s_name")).alias("w"))
    orgs = table(spark, sf, "customer").select(F.col("c_custkey").alias("org_id"), T.name_tokens(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("ow"))
    words = lambda df, c: df.withColumn("word", F.explode(F.array_remove(c, "supplier")))
    return words(orgs, "ow").join(words(suppliers, "w"), "word").select("org_id", "supplier_id", F.size(F.array_intersect("ow", "w")).cast("long").alias("overlap")).distinct()


@query(W(ACTIONS) + "SELECT session_id, user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'search_impression') AS n_impressions, greatest(0, count(DISTINCT query) - count(*) FILTER (WHERE event_type = 'search_impression')) AS missing FROM actions GROUP BY 1, 2")
def session_impressions(spark, sf):
    found = actions(spark, sf).groupBy("session_id", "user_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "search_impression").alias("n_impressions"), F.count_distinct("query").alias("__q"))
    return found.select("session_id", "user_id", "n_events", "n_impressions", F.greatest(F.lit(0), F.col("__q") - F.col("n_impressions")).alias("missing"))


@query(W(ACTIONS) + "SELECT round(count(*) FILTER (WHERE event_type = 'result_clicked')::DOUBLE / count(*) FILTER (WHERE event_type = 'search_impression'), 4) AS ctr, round(count(*) FILTER (WHERE event_type = 'result_opened')::DOUBLE / count(*) FILTER (WHERE event_type = 'result_clicked'), 4) AS open_after_click, round(count(*) FILTER (WHERE event_type = 'purchase_completed')::DOUBLE / count(*) FILTER (WHERE event_type = 'purchase_intent'), 4) AS purchase_after_intent FROM actions")
def action_ratios(spark, sf):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return actions(spark, sf).agg(M.ratio(n("result_clicked"), n("search_impression")).alias("ctr"), M.ratio(n("result_opened"), n("result_clicked")).alias("open_after_click"), M.ratio(n("purchase_completed"), n("purchase_intent")).alias("purchase_after_intent"))


@query(W(B.ITEMS) + "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || coalesce(supplier, '')), '[a-zа-я0-9]+'), lambda t: length(t) > 1))), ',') AS catalog, array_to_string(regexp_extract_all(trim(regexp_replace(replace(lower(description), 'ё', 'е'), '\\s+', ' ', 'g')), '[0-9a-zа-яё]+'), ',') AS plain FROM items")
def catalog_tokens(spark, sf):
    items = B.items(spark, sf)
    return items.select("item_id", F.array_join(F.array_sort(T.catalog_tokens(F.concat_ws(" ", "title", F.coalesce("supplier", F.lit(""))))), ",").alias("catalog"), F.array_join(T.plain_terms(T.plain(F.col("description"))), ",").alias("plain"))
