"""Queries of ranking and of learning-to-rank data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import behaviour as H
from spindrift.operators import dataset as D
from spindrift.operators import ranking as R
from spindrift.operators import retrieval as S
from spindrift.plans import bindings as B
from spindrift.plans import search as Q
from spindrift.plans.registry import query
from spindrift.session import table

W = B.with_sql

PROFILE = f"""{B.ITEMS}, {B.PURCHASES},
seen AS (SELECT p.user_id, i.category, i.supplier, p.item_id, p.order_id FROM purchases p JOIN items i ON p.item_id = i.item_id),
cats AS (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(order_id), category) AS r FROM seen GROUP BY 1, 2 QUALIFY r <= 3),
sups AS (SELECT user_id, supplier, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(order_id), supplier) AS r FROM seen WHERE supplier IS NOT NULL GROUP BY 1, 2 QUALIFY r <= 6),
profile AS (SELECT user_id, (SELECT list(category ORDER BY r) FROM cats c WHERE c.user_id = u.user_id) AS top_categories, (SELECT list(supplier ORDER BY r) FROM sups s WHERE s.user_id = u.user_id) AS top_suppliers FROM (SELECT DISTINCT user_id FROM seen) u)"""


def profiles(spark, sf):
    seen = B.purchases(spark, sf).join(B.items(spark, sf).select("item_id", "category", "supplier"), "item_id")
    cats = R.most_common(seen, ["user_id"], "category", "order_id", 3, "top_categories")
    return cats.join(R.most_common(seen, ["user_id"], "supplier", "order_id", 6, "top_suppliers"), "user_id", "left")


@query(W(PROFILE) + "SELECT user_id, array_to_string(top_categories, ',') AS top_categories, array_to_string(top_suppliers, ',') AS top_suppliers FROM profile")
def user_profiles(spark, sf):
    return profiles(spark, sf).select("user_id", F.array_join("top_categories", ",").alias("top_categories"), F.array_join("top_suppliers", ",").alias("top_suppliers"))


@query("""WITH a AS (SELECT user_id, item_id, max(ts) AS seen_at FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS item_id, ts FROM events) GROUP BY 1, 2),
old AS (SELECT user_id, list(item_id ORDER BY seen_at, item_id)[:8] AS old FROM a GROUP BY 1),
new AS (SELECT user_id, list(item_id ORDER BY seen_at DESC, item_id)[:6] AS new FROM a GROUP BY 1)
SELECT user_id, array_to_string((list_reverse(list_filter(new, lambda x: NOT list_contains(old, x))) || old)[:12], ',') AS merged FROM old JOIN new USING (user_id)""")
def profile_merge(spark, sf):
    last = B.event_log(spark, sf).groupBy("user_id", "item_id").agg(F.max("ts").alias("at"))
    both = R.end_values(last, ["user_id"], "item_id", "at", 8, "old", last=False).join(R.end_values(last, ["user_id"], "item_id", "at", 6, "new"), "user_id")
    return both.select("user_id", F.array_join(R.prepend(F.col("old"), F.col("new"), 12), ",").alias("merged"))


def candidates(spark, sf):
    """The asked queries' best parts with what the rule score needs, for the profile of user 7."""
    items = B.items(spark, sf).select(F.col("item_id").alias("doc_id"), F.lower("title").alias("title"), F.lower("description").alias("description"), F.lower(F.concat_ws(" ", "brand", F.col("size").cast("string"))).alias("attributes"), "category", "supplier", "price")
    flags = Q.structured_pairs(spark, sf, 50).select("query_id", "doc_id", F.least(F.round(F.col("bm25") / 20, 4), F.lit(1.0)).alias("retrieval"), "attribute_overlap", "brand_match", "numeric_match", "category_match")
    wanted = Q.asked(spark).select("query_id", T.normalize(F.col("q")).alias("query")).withColumn("terms", T.terms(F.col("query")))
    bought = B.purchases(spark, sf)
    org = bought.where("user_id = 7").select("org_id").distinct()
    popular = R.most_common(bought.join(F.broadcast(org), "org_id", "left_semi"), ["org_id"], "item_id", "order_id", 8, "popular_items").select("popular_items")
    seen = B.event_log(spark, sf).where("user_id = 7 AND item_id IS NOT NULL").groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    recent = R.end_values(seen, ["user_id"], "item_id", "at", 12, "recent_items").select("recent_items")
    lists = profiles(spark, sf).where("user_id = 7").select("top_categories", "top_suppliers")
    return flags.join(F.broadcast(wanted), "query_id").join(items, "doc_id").join(F.broadcast(lists)).join(F.broadcast(recent)).join(F.broadcast(popular))


def latin_sql(x: str) -> str:
    return f"list_filter({x}, lambda x: regexp_matches(x, '{Q.V.BRAND_PATTERN}') AND NOT list_contains({Q.V.GENERIC_LATIN + Q.V.SIZES}, x))"


def mixed_sql(x: str) -> str:
    return f"list_filter({x}, lambda x: regexp_matches(x, '^[a-zа-я0-9-]+$') AND regexp_matches(x, '[a-zа-я]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '{Q.V.PAPER_PATTERN}'))"


def sized_sql(x: str) -> str:
    return f"list_filter({x}, lambda x: list_contains({Q.V.SIZES}, x) OR regexp_matches(x, '{Q.V.PAPER_PATTERN}') OR regexp_matches(x, '{Q.V.DIMENSION_PATTERN}'))"


TITLE_TIERS = "CASE WHEN query = title THEN {0} WHEN starts_with(title, query) THEN {1} WHEN contains(title, query) THEN {2} WHEN contains(description, query) THEN {3} END"

RANKED = f"""{Q.ASKED_SQL}, {Q.bm25_sql(Q.PART_INDEX, Q.V.FIELD_WEIGHTS, Q.ASKED_TERMS)},
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scored QUALIFY r <= 50),
{PROFILE.replace(B.ITEMS + ", ", "")},
recent AS (SELECT list(item_id) AS recent FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS item_id FROM events WHERE user_id = 7 GROUP BY 1 HAVING item_id IS NOT NULL ORDER BY max((ts, event_id)) DESC LIMIT 12)),
popular AS (SELECT list(item_id) AS popular FROM (SELECT item_id FROM purchases WHERE org_id IN (SELECT org_id FROM purchases WHERE user_id = 7) GROUP BY 1 ORDER BY count(*) DESC, min(order_id), item_id LIMIT 8)),
c AS (SELECT f.query_id, f.doc_id, least(round(f.score / 20, 4), 1.0::DOUBLE) AS retrieval, {Q.norm_sql("q")} AS query, lower(title) AS title, lower(description) AS description, lower(brand || ' ' || size) AS attributes, category, supplier, price,
    {Q.terms_sql(Q.norm_sql("brand || ' ' || size"))} AS attribute_terms, {Q.words_sql(Q.norm_sql("title || ' ' || brand || ' ' || size || ' ' || category || ' ' || description"))} AS tokens, {Q.terms_sql(Q.norm_sql("title || ' ' || category"))} AS named
  FROM found f JOIN asked a ON f.query_id = a.query_id JOIN items i ON i.item_id = f.doc_id),
t AS (SELECT *, list_distinct({Q.terms_sql("query")}) AS terms, {Q.words_sql("query")} AS asked_tokens FROM c),
flagged AS (SELECT *, list_distinct({latin_sql("asked_tokens")} || {mixed_sql("asked_tokens")} || {sized_sql("asked_tokens")}) AS wanted, {latin_sql("asked_tokens")} AS brands FROM t),
marked AS (SELECT *, len(list_intersect(wanted, list_distinct(attribute_terms))) AS n_attributes, list_has_any(brands, {latin_sql("tokens")}) AS brand_match, false AS numeric_match,
    list_has_any(list_filter(terms, lambda x: NOT list_contains(wanted, x) AND NOT regexp_matches(x, '^[0-9]+$')), named) AS category_match FROM flagged),
parts AS (SELECT *, coalesce({TITLE_TIERS.format("0.75::DOUBLE", "0.6::DOUBLE", "0.45::DOUBLE", "0.22::DOUBLE")}, 0) AS tier, {TITLE_TIERS.format("'exact_title_match'", "'prefix_title_match'", "'partial_title_match'", "'description_match'")} AS tier_reason,
    len(list_filter(terms, lambda t: contains(title, t) OR contains(description, t) OR contains(attributes, t))) AS n_terms,
    coalesce(list_contains(top_categories, category), false) AS in_categories, coalesce(list_contains(recent, doc_id), false) AS in_recent, coalesce(list_contains(top_suppliers, supplier), false) AS in_suppliers, coalesce(list_contains(popular, doc_id), false) AS in_popular
  FROM marked, (SELECT * FROM profile WHERE user_id = 7), recent, popular),
base AS (SELECT *, round(1e-9::DOUBLE + tier + least(n_terms * 0.08::DOUBLE, 0.24::DOUBLE) + least(n_attributes * 0.035::DOUBLE, 0.14::DOUBLE) + CASE WHEN brand_match THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN numeric_match THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN category_match THEN 0.06::DOUBLE ELSE 0 END
  + least(retrieval * 0.55::DOUBLE, 0.55::DOUBLE) + CASE WHEN in_categories THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN in_recent THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN in_suppliers THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN in_popular THEN 0.08::DOUBLE ELSE 0 END, 4) AS score,
  list_filter([tier_reason, CASE WHEN n_terms > 0 THEN 'token_match' END, CASE WHEN n_attributes > 0 THEN 'attribute_match' END, CASE WHEN brand_match THEN 'brand_match' END, CASE WHEN numeric_match THEN 'numeric_constraint_match' END, CASE WHEN category_match THEN 'category_match' END, CASE WHEN retrieval > 0 THEN 'hybrid_retrieval' END,
    CASE WHEN in_categories THEN 'matches_purchase_history' END, CASE WHEN in_recent THEN 'recent_interaction' END, CASE WHEN in_suppliers THEN 'popular_supplier' END, CASE WHEN in_popular THEN 'popular_in_organization' END], lambda x: x IS NOT NULL) AS reasons
  FROM parts)"""


@query(W(RANKED) + "SELECT query_id, doc_id, score, array_to_string(reasons, ',') AS reasons, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM base")
def baseline_rank(spark, sf):
    scored = R.rule_score(candidates(spark, sf), fuzzy=False)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).select("query_id", "doc_id", "score", F.array_join("reasons", ",").alias("reasons"), "rank")


LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in Q.V.REASON_LABELS.items()) + "}"


@query(W(RANKED) + f"SELECT query_id, doc_id, array_to_string(list_transform(reasons, lambda r: coalesce({LABELS}[r], r)), ', ') AS labels FROM base")
def reason_labels(spark, sf):
    scored = R.rule_score(candidates(spark, sf), fuzzy=False)
    return scored.select("query_id", "doc_id", F.array_join(H.labelled(F.col("reasons")), ", ").alias("labels"))


@query()
def baseline_rank_fuzzy(spark, sf):
    return R.rule_score(candidates(spark, sf), fuzzy=True).select("query_id", "doc_id", "score", F.array_join("reasons", ",").alias("reasons"))


BLEND = RANKED + """,
p AS (SELECT query_id, doc_id, score AS baseline, retrieval, price AS prediction FROM base),
s AS (SELECT *, {p} AS sp, {b} AS sb, {r} AS sr FROM p),
blended AS (SELECT query_id, doc_id, baseline, round(0.7::DOUBLE * sp + 0.2::DOUBLE * sb + 0.1::DOUBLE * sr, 6) AS blended FROM s)""".replace(
    "{p}", "{prediction}").replace("{b}", "{baseline}").replace("{r}", "{retrieval}")
for _c in ("prediction", "baseline", "retrieval"):
    BLEND = BLEND.replace("{" + _c + "}", f"CASE WHEN max({_c}) OVER w > min({_c}) OVER w THEN ({_c} - min({_c}) OVER w) / (max({_c}) OVER w - min({_c}) OVER w) ELSE 0 END")
BLEND = BLEND.replace(" AS sr FROM p)", " AS sr FROM p WINDOW w AS (PARTITION BY query_id))")


def _blended(spark, sf):
    scored = R.rule_score(candidates(spark, sf), fuzzy=False).select("query_id", "doc_id", F.col("score").alias("baseline"), "retrieval", F.col("price").alias("prediction"))
    return R.blend(scored, ["query_id"])


@query(W(BLEND) + "SELECT query_id, doc_id, blended FROM blended")
def minmax_blend(spark, sf):
    return _blended(spark, sf).select("query_id", "doc_id", "blended")


@query(W(BLEND) + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY baseline DESC, doc_id) AS rank_before, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, doc_id) AS rank_after FROM blended) SELECT query_id, doc_id, rank_before::INTEGER AS rank_before, rank_after::INTEGER AS rank_after, (rank_before - rank_after)::INTEGER AS moved, round(blended - baseline, 6) AS delta FROM r")
def rank_delta(spark, sf):
    return R.rank_change(_blended(spark, sf), ["query_id"], "baseline", "blended", "doc_id").select("query_id", "doc_id", "rank_before", "rank_after", "moved", "delta")


@query("WITH p AS (SELECT p_type AS category, p_partkey AS item_id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS place FROM part), s AS (SELECT *, CASE WHEN place <= 24 THEN place - 1 ELSE (item_id * 7919 + 13) % 24 END AS slot FROM p) SELECT category, slot::BIGINT AS slot, arg_max(item_id, place) AS item_id FROM s GROUP BY 1, 2")
def slot_sample(spark, sf):
    return D.slot_sample(table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("item_id")), "category", "item_id", 24)


@query(W(B.PURCHASES) + "SELECT org_id, order_id, item_id, quantity, (row_number() OVER (PARTITION BY org_id ORDER BY order_id, item_id, quantity))::INTEGER AS rank FROM purchases WHERE quantity >= 10 QUALIFY rank <= 60")
def org_cap(spark, sf):
    accepted = B.purchases(spark, sf).where("quantity >= 10").select("org_id", "order_id", "item_id", "quantity")
    return D.capped(accepted, ["org_id"], [F.col("order_id"), F.col("item_id"), F.col("quantity")], 60)


def catalog_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-zа-я0-9]+'), lambda t: length(t) > 1))"


#: Contracts are a twentieth of the parts, the stated query set, each with one of ten suppliers.
MATCH = f"""{B.ITEMS},
i AS (SELECT item_id, category, {catalog_sql("title")} AS words, {catalog_sql("category")} AS category_words, {catalog_sql("supplier")} AS supplier_words FROM items),
numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id) AS place FROM i),
slots AS (SELECT category, CASE WHEN place <= 24 THEN place - 1 ELSE (item_id * 7919 + 13) % 24 END AS slot, arg_max(item_id, place) AS item_id FROM numbered GROUP BY 1, 2),
samples AS (SELECT i.* FROM i JOIN slots USING (item_id)),
q AS (SELECT p_partkey AS query_id, {catalog_sql("p_name || ' ' || p_type")} AS asked, {catalog_sql("s_name")} AS asked_supplier FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 10 WHERE p_partkey % 20 = 0),
v AS (SELECT query_id, category, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, category) AS rank FROM (SELECT query_id, unnest(asked) AS word FROM q) JOIN (SELECT DISTINCT category, unnest(words) AS word FROM i) USING (word) GROUP BY 1, 2),
s AS (SELECT query_id, item_id, samples.category, votes, rank, len(list_intersect(asked, words)) AS shared, round(3.0::DOUBLE * len(list_intersect(asked, words)) + 1.4::DOUBLE * len(list_intersect(asked, category_words)) + 2.0::DOUBLE * len(list_intersect(asked_supplier, supplier_words))
  + CASE WHEN len(asked_supplier) > 0 AND list_sort(asked_supplier) = list_sort(supplier_words) THEN 4.0::DOUBLE ELSE 0 END, 4) AS score FROM v JOIN samples USING (category) JOIN q USING (query_id)),
best AS (SELECT * FROM s WHERE rank <= 8 AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) = 1),
c AS (SELECT query_id, item_id, category, shared, round(score + 0.25::DOUBLE * votes, 4) AS score FROM s WHERE rank <= 12)"""


def _match_parts(spark, sf):
    tokens = lambda *c: T.catalog_tokens(F.concat_ws(" ", *c))
    items = B.items(spark, sf).select("item_id", "category", tokens("title").alias("words"), tokens("category").alias("category_words"), tokens("supplier").alias("supplier_words"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    contracts = table(spark, sf, "part").where("p_partkey % 20 = 0")
    queries = contracts.join(suppliers, F.col("p_partkey") % 10 == F.col("s_suppkey"), "left").select(F.col("p_partkey").alias("query_id"), tokens("p_name", "p_type").alias("words"), tokens("s_name").alias("supplier_words"))
    return queries, items, D.slot_sample(items, "category", "item_id", 24)


@query(W(MATCH) + "SELECT query_id, category, votes, rank::INTEGER AS rank FROM v WHERE rank <= 8")
def category_votes(spark, sf):
    queries, items, _ = _match_parts(spark, sf)
    return D.token_votes(queries, items.select("category", "words"), 8)


@query(W(MATCH) + "SELECT query_id, item_id, category, score FROM best")
def match_contracts(spark, sf):
    return D.matches(D.sample_scores(*_match_parts(spark, sf), 8)).select("query_id", "item_id", "category", "score")


@query(W(MATCH) + "SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INTEGER AS rank FROM c QUALIFY rank <= 15")
def candidate_items(spark, sf):
    return D.candidate_items(D.sample_scores(*_match_parts(spark, sf), 12), 15).select("query_id", "item_id", "score", "rank")


@query(W(MATCH) + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c QUALIFY rank <= 15)
SELECT k.query_id, k.item_id, (CASE WHEN k.item_id = best.item_id THEN 3 WHEN k.category = best.category AND k.shared > 0 THEN 1 ELSE 0 END)::INTEGER AS label FROM k JOIN best USING (query_id)""")
def soft_labels(spark, sf):
    scored = D.sample_scores(*_match_parts(spark, sf), 12)
    best = D.matches(D.sample_scores(*_match_parts(spark, sf), 8)).select("query_id", F.col("item_id").alias("best"), F.col("category").alias("best_category"))
    pairs = D.candidate_items(scored, 15).join(best, "query_id")
    return pairs.select("query_id", "item_id", D.soft_label(F.col("item_id") == F.col("best"), F.col("category") == F.col("best_category"), F.col("shared")).alias("label"))


STARTED = "started AS (SELECT user_id, session, min(ts) AS started_at FROM sessions GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM started), placed AS (SELECT *, row_number() OVER (ORDER BY started_at, user_id, session) - 1 AS place FROM started)"


@query(W(B.SESSIONS, STARTED) + "SELECT user_id, session, started_at, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train' WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed, n")
def time_split(spark, sf):
    started = B.sessions(spark, sf).groupBy("user_id", "session").agg(F.min("ts").alias("started_at"))
    return D.time_split(started, ["user_id", "session"], "started_at")


@query(W(B.PURCHASES) + "SELECT CASE WHEN org_id > 20 THEN 'organisation' WHEN quantity < 5 THEN 'small' WHEN item_id % 3 = 0 THEN 'no_match' END AS reject_reason, count(*) AS n FROM purchases GROUP BY 1")
def gate_chain(spark, sf):
    steps = [("organisation", F.col("org_id") <= 20), ("small", F.col("quantity") >= 5), ("no_match", F.col("item_id") % 3 != 0)]
    return D.gates(B.purchases(spark, sf), steps).groupBy("reject_reason").agg(F.count("*").alias("n"))


FRAME = f"""{B.SESSIONS}, {B.ITEMS},
frame AS (SELECT s.user_id * 100000 + s.session AS group_id, s.item_id, CASE WHEN bool_or(event_type = 'purchase') THEN 3 WHEN bool_or(event_type = 'click') THEN 2 WHEN bool_or(event_type = 'view') THEN 1 ELSE 0 END AS label,
  round(avg(value), 6) AS value, any_value(price) AS price, length(any_value(title)) AS title_len, len(string_split(any_value(title), ' ')) AS title_words, any_value(size) AS size FROM sessions s JOIN items i ON s.item_id = i.item_id GROUP BY 1, 2)"""


def ltr_frame(spark, sf):
    rows = B.sessions(spark, sf).join(B.items(spark, sf).select("item_id", "title", "price", "size"), "item_id")
    has = lambda k: F.bool_or(F.col("event_type") == k)
    label = F.when(has("purchase"), 3).when(has("click"), 2).when(has("view"), 1).otherwise(0)
    return rows.groupBy((F.col("user_id") * 100000 + F.col("session")).alias("group_id"), "item_id").agg(label.alias("label"), F.round(F.avg("value"), 6).alias("value"), F.first("price").alias("price"), F.length(F.first("title")).alias("title_len"), F.size(F.split(F.first("title"), " ")).alias("title_words"), F.first("size").alias("size"))


@query(W(FRAME) + "SELECT group_id, item_id, label, value, price, title_len::INTEGER AS title_len, title_words::INTEGER AS title_words, size, (dense_rank() OVER (ORDER BY group_id) - 1)::BIGINT AS group_code FROM frame")
def ltr_features(spark, sf):
    frame = ltr_frame(spark, sf)
    codes = D.placed(frame.select("group_id").distinct(), ["group_id"]).select("group_id", F.col("place").alias("group_code"))
    return frame.join(codes, "group_id").select("group_id", "item_id", "label", "value", "price", "title_len", "title_words", "size", "group_code")


@query(W(FRAME) + """, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY value DESC, item_id) AS a, row_number() OVER (PARTITION BY group_id ORDER BY label DESC, item_id) AS b FROM frame),
h AS (SELECT *, CASE WHEN a <= 10 AND label >= 2 THEN 1 ELSE 0 END AS hit FROM r), p AS (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY group_id ORDER BY a ROWS UNBOUNDED PRECEDING) / a END AS precision FROM h),
e AS (SELECT group_id, sum(CASE WHEN a <= 10 THEN (pow(2, label) - 1) / log2(a + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN (pow(2, label) - 1) / log2(b + 1) ELSE 0 END) AS ideal, max(hit) AS hit, coalesce(max(CASE WHEN hit = 1 THEN 1.0::DOUBLE / a END), 0) AS rr, coalesce(avg(precision), 0) AS ap FROM p GROUP BY 1)
SELECT count(*) AS n_groups, round(coalesce(avg(CASE WHEN ideal > 0 THEN dcg / ideal END), 0), 6) AS ndcg, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM e""")
def ir_metrics(spark, sf):
    return R.metrics(ltr_frame(spark, sf), "group_id", "label", "value", "item_id", 10)


@query(W(B.EVENTS) + """, o AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM log),
f AS (SELECT user_id, list(item_id ORDER BY place) AS all_items FROM o GROUP BY 1)
SELECT user_id, array_to_string(list_reduce(list_prepend([]::BIGINT[], list_transform(all_items, lambda x: [x])), lambda kept, x: CASE WHEN list_contains(kept, x[1]) THEN kept ELSE (kept || x)[-5:] END), ',') AS recent FROM f""")
def recent_fifo(spark, sf):
    log = B.event_log(spark, sf).withColumn("place", F.struct("ts", "event_id"))
    return R.recent_distinct(log, ["user_id"], "item_id", "place", 5, "recent").select("user_id", F.array_join("recent", ",").alias("recent"))


@query()
def linear_ranker(spark, sf):
    frame = ltr_frame(spark, sf)
    model = D.linear_ranker(frame, ["value", "price", "title_len", "title_words", "size"], "label")
    return model.transform(frame).select("group_id", "item_id", "label", F.round("prediction", 6).alias("prediction"))
