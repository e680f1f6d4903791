"""Queries of the ranker's features."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.operators import features as X
from spindrift.operators import ranking as R
from spindrift.operators import retrieval as S
from spindrift.plans import behaviour as A
from spindrift.plans import bindings as B
from spindrift.plans import learning as L
from spindrift.plans import search as Q
from spindrift.plans.registry import query

W = B.with_sql


def ranker_rows(spark, sf):
    """Relevance rows with the item, the profiles of the user and the organisation, and what retrieval says of the pair."""
    found = S.top(Q.part_bm25(spark, sf), 60).join(F.broadcast(Q.asked(spark)), "query_id").select(F.col("q").alias("query"), F.col("doc_id").alias("item_id"), F.lit(1.0).alias("retrieval_bm25"), F.lit(1.0).alias("retrieval_channel_count"), F.col("score").alias("channel_score_bm25"), F.col("rank").alias("channel_rank_bm25"), F.least(F.round(F.col("score") / 20, 4), F.lit(1.0)).alias("retrieval_score"))
    rows = A.relevance(spark, sf).withColumn("user_id", F.split("session_id", "-")[0].cast("long"))
    items = B.items(spark, sf).select("item_id", F.col("title").alias("item_title"), F.col("description").alias("item_description"), F.col("category").alias("item_category_name"), F.col("category").alias("item_category_id"), F.col("supplier").alias("item_supplier_name"), F.col("supplier_id").alias("item_supplier_id"), F.lit("active").alias("item_status"), F.array("brand", F.col("size").cast("string")).alias("attribute_values"))
    joined = rows.join(found, ["query", "item_id"], "left").join(items, "item_id").join(profiles(spark, sf), "user_id", "left")
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in X.LISTS}
    return joined.withColumn("normalized_query", T.normalize(F.col("query"))).withColumns(lists)


def profiles(spark, sf):
    """For each user the lists that features look in, as texts; those of the organisation are joined from its purchases."""
    bought = B.purchases(spark, sf).join(B.items(spark, sf).select("item_id", "category", "supplier"), "item_id")
    common = lambda rows, by, value, place, k, out: R.most_common(rows, [by], value, place, k, out).withColumn(out, F.transform(out, lambda x: x.cast("string")))
    acts = A.actions(spark, sf)
    recent = acts.where("item_id IS NOT NULL").groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    own = common(acts.where("query IS NOT NULL"), "user_id", "query", "event_id", 8, "user_popular_queries")
    own = own.join(common(bought, "user_id", "category", "order_id", 3, "user_top_categories"), "user_id", "left").join(common(bought, "user_id", "supplier", "order_id", 6, "user_top_suppliers"), "user_id", "left")
    own = own.join(R.end_values(recent, ["user_id"], "item_id", "at", 12, "user_recent_items").withColumn("user_recent_items", F.transform("user_recent_items", lambda x: x.cast("string"))), "user_id", "left")
    orgs = common(bought, "org_id", "category", "order_id", 3, "org_top_categories").join(common(bought, "org_id", "item_id", "order_id", 8, "org_popular_items"), "org_id")
    return own.join(bought.select("user_id", "org_id").distinct(), "user_id", "left").join(orgs, "org_id", "left").drop("org_id")


def plain_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '\\s+', ' ', 'g'))"


def top_sql(name: str, by: str, value: str, k: int, source: str) -> str:
    return f"{name} AS (SELECT {by}, list({value}::VARCHAR ORDER BY r) AS l FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, f, {value}) AS r FROM (SELECT {by}, {value}, count(*) AS n, min(place) AS f FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2) QUALIFY r <= {k}) GROUP BY 1)"


PROFILES = ",\n".join([
    "bought AS (SELECT p.user_id, p.org_id, p.item_id, i.category, i.supplier, p.order_id AS place FROM purchases p JOIN items i ON p.item_id = i.item_id)",
    "asked_by AS (SELECT user_id, query, event_id AS place FROM actions)",
    top_sql("own_queries", "user_id", "query", 8, "asked_by"), top_sql("own_categories", "user_id", "category", 3, "bought"), top_sql("own_suppliers", "user_id", "supplier", 6, "bought"),
    top_sql("org_categories", "org_id", "category", 3, "bought"), top_sql("org_items", "org_id", "item_id", 8, "bought"),
    "recent AS (SELECT user_id, list(item_id::VARCHAR) AS l FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY max((ts, event_id)) DESC) AS r FROM actions WHERE item_id IS NOT NULL GROUP BY 1, 2 QUALIFY r <= 12) GROUP BY 1)",
    "member_of AS (SELECT DISTINCT user_id, org_id FROM bought)",
])

FRAME = f"""{A.RELEVANCE}, {B.ITEMS}, {B.PURCHASES}, {Q.ASKED_SQL}, {Q.bm25_sql(Q.PART_INDEX, V.FIELD_WEIGHTS, Q.ASKED_TERMS).replace(B.ITEMS + "," + chr(10), "")},
hits AS (SELECT q AS query, doc_id AS item_id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) AS rank FROM scored s JOIN asked ON asked.query_id = s.query_id QUALIFY rank <= 60),
{PROFILES},
r AS (SELECT r.*, split_part(r.session_id, '-', 1)::BIGINT AS user_id, h.score, h.rank, {Q.norm_sql("r.query")} AS normalized_query, i.title, i.description, i.category, i.supplier, i.supplier_id, [i.brand, i.size::VARCHAR] AS vals
  FROM relevance r JOIN items i ON i.item_id = r.item_id LEFT JOIN hits h ON h.query = r.query AND h.item_id = r.item_id),
p AS (SELECT r.*, {plain_sql("r.query")} AS qp, {plain_sql("normalized_query")} AS np, {plain_sql("title")} AS tp, {plain_sql("description")} AS dp, {plain_sql("array_to_string(vals, ' ')")} AS ap,
  own_queries.l AS queries, own_categories.l AS cats, own_suppliers.l AS sups, recent.l AS recent, org_categories.l AS org_cats, org_items.l AS org_items
  FROM r LEFT JOIN own_queries ON own_queries.user_id = r.user_id LEFT JOIN own_categories ON own_categories.user_id = r.user_id LEFT JOIN own_suppliers ON own_suppliers.user_id = r.user_id LEFT JOIN recent ON recent.user_id = r.user_id
  LEFT JOIN member_of m ON m.user_id = r.user_id LEFT JOIN org_categories ON org_categories.org_id = m.org_id LEFT JOIN org_items ON org_items.org_id = m.org_id)"""


def shared_sql(x: str) -> str:
    return f"len(list_intersect(list_distinct(regexp_extract_all(np, '[0-9a-zа-яё]+')), list_distinct(regexp_extract_all({x}, '[0-9a-zа-яё]+'))))"


def in_list_sql(values: str, x: str) -> str:
    return f"coalesce(list_contains(list_transform({values}, lambda v: {plain_sql('v')}), {x}), false) AND {x} <> ''"


FEATURES = {
    "query_len": "len(list_filter(string_split(qp, ' '), lambda w: w <> ''))",
    "normalized_query_len": "len(list_filter(string_split(np, ' '), lambda w: w <> ''))",
    "position_num": "coalesce(position, 999)",
    "query_has_correction": "qp <> np",
    "query_has_digits": "regexp_matches(np, '[0-9]')",
    "query_has_synonyms": "0",
    "cat_match_user": in_list_sql("cats", plain_sql("category")),
    "cat_match_org": in_list_sql("org_cats", plain_sql("category")),
    "supplier_match_user": in_list_sql("sups", plain_sql("supplier")),
    "is_recent_ste": in_list_sql("recent", "item_id::VARCHAR"),
    "is_popular_ste_org": in_list_sql("org_items", "item_id::VARCHAR"),
    "query_in_history": f"({in_list_sql('queries', 'np')}) OR ({in_list_sql('queries', 'qp')})",
    "title_term_overlap": shared_sql("tp"),
    "description_term_overlap": shared_sql("dp"),
    "attribute_term_overlap": shared_sql("ap"),
    "total_term_overlap": " + ".join(shared_sql(x) for x in ("tp", "dp", "ap")),
    "title_exact_match": "tp = np",
    "title_prefix_match": "np <> '' AND starts_with(tp, np)",
    "title_partial_match": "np <> '' AND contains(tp, np)",
    "description_contains_query": "np <> '' AND contains(dp, np)",
    "attribute_value_count": "len(vals)",
    "title_len_chars": "length(title)",
    "description_len_chars": "length(description)",
}
FOUND = {
    "retrieval_bm25": "CASE WHEN score IS NULL THEN 0 ELSE 1 END",
    "retrieval_channel_count": "CASE WHEN score IS NULL THEN 0 ELSE 1 END",
    "channel_score_bm25": "coalesce(score, 0)",
    "channel_rank_bm25": "coalesce(rank, 0)",
    "retrieval_score": "CASE WHEN score IS NULL THEN 0 ELSE least(round(score / 20, 4), 1.0::DOUBLE) END",
}
CATEGORIES = {"item_category_id": "category", "item_category_name": "category", "item_supplier_id": "supplier_id::VARCHAR", "item_supplier_name": "supplier", "item_status": "'active'"}
FRAME_COLUMNS = ", ".join([f"({v})::DOUBLE AS {k}" for k, v in (FEATURES | {c: FOUND.get(c, "0") for c in X.RETRIEVAL}).items()] + [f"coalesce({v}, '') AS {k}" for k, v in CATEGORIES.items()])


@query(W(FRAME) + f"SELECT session_id, item_id, label::DOUBLE AS label, {FRAME_COLUMNS} FROM p")
def training_features(spark, sf):
    return X.training_features(ranker_rows(spark, sf)).select("session_id", "item_id", "label", *X.NUMERIC, *X.CATEGORICAL)


@query(W(FRAME) + f"SELECT label, count(*) AS n, {', '.join(f'round(avg(({v})::DOUBLE), 6) AS {k}' for k, v in FEATURES.items())} FROM p GROUP BY 1")
def feature_means(spark, sf):
    """Means of the query's, the item's and the user's features by label."""
    frame = X.training_features(ranker_rows(spark, sf))
    return frame.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in X.OWN])


@query(W(A.RELEVANCE, Q.ASKED_SQL, Q.bm25_sql(Q.PART_INDEX, V.FIELD_WEIGHTS, Q.ASKED_TERMS)) + """, allowed AS (SELECT DISTINCT session_id, item_id, query FROM relevance)
SELECT session_id, item_id, score, (row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id))::INTEGER AS rank FROM allowed JOIN asked ON q = allowed.query JOIN scored ON scored.query_id = asked.query_id AND doc_id = item_id""")
def session_retrieval(spark, sf):
    """Retrieval over what each session has been shown: scores of its query, with statistics of the whole index, ranked within the session."""
    allowed = A.relevance(spark, sf).select("session_id", "item_id", "query").distinct()
    hits = Q.part_bm25(spark, sf).join(F.broadcast(Q.asked(spark)), "query_id").select(F.col("q").alias("query"), F.col("doc_id").alias("item_id"), "score")
    found = allowed.join(hits, ["query", "item_id"])
    return found.withColumn("rank", F.row_number().over(S.Window.partitionBy("session_id").orderBy(F.desc("score"), "item_id"))).select("session_id", "item_id", "score", "rank")


SERVED = {
    "position_num": "rank", "query_len": "len(string_split(query, ' '))", "baseline_score": "score", "retrieval_score": "retrieval", "query_term_count": "len(terms)",
    "title_exact_match": "title = query", "title_prefix_match": "starts_with(title, query)", "title_partial_match": "contains(title, query)", "description_contains_query": "contains(description, query)",
    "cat_match_user": "in_categories", "supplier_match_user": "in_suppliers", "is_recent_ste": "in_recent", "query_has_digits": "0", "is_popular_ste_org": "0", "attribute_overlap_count": "n_attributes", "brand_match_flag": "brand_match", "category_match_flag": "category_match",
    "title_len_chars": "length(title)", "description_len_chars": "length(description)", "reason_token_match": "n_terms > 0", "reason_matches_purchase_history": "in_categories", "reason_popular_in_organization": "in_popular",
}


@query(W(L.RANKED) + f", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM base) SELECT query_id, doc_id, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in SERVED.items())} FROM r")
def serving_features(spark, sf):
    scored = R.rule_score(L.candidates(spark, sf), fuzzy=False).withColumn("position", F.row_number().over(S.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    named = {
        "normalized_query": F.col("query"), "item_id": F.col("doc_id"), "item_title": F.col("title"), "item_description": F.col("description"), "item_category_name": F.col("category"), "item_supplier_name": F.col("supplier"),
        "user_top_categories": F.col("top_categories"), "user_top_suppliers": F.coalesce("top_suppliers", F.array().cast("array<string>")), "user_recent_items": F.transform("recent_items", lambda x: x.cast("string")),
        "retrieval_score": F.col("retrieval"), "attribute_overlap_count": F.col("attribute_overlap"), "brand_match_flag": F.col("brand_match").cast("int"), "category_match_flag": F.col("category_match").cast("int"), "numeric_constraint_match_flag": F.col("numeric_match").cast("int"),
    }
    return X.serving_features(scored.withColumns(named)).select("query_id", "doc_id", *SERVED)
