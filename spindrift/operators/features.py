"""Features of the ranker: the frame it is trained on and the map it is served with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.sources.portal import ensure_columns

# Features that retrieval adds to a result, all 0 where it has none.
RETRIEVAL = [
    "retrieval_score", "retrieval_channel_count", "retrieval_exact", "retrieval_attribute", "retrieval_bm25", "retrieval_morphology", "retrieval_fuzzy", "retrieval_synonym", "retrieval_rrf",
    "channel_score_exact_structured", "channel_score_attribute", "channel_score_bm25", "channel_score_morphology", "channel_score_fuzzy", "channel_score_synonym_bm25",
    "channel_rank_exact_structured", "channel_rank_attribute", "channel_rank_bm25", "channel_rank_morphology", "channel_rank_fuzzy", "channel_rank_synonym_bm25",
    "exact_match_flag", "phrase_match_flag", "category_match_flag", "brand_match_flag", "numeric_constraint_match_flag", "attribute_overlap_count", "appeared_in_multiple_channels", "strict_term_coverage", "fuzzy_edit_score",
]
# The item's columns that are categories.
CATEGORICAL = ["item_category_id", "item_category_name", "item_supplier_id", "item_supplier_name", "item_status"]
# Features of the query, the item and the user.
OWN = [
    "query_len", "normalized_query_len", "position_num", "query_has_correction", "query_has_digits", "query_has_synonyms", "cat_match_user", "cat_match_org", "supplier_match_user",
    "is_recent_ste", "is_popular_ste_org", "query_in_history", "title_term_overlap", "description_term_overlap", "attribute_term_overlap", "total_term_overlap", "title_exact_match", "title_prefix_match",
    "title_partial_match", "description_contains_query", "attribute_value_count", "title_len_chars", "description_len_chars",
]
NUMERIC = [*OWN, *RETRIEVAL]

#: Columns that rows may lack, and what stands for them.
TEXTS = ["query", "normalized_query", "item_title", "item_description", *CATEGORICAL]
LISTS = ["user_top_categories", "user_recent_items", "user_top_suppliers", "user_popular_queries", "org_top_categories", "org_popular_items"]


def n_words(plain_text: Column) -> Column:
    return F.size(F.filter(F.split(plain_text, " "), lambda w: w != ""))


def overlap(terms: Column, plain_text: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(terms), T.plain_terms(plain_text)))


def member(values: Column, value: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: T.plain(v) == T.plain(value)), F.lit(False)) & (T.plain(value) != "")


def training_features(rows: DataFrame) -> DataFrame:
    """`rows` with the 53 numeric and 5 categorical features of the training frame, from what they have of TEXTS, LISTS, RETRIEVAL, item_id, position, attribute_values and label.

    Missing columns and nulls have defaults: empty text, empty lists, 0, position 999. Texts are compared in lower case without ё. A query
    has a correction if a column says so or else if its normalized form differs.
    """
    had_correction = "query_has_correction" in rows.columns
    rows = ensure_columns(rows, dict.fromkeys(TEXTS, "") | dict.fromkeys([*RETRIEVAL, "query_has_synonyms", "query_has_correction", "label"], 0.0) | {"position": None})
    rows = rows.withColumns({c: F.array().cast("array<string>") for c in [*LISTS, "attribute_values"] if c not in rows.columns})
    number = lambda c, default=0.0: F.coalesce(F.col(c).try_cast("double"), F.lit(default))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXTS})
    rows = rows.withColumns({"__q": T.plain(F.col("query")), "__n": T.plain(F.col("normalized_query")), "__title": T.plain(F.col("item_title")), "__description": T.plain(F.col("item_description")), "__attributes": T.plain(F.array_join(F.filter("attribute_values", lambda v: F.trim(v) != ""), " "))})
    rows = rows.withColumn("__terms", T.plain_terms(F.col("__n")))
    q, n, title, description, terms = (F.col(f"__{c}") for c in ("q", "n", "title", "description", "terms"))
    shared = {f"{c}_term_overlap": overlap(terms, F.col(f"__{own}")).cast("double") for c, own in (("title", "title"), ("description", "description"), ("attribute", "attributes"))}
    asked = n != ""
    own = {
        "query_len": n_words(q),
        "normalized_query_len": n_words(n),
        "position_num": number("position", 999.0),
        "query_has_correction": number("query_has_correction") if had_correction else q != n,
        "query_has_digits": n.rlike("[0-9]"),
        "query_has_synonyms": number("query_has_synonyms"),
        "cat_match_user": member(F.col("user_top_categories"), F.col("item_category_name")),
        "cat_match_org": member(F.col("org_top_categories"), F.col("item_category_name")),
        "supplier_match_user": member(F.col("user_top_suppliers"), F.col("item_supplier_name")),
        "is_recent_ste": member(F.col("user_recent_items"), F.col("item_id")),
        "is_popular_ste_org": member(F.col("org_popular_items"), F.col("item_id")),
        "query_in_history": member(F.col("user_popular_queries"), n) | member(F.col("user_popular_queries"), q),
        **shared,
        "total_term_overlap": sum(shared.values(), F.lit(0.0)),
        "title_exact_match": title == n,
        "title_prefix_match": asked & title.startswith(n),
        "title_partial_match": asked & title.contains(n),
        "description_contains_query": asked & description.contains(n),
        "attribute_value_count": F.size("attribute_values"),
        "title_len_chars": F.length("item_title"),
        "description_len_chars": F.length("item_description"),
    }
    made = {c: v.cast("double") for c, v in own.items()} | {c: number(c) for c in [*RETRIEVAL, "label"]}
    return rows.withColumns(made).drop("__q", "__n", "__title", "__description", "__attributes", "__terms")


def serving_features(rows: DataFrame) -> DataFrame:
    """Scored candidates with what the model is served: the training features that serving has, the rule score, and a flag for each reason.

    Serving makes neither query_has_digits nor is_popular_ste_org, which are 0 there. rows: the columns of training_features, score, reasons.
    """
    flags = {f"reason_{r}": F.array_contains("reasons", r).cast("double") for r in V.REASON_LABELS}
    made = training_features(rows).withColumns({"query_has_digits": F.lit(0.0), "is_popular_ste_org": F.lit(0.0)})
    extra = {"baseline_score": F.col("score").cast("double"), "query_term_count": F.size(F.array_distinct(T.terms(T.normalize(F.col("normalized_query"))))).cast("double")}
    return made.withColumns(extra | flags)
