"""Ranking: profiles, the rule score, blending of scores, ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def most_common(rows: DataFrame, by: list[str], value: str, place: str, k: int, out: str) -> DataFrame:
    """For each key the array of its k most frequent values; equals in the order of their first `place`."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first", value)
    kept = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(out))


def prepend(old: Column, new: Column, most: int) -> Column:
    """New values that the list lacks, each put in front as it comes, then the list, at most so many; an empty `new` changes and cuts nothing."""
    return F.when(F.size(new) == 0, old).otherwise(F.slice(F.concat(F.reverse(F.array_distinct(F.array_except(new, old))), old), 1, most))


def end_values(rows: DataFrame, by: list[str], value: str, place: str, k: int, out: str, last: bool = True) -> DataFrame:
    """For each key the array of its k values of the largest `place`, the largest first, or of the smallest, if not `last`; equals by value. Groups are cut to k before and after the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(place) if last else F.col(place), value)
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(out))


def recent_distinct(rows: DataFrame, by: list[str], value: str, place: str, most: int, out: str) -> DataFrame:
    """For each key a first-in first-out list of values in order of `place`: a value in the list is skipped, beyond `most` the oldest leaves, and may come back.

    A key's rows stream through a task in order, which keeps `most` values of the key it is at, so a history of any length fits.
    """
    kept = [*by, value]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), f"`{out}` array<{rows.schema[value].dataType.simpleString()}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done, types = None, [], [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:-1], types[:-1], strict=True)), pa.array(columns[-1], pa.list_(types[-1]))], [*by, out])

        for part in batches:
            types = part.schema.types
            for *own, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, held))
                    key, held = own, []
                    if len(done) >= 10_000:
                        yield batch()
                        done = []
                if x not in held:
                    held = [*held, x][-most:]
        if key is not None:
            done.append((*key, held))
            yield batch()

    ordered = rows.select(*kept, place).repartition(*by).sortWithinPartitions(*by, place, value)
    return ordered.select(*kept).mapInArrow(run, schema)


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching blocks of two strings."""
    for left, right in batches:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def rule_score(rows: DataFrame, fuzzy: bool) -> DataFrame:
    """Adds score and reasons to rows of query (normalized), terms, title, description, attributes (lower case), retrieval, flags and profile lists."""
    q, title = F.col("query"), F.col("title")
    exact, prefix, part, inside = q == title, title.startswith(q), title.contains(q), F.col("description").contains(q)
    tiers = F.when(q == "", 0.0).when(exact, 0.75).when(prefix, 0.6).when(part, 0.45).when(inside, 0.22)
    named = F.when(q == "", None).when(exact, "exact_title_match").when(prefix, "prefix_title_match").when(part, "partial_title_match").when(inside, "description_match")
    if fuzzy:
        rows = rows.withColumn("__ratio", sequence_ratio(q, title))
        close = F.col("__ratio") >= 0.45
        tiers, named = F.when(tiers.isNotNull(), tiers).when(close, F.round(F.col("__ratio") * 0.25, 4)), F.when(named.isNotNull(), named).when(close & (q != ""), "fuzzy_title_match")
    hits = F.size(F.filter("terms", lambda t: title.contains(t) | F.col("description").contains(t) | F.col("attributes").contains(t)))  # a word that begins with the term contains it
    parts = [
        (F.coalesce(tiers, F.lit(0.0)), named),
        (F.least(hits * 0.08, F.lit(0.24)), F.when(hits > 0, "token_match")),
        (F.least(F.col("attribute_overlap") * 0.035, F.lit(0.14)), F.when(F.col("attribute_overlap") > 0, "attribute_match")),
        (F.when(F.col("brand_match"), 0.08).otherwise(0.0), F.when(F.col("brand_match"), "brand_match")),
        (F.when(F.col("numeric_match"), 0.1).otherwise(0.0), F.when(F.col("numeric_match"), "numeric_constraint_match")),
        (F.when(F.col("category_match"), 0.06).otherwise(0.0), F.when(F.col("category_match"), "category_match")),
        (F.least(F.greatest(F.col("retrieval"), F.lit(0.0)) * 0.55, F.lit(0.55)), F.when(F.col("retrieval") > 0, "hybrid_retrieval")),
    ]
    for lists, value, weight, reason in (("top_categories", "category", 0.2, "matches_purchase_history"), ("recent_items", "doc_id", 0.15, "recent_interaction"), ("top_suppliers", "supplier", 0.1, "popular_supplier"), ("popular_items", "doc_id", 0.08, "popular_in_organization")):
        known = F.coalesce(F.array_contains(lists, F.col(value)), F.lit(False))
        parts.append((F.when(known, weight).otherwise(0.0), F.when(known, reason)))
    total = parts[0][0]
    for value, _ in parts[1:]:
        total = total + value
    reasons = F.filter(F.array(*[r for _, r in parts]), lambda x: x.isNotNull())
    out = rows.withColumns({"score": F.round(total + 1e-9, 4), "reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("baseline_retrieval")))})
    return out.drop("__ratio")


def position_score(position: Column) -> Column:
    """The score of a result by its position alone; one without a position comes last, as if at 999."""
    return -F.coalesce(position.try_cast("double"), F.lit(999.0))


def scaled(column: Column, window) -> Column:
    """From 0 to 1 over the window; 0 where all are equal."""
    low, high = F.min(column).over(window), F.max(column).over(window)
    return F.when(high > low, (column - low) / (high - low)).otherwise(0.0)


def blend(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds blended: .7 prediction + .2 baseline + .1 retrieval, each scaled within the group."""
    window = Window.partitionBy(*by)
    return rows.withColumn("blended", F.round(0.7 * scaled(F.col("prediction"), window) + 0.2 * scaled(F.col("baseline"), window) + 0.1 * scaled(F.col("retrieval"), window), 6))


def rank_change(rows: DataFrame, by: list[str], before: str, after: str, key: str) -> DataFrame:
    """Adds rank_before, rank_after, moved and delta."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), key))
    out = rows.withColumns({"rank_before": rank(before), "rank_after": rank(after)})
    return out.withColumns({"moved": F.col("rank_before") - F.col("rank_after"), "delta": F.round(F.col(after) - F.col(before), 6)})


def metrics(rows: DataFrame, group: str, label: str, score: str, key: str, k: int, positive: int = 2) -> DataFrame:
    """One row: ndcg, hit_rate, mrr and map at k over the groups. A group without any gain doesn't count for ndcg.

    Gain is 2^label - 1, discounted by the position; average precision is the mean precision at the hits. All groups are worked on at once.
    """
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), key))
    ranked = rows.withColumns({"at": place(score), "ideal_at": place(label)})
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    hit = F.when((F.col("at") <= k) & (F.col(label) >= positive), 1).otherwise(0)
    before = Window.partitionBy(group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("hit", hit).withColumn("precision", F.when(F.col("hit") == 1, F.sum("hit").over(before) / F.col("at")))
    discounted = lambda at: F.sum(F.when(F.col(at) <= k, gain / F.log2(F.col(at) + 1)).otherwise(0.0))
    each = ranked.groupBy(group).agg(discounted("at").alias("dcg"), discounted("ideal_at").alias("ideal"), F.max("hit").alias("hit"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("at"))), F.lit(0.0)).alias("rr"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("ap"))
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return each.agg(F.count("*").alias("n_groups"), mean(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), "ndcg"), mean(F.col("hit"), "hit_rate"), mean(F.col("rr"), "mrr"), mean(F.col("ap"), "map"))
