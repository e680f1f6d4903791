"""Catalogue analytics: counts, popularity, feeds, related items, supplier insight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counts(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n most frequent values, ties by value: partial counts, then a top-n that needs no full sort."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank. Spark cuts groups to k before and after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def priority_union(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows key, reason, priority, place: the union of ranked sources (key, place); of a key the earliest source's reason stays."""
    parts = [df.select(key, "place", F.lit(reason).alias("reason"), F.lit(i).alias("priority")) for i, (reason, df) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min(F.struct("priority", "place", "reason")).alias("best"))
    return best.select(key, "best.reason", "best.priority", "best.place")


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """One page of ordered rows, and the total."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def related(items: DataFrame, probes: DataFrame, n: int, most_broadcast: int = 1000) -> DataFrame:
    """For each probe (item_id) the n best items of its category or supplier: .4 category, .2 supplier, title words (.12, at most .24), attributes (.1, at most .2).

    Up to `most_broadcast` probes are counted and sent to the items, which are read once; more are joined by two equi-joins, put together and
    made distinct.
    """
    own = items.select("item_id", "category", "supplier_id", "words", "attributes")
    probe = own.join(probes.select("item_id"), "item_id", "left_semi").select(*[F.col(c).alias(f"p_{c}") for c in own.columns])
    same = [F.col("p_category") == F.col("category"), F.col("p_supplier_id") == F.col("supplier_id")]
    if probes.count() <= most_broadcast:
        pairs = own.join(F.broadcast(probe), same[0] | same[1])
    else:
        pairs = probe.join(own, same[0]).unionByName(probe.join(own, same[1])).dropDuplicates(["p_item_id", "item_id"])
    pairs = pairs.where("p_item_id <> item_id")
    shared = F.size(F.array_intersect("p_words", "words"))
    alike = F.size(F.array_intersect("p_attributes", "attributes"))
    score = F.when(F.col("p_category") == F.col("category"), 0.4).otherwise(0.0) + F.when(F.col("p_supplier_id") == F.col("supplier_id"), 0.2).otherwise(0.0) + F.least(shared * 0.12, F.lit(0.24)) + F.least(alike * 0.1, F.lit(0.2))
    known = [F.when(same[0], "same_category"), F.when(same[1], "same_supplier"), F.when(shared > 0, "title_overlap"), F.when(alike > 0, "attribute_overlap")]
    reasons = F.array_join(F.filter(F.array(*known), lambda r: r.isNotNull()), ",")
    scored = pairs.select(F.col("p_item_id").alias("probe_id"), "item_id", F.round(score, 4).alias("score"), reasons.alias("reasons"))
    return top_per_group(scored, ["probe_id"], [F.desc("score"), F.col("item_id")], n)


def differing_attributes(entries: DataFrame, missing: str = "—") -> DataFrame:
    """Rows set_id, key, n_values, differs of entries (set_id, item_id, key, value): a value that an item lacks counts as `missing`."""
    members = entries.select("set_id", "item_id").distinct()
    sizes = members.groupBy("set_id").agg(F.count("*").alias("n_items"))
    by_key = entries.groupBy("set_id", "key").agg(F.count_distinct("value").alias("n"), F.count_distinct("item_id").alias("has"))
    n = F.col("n") + (F.col("has") < F.col("n_items")).cast("long")
    return by_key.join(sizes, "set_id").select("set_id", "key", n.alias("n_values"), (n > 1).alias("differs"))


def overlapping(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """For each row of left (left_id, words) the n rows of right (right_id, words) with most words in common, by an equi-join on words."""
    a = left.select("left_id", F.explode(F.array_distinct("words")).alias("word"))
    b = right.select("right_id", F.explode(F.array_distinct("words")).alias("word"))
    counted = a.join(b, "word").groupBy("left_id", "right_id").agg(F.count("*").alias("overlap"))
    return top_per_group(counted, ["left_id"], [F.desc("overlap"), F.col("right_id")], n)


def competitors(sales: DataFrame, supplier: int, n: int) -> DataFrame:
    """Other suppliers in the supplier's categories: items and sales there. sales: supplier_id, category, item_id."""
    own = sales.where(F.col("supplier_id") == supplier).select("category").distinct()
    other = sales.join(own, "category", "left_semi").where(F.col("supplier_id") != supplier)
    return other.groupBy("supplier_id").agg(F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_sales")).orderBy(F.desc("n_sales"), "supplier_id").limit(n)
