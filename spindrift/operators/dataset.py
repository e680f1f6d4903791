"""Building learning-to-rank data: sampling, matching, labels, splits, features, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.catalog import top_per_group
from spindrift.session import settled


def slot_sample(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Rows of the group, slot, key: at most n of each group in order of `key`: the first n fill the slots, every later one overwrites slot hash(key) mod n.

    No group goes through one task: its first n are a top-n, which is cut before the shuffle, and the last of each slot is a maximum, which
    counts if it comes after the first n.
    """
    first = top_per_group(rows.select(group, key), [group], [F.col(key)], n).select(group, (F.col("rank") - 1).cast("long").alias("slot"), F.col(key).alias("__first"))
    ends = first.groupBy(group).agg(F.max("__first").alias("__end"))
    slot = F.pmod(F.col(key) * 7919 + 13, F.lit(n)).cast("long")
    last = rows.groupBy(group, slot.alias("slot")).agg(F.max(key).alias("__last"))
    both = first.join(last.join(ends, group).where(F.col("__last") > F.col("__end")).drop("__end"), [group, "slot"], "full")
    return both.select(group, "slot", F.coalesce("__last", "__first").alias(key))


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """Of each key the first `cap` rows."""
    return top_per_group(rows, by, order, cap)


def token_votes(queries: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """For each query (query_id, words) the n categories of samples (category, words) with most of its words."""
    of = samples.select("category", F.explode("words").alias("word")).distinct()
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    votes = asked.join(of, "word").groupBy("query_id", "category").agg(F.count("*").alias("votes"))
    return top_per_group(votes, ["query_id"], [F.desc("votes"), F.col("category")], n)


def sample_scores(queries: DataFrame, items: DataFrame, samples: DataFrame, n_categories: int) -> DataFrame:
    """Rows query_id, item_id, category, votes, shared, score for the samples (item_id) of each query's voted categories.

    queries: query_id, words, supplier_words; items: item_id, category, words, category_words, supplier_words. Each title word shared counts 3,
    each of the category's 1.4, of the supplier's name 2, and an equal name 4 more. Samples bound the pairs of a query, whatever its
    categories hold.
    """
    voted = token_votes(queries, items.select("category", "words"), n_categories).select("query_id", "category", "votes")
    kept = items.join(samples.select("item_id"), "item_id", "left_semi")
    pairs = voted.join(kept, "category").join(queries.select("query_id", F.col("words").alias("asked"), F.col("supplier_words").alias("asked_supplier")), "query_id")
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    same = (F.size("asked_supplier") > 0) & (F.array_sort("asked_supplier") == F.array_sort("supplier_words"))
    score = 3.0 * shared("asked", "words") + 1.4 * shared("asked", "category_words") + 2.0 * shared("asked_supplier", "supplier_words") + F.when(same, 4.0).otherwise(0.0)
    return pairs.select("query_id", "item_id", "category", "votes", shared("asked", "words").alias("shared"), F.round(score, 4).alias("score"))


def matches(scored: DataFrame) -> DataFrame:
    """The best item of each query with a score above 0, the least id of equals."""
    return top_per_group(scored.where("score > 0"), ["query_id"], [F.desc("score"), F.col("item_id")], 1).drop("rank")


def candidate_items(scored: DataFrame, limit: int) -> DataFrame:
    """The `limit` best items of each query, where each vote for an item's category adds a quarter."""
    raised = scored.withColumn("score", F.round(F.col("score") + 0.25 * F.col("votes"), 4))
    return top_per_group(raised, ["query_id"], [F.desc("score"), F.col("item_id")], limit)


def soft_label(positive: Column, same_category: Column, overlap: Column) -> Column:
    """3 for the item itself, 1 for its category's items that share a word, else 0."""
    return F.when(positive, 3).when(same_category & (overlap > 0), 1).otherwise(0)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with place, their place from 0 in the order of the columns, which must tell rows apart, and n, their number.

    Rows are dealt by ranges of the order and ranked within them, and each range is moved up by the sizes of those before it, so no task gets
    all rows; what one task sorts is a row for each range. The dealt rows are written to the shared folder: the ranges come from a sample, and
    dealing the rows twice could cut them at different places.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    dealt = settled(dealt.withColumn("__within", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    sizes = dealt.groupBy("__part").agg(F.max("__within").alias("__size"))
    ordered = Window.orderBy("__part")
    before = F.coalesce(F.sum("__size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = sizes.select("__part", before.alias("__before"), total.cast("long").alias("n"))
    return dealt.join(F.broadcast(moved), "__part").withColumn("place", (F.col("__before") + F.col("__within") - 1).cast("long")).select(*rows.columns, "place", "n")


def time_split(sessions: DataFrame, key: list[str], at: str, train: float = 0.8, validate: float = 0.1) -> DataFrame:
    """Sessions in order of time with their split: the first int(n * train), the next int(n * validate), the rest."""
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * validate)
    split = F.when(F.col("place") < first, "train").when(F.col("place") < first + second, "val").otherwise("test")
    return placed(sessions, [at, *key]).withColumn("split", split).select(*sessions.columns, "split")


def gates(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Adds reject_reason: the first step whose condition doesn't hold, null for accepted rows."""
    why = F.lit(None).cast("string")
    for name, ok in reversed(steps):
        why = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(why)
    return rows.withColumn("reject_reason", why)


def linear_ranker(rows: DataFrame, features: list[str], label: str):
    """A ridge regression on named features: a plain stand-in for gradient-boosted pairwise ranking, which no public Spark API offers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features"), LinearRegression(labelCol=label, regParam=1.0, elasticNetParam=0.0, solver="normal")]
    return Pipeline(stages=steps).fit(rows)
