"""Connected components of a link table, and bounded comparison cells for buckets of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import settle


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: list[str], parts: int = 16) -> DataFrame:
    """`rows` joined with their row of `table` (one for each `key`), where a key may be that of a large share of the rows.

    Rows of a key are dealt to `parts` tasks by a hash of the columns `by`, and the table's rows are repeated for each.
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    return dealt.join(table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [key, "__part"]).drop("__part")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for each node of the links (a, b, both long): root is the smallest node that it reaches.

    Alternates large-star and small-star steps; each is an aggregation with map-side minimum and a join, in which a star's rows are dealt to
    several tasks, and is written to the shared folder. Nothing is collected but two sums that tell when a round changes nothing. Null ends and self-links are left out, repeated
    links count once, an empty table gives an empty one.
    """
    edges = settle(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = spread_join(both.where("b > a"), least, "a", ["b"], 8).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def cells(rows: DataFrame, key: str, spread: str, limit: int) -> DataFrame:
    """`rows` with cell_lo and cell_hi, so that (key, cell_lo, cell_hi) has about 2 * `limit` rows at most and any two rows of a key meet in a cell.

    A key of at most `limit` rows is one cell. A larger one is dealt by a hash of `spread` to k parts, and each part meets each other in
    a cell of its own: rows are repeated k times, no pair is lost, and no task gets a whole hot key. Sizes come from a map-side count.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = rows.join(sizes, key, "left").withColumn("part", F.pmod(F.xxhash64(F.lit(7), F.col(spread)), parts).cast("int"))
    other = F.explode(F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))
    return dealt.withColumn("other", other).select(*rows.columns, F.least("part", "other").alias("cell_lo"), F.greatest("part", "other").alias("cell_hi"))
