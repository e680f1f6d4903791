"""Query resolution: variants of a query, the one to search with, expansions, suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import spelling as S

CONFIDENCE = {"high": 0, "medium": 1, "low": 2}


def variants(queries: DataFrame, dictionary: dict[str, str], vocabulary: DataFrame) -> DataFrame:
    """Rows query_id, text, source, confidence, is_primary: the query (query_id, q) as typed, by dictionary, by layout and by fuzzy spelling.

    Queries that spelling leaves as they are get a fallback variant of low confidence, in which each unknown word is the nearest known one, if
    one is near. Equal texts are one, of the best confidence, then the first source. The primary is the first of high confidence that isn't
    the original, else the original. vocabulary: candidate, freq.
    """
    base = queries.select("query_id", T.normalize(F.col("q")).alias("n"))
    fixed = base.withColumn("text", S.dictionary(F.col("n"), dictionary)).where("text IS NOT NULL")
    retyped = base.withColumn("text", T.fix_layout(F.col("n"))).where("text IS NOT NULL")
    words = base.select("query_id", F.posexplode(T.split_words(F.col("n"))).alias("place", "token"))
    open_ = words.where("token RLIKE '^[а-я]{4,}$'").join(vocabulary.select(F.col("candidate").alias("token")), "token", "left_anti")
    better = S.corrections(open_.select("token").distinct(), vocabulary).where("confidence <> 'low'")
    spelled = words.join(better, "token", "left").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("corrected", "token").alias("w")))), lambda x: x["w"]).alias("w"), F.min("score").alias("score"), F.count("corrected").alias("n_fixed"))
    fuzzy = spelled.where("n_fixed > 0").select("query_id", F.array_join("w", " ").alias("text"), S.label(F.col("score")).alias("confidence"))
    parts = [base.select("query_id", F.col("n").alias("text"), F.lit("original").alias("source"), F.lit("high").alias("confidence"), F.lit(0).alias("order"))]
    for i, (source, df) in enumerate((("dictionary", fixed.withColumn("confidence", F.lit("high"))), ("layout", retyped.withColumn("confidence", F.lit("high"))), ("fuzzy", fuzzy)), 1):
        parts.append(df.select("query_id", "text", F.lit(source).alias("source"), "confidence", F.lit(i).alias("order")))
    left = words.join(fuzzy.select("query_id").distinct(), "query_id", "left_anti")
    unknown = left.join(open_.select("query_id", "place"), ["query_id", "place"], "left_semi").select("token").distinct()
    nearest = S.near_variants(S.ranked_candidates(unknown, vocabulary), 1).select("token", F.col("candidate").alias("corrected"))
    tried = left.join(nearest, "token", "left").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("corrected", "token").alias("w")))), lambda x: x["w"]).alias("w"), F.count("corrected").alias("n"))
    parts.append(tried.where("n > 0").select("query_id", F.array_join("w", " ").alias("text"), F.lit("fallback").alias("source"), F.lit("low").alias("confidence"), F.lit(4).alias("order")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    level = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    one = every.groupBy("query_id", "text").agg(F.min_by(F.struct("source", "confidence", "order"), F.struct(level, "order")).alias("v")).select("query_id", "text", "v.*")
    wanted = F.when((F.col("confidence") == "high") & (F.col("source") != "original"), F.col("order")).otherwise(F.when(F.col("source") == "original", 100).otherwise(1000))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(wanted, "text")) == 1
    return one.withColumn("is_primary", first).drop("order")


def expanded(terms: Column) -> Column:
    """Terms with what they abbreviate and their lemmas, in order of first sight."""
    return F.array_distinct(F.flatten(F.transform(terms, T.expand)))


def synthesized(contract: Column, item: Column, category: Column, n: int) -> Column:
    """A query of n words: the contract's words that the item has, then the contract's, then the category's, while there are fewer than two."""
    shared = F.array_intersect(contract, item)
    more = F.when(F.size(shared) < 2, F.array_distinct(F.concat(shared, contract))).otherwise(shared)
    more = F.when(F.size(more) < 2, F.array_distinct(F.concat(more, category))).otherwise(more)
    return F.array_join(F.slice(more, 1, n), " ")


def suggestions(sources: list[tuple[str, DataFrame, int]], most: int) -> DataFrame:
    """Rows grp, label, place: of ranked sources (label, place) the first of each, distinct by group and label, `most` in all, in the sources' order."""
    out = None
    for i, (group, df, n) in enumerate(sources):
        part = df.orderBy("place", "label").limit(n).select(F.lit(group).alias("grp"), "label", F.col("place").cast("long"), F.lit(i).alias("at"))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("grp", "label").agg(F.min(F.struct("at", "place")).alias("p")).select("grp", "label", "p.at", "p.place")
    return one.orderBy("at", "place", "label").limit(most).select("grp", "label", "place")
