"""A small made-up catalogue with its users, sessions and events, the same for a seed: for fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import vocabulary as V

WORDS = ["принтер", "бумага", "картридж", "сервер", "стол", "кабель", "монитор", "насос"]
KINDS = ["офисный", "сетевой", "белый", "цветной", "складной"]


def pick(values: list[str], *keys: Column) -> Column:
    """One of the values, by a hash of the keys."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(*keys), F.lit(len(values))).cast("int"))


def below(n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n))


def tables(spark: SparkSession, seed: int = 1, organizations: int = 5, users: int = 20, items: int = 100, sessions: int = 60, per_session: int = 10) -> dict[str, DataFrame]:
    """organizations, users, items, sessions, impressions and events, each of a range of ids and hashes of these and the seed, so that any of them can be made alone, of any size."""
    s, i = F.lit(seed), F.col("id")
    org = below(organizations, s, F.lit("org"), i)
    out = {
        "organizations": spark.range(organizations).select(i, F.concat(F.lit("Организация "), i.cast("string")).alias("name")),
        "users": spark.range(users).select(i, org.alias("organization_id"), F.concat(F.lit("Пользователь "), i.cast("string")).alias("name")),
        "items": spark.range(items).select(i.alias("item_id"), F.concat_ws(" ", pick(KINDS, s, F.lit("kind"), i), pick(WORDS, s, F.lit("word"), i), i.cast("string")).alias("title"), pick(WORDS, s, F.lit("word"), i).alias("category"), below(7, s, F.lit("supplier"), i).alias("supplier_id")),
    }
    out["sessions"] = spark.range(sessions).select(i.alias("session_id"), below(users, s, F.lit("user"), i).alias("user_id"), pick(WORDS, s, F.lit("query"), i).alias("query"), F.timestamp_seconds(F.lit(1_700_000_000) + i * 3600).alias("created_at"))
    shown = out["sessions"].select("*", F.explode(F.sequence(F.lit(1), F.lit(per_session))).alias("rank_position"))
    out["impressions"] = shown.select("session_id", "user_id", below(items, s, F.lit("item"), F.col("session_id"), F.col("rank_position")).alias("item_id"), "rank_position", "created_at")
    chance = F.pmod(F.xxhash64(s, F.lit("act"), F.col("session_id"), F.col("rank_position")), F.lit(100))
    acts = out["impressions"].where(chance < 30).withColumn("event_type", pick([t for t in V.EVENT_TYPES if t.startswith(("result", "favorite_a", "cart_a", "purchase_c"))], s, F.col("session_id"), F.col("rank_position")))
    out["events"] = acts.select("session_id", "user_id", "item_id", "event_type", "rank_position", (F.col("created_at") + F.make_interval(secs=F.col("rank_position") * 7)).alias("created_at"))
    return out
