"""The search domain over the driver's tables: items, purchases, events, documents. Each as a frame, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import table


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items: parts, with the least supplier that delivers them."""
    by_part = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.min("l_suppkey").alias("supplier_id"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.concat_ws(" ", "p_type", "p_brand").alias("description"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"))
    return parts.join(by_part, "item_id", "left").join(suppliers, "supplier_id", "left").select("item_id", "title", "category", "brand", "size", "price", "description", "supplier_id", "supplier")


ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS title, p_type AS category, p_brand AS brand, p_size AS size, p_retailprice AS price,
         p_type || ' ' || p_brand AS description, m.supplier_id, s_name AS supplier
  FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS supplier_id FROM lineitem GROUP BY 1) m ON l_partkey = p_partkey
  LEFT JOIN supplier ON s_suppkey = m.supplier_id)"""


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases: order lines with the buyer and their organisation."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("bought_at"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(users, "user_id").select(F.col("o_orderkey").alias("order_id"), "user_id", "org_id", "item_id", "seller_id", "quantity", "amount", "bought_at")


PURCHASES = """purchases AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, c_nationkey AS org_id, l_partkey AS item_id, l_suppkey AS seller_id, l_quantity AS quantity,
         l_extendedprice AS amount, o_orderdate AS bought_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


#: Russian forms (one, several) of the words of the parts' names.
RUSSIAN = {
    "small": ("маленький", "маленькие"), "large": ("большой", "большие"), "red": ("красный", "красные"), "blue": ("синий", "синие"), "hot": ("горячий", "горячие"), "cold": ("холодный", "холодные"), "old": ("старый", "старые"), "new": ("новый", "новые"),
    "ring": ("обруч", "обручи"), "bolt": ("болт", "болты"), "gear": ("редуктор", "редукторы"), "rod": ("стержень", "стержни"), "plate": ("лист", "листы"), "widget": ("виджет", "виджеты"), "gizmo": ("прибор", "приборы"), "anvil": ("молот", "молоты"),
}


def russian_items(spark: SparkSession, sf: str) -> DataFrame:
    """Rows item_id, title: the parts with their names in Russian, odd ones in the plural, every third with a number of pieces, every third with a length."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_size")
    forms = F.create_map(*[x for word, both in RUSSIAN.items() for x in (F.lit(word), F.array(*[F.lit(f) for f in both]))])
    words = F.transform(F.split("p_name", " "), lambda w: F.coalesce(F.get(F.try_element_at(forms, w), (F.col("item_id") % 2).cast("int")), w))
    size = F.col("p_size").cast("string")
    more = F.when(F.col("item_id") % 3 == 0, F.concat(size, F.lit(" шт"))).when(F.col("item_id") % 3 == 1, F.concat(size, F.lit("мм")))
    return parts.select("item_id", F.concat_ws(" ", F.array_join(words, " "), more).alias("title"))


RUSSIAN_SQL = """russian AS (
  SELECT p_partkey AS item_id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: coalesce((MAP {""" + ", ".join(f"'{w}': ['{a}', '{b}']" for w, (a, b) in RUSSIAN.items()) + """})[w][p_partkey % 2 + 1], w)), ' ')
         || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_size || ' шт' WHEN 1 THEN ' ' || p_size || 'мм' ELSE '' END AS title FROM part)"""


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events, with the item that their properties name."""
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("item_id"))


EVENTS = """log AS (SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS item_id FROM events)"""

#: A session ends when a user does nothing for so many seconds.
SESSION_GAP = 12 * 3600


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    from spindrift.operators.telemetry import sessionize

    return sessionize(event_log(spark, sf), SESSION_GAP)


SESSIONS = (
    EVENTS
    + f""",
gaps AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= {SESSION_GAP * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM log),
sessions AS (SELECT * EXCLUDE (fresh), (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM gaps)"""
)


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
