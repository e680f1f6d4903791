from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.session import table
from spindrift.streaming import events as E


def timed(spark, sf):
    schema = table(spark, sf, "events").schema
    return E.event_stream(spark, f"{sf}/[e]vents.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def test_dwell_equals_the_batch(spark, sf, tmp_path):
    got = {(r["user_id"], r["item_id"], r["started_at"], r["dwell_ms"]) for r in E.drained(E.dwell(timed(spark, sf)), str(tmp_path)).collect()}
    batch = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))
    order = Window.partitionBy("user_id", "item_id").orderBy("ts", "event_id")
    spent = ((F.unix_micros(F.lead("ts").over(order)) - F.unix_micros("ts")) / 1000).cast("long")
    want = {(r["user_id"], r["item_id"], r["ts"], r["d"]) for r in batch.withColumn("d", spent).where("event_type = 'view' AND d IS NOT NULL").collect()}
    assert got == want


def test_once_keeps_one_of_each(spark, sf, tmp_path):
    got = E.drained(E.once(timed(spark, sf), ["user_id", "event_type"], "400 days"), str(tmp_path))
    assert got.count() == table(spark, sf, "events").select("user_id", "event_type").distinct().count()


def test_rejected_events_have_reasons(spark, sf, tmp_path):
    _, bad = E.validated(timed(spark, sf), ["view"])
    assert {r[0] for r in E.drained(bad, str(tmp_path)).select("reject_reason").distinct().collect()} == {"unknown_type"}


def test_ingest_hands_over_batches(spark, sf, tmp_path):
    seen = []
    E.ingest(timed(spark, sf), lambda df, n: seen.append((n, df.count())), str(tmp_path)).awaitTermination()
    assert sum(n for _, n in seen) == table(spark, sf, "events").count()


def test_dwell_over_several_batches_and_without_users(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", None, "view", 7), (2, "2024-01-01 00:00:01.001", None, "click", 7), (3, "2024-01-01 00:00:02", 0, "view", 7), (4, "2024-01-01 00:00:05", 0, "view", 7), (5, "2024-01-01 00:00:09", 0, "click", 7)]
    schema = "event_id long, ts string, user_id long, event_type string, item_id long"
    for i, part in enumerate((rows[:1] + rows[2:3], rows[1:2] + rows[3:])):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, item_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    found = E.dwell(source)
    assert "bucket" in found._jdf.queryExecution().logical().toString()  # a call for each bucket, not for each key
    got = sorted((-1 if r["user_id"] is None else r["user_id"], r["dwell_ms"]) for r in E.drained(found, str(tmp_path / "out")).collect())
    assert got == [(-1, 1001), (0, 3000), (0, 4000)]
