import glob
import hashlib
import os
import types
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.llm.license_scan import OP10_SQL, PHRASES, TEMPLATES, license_scan, op10_license_scan, words
from spindrift.llm.warc import INDEX, OP6_SQL, Warc, op6_warc, page_records, read_archives, register
from tests_shared import TABLES, rows_of, same_as_sql


def test_op6_equals_sql(spark, sf):
    same_as_sql(op6_warc(spark, sf), OP6_SQL, sf)


PAGES = [(1, "http://a.example/x?y=%20z", "a" * 2000), (2, "http://b.example/\r\nX: 1", "a" * 2000), (3, "http://b.example/é", "é" * 600), (4, None, None), (None, "http://c.example", "a" * 2000), (5, "http://d.example", "short"), (6, "http://d.example", "short"), (7, "http://e.example", "b" * 3_000_000), (2, "http://b.example/\r\nX: 1", "a" * 2000)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    register(spark)
    folder = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"key": F.lit(0), "payload": F.lit(0), "holder": F.lit(0)})
    page_records(pages).write.format("warc").mode("append").save(folder)
    return folder


def test_round_trip(spark, archive):
    rows = spark.read.format("warc").load(archive).collect()
    assert len(rows) == len(PAGES)
    by = {r["record_id"]: r for r in rows if r["record_type"] == "response"}
    assert bytes(by["urn:page:7"]["payload"]) == b"b" * 3_000_000 and by["urn:page:2"]["target_uri"] == "http://b.example/\r\nX: 1"
    assert by["urn:page:3"]["target_uri"] == "http://b.example/é" and bytes(by["urn:page:4"]["payload"]) == b"" and by["urn:page:4"]["target_uri"] is None
    visits = [r for r in rows if r["record_type"] == "revisit"]
    assert sorted(r["record_id"] for r in visits) == ["urn:page:1", "urn:page:null"] and {r["refers_to"] for r in visits} == {"urn:page:2"}
    assert all(r["payload_length"] == 2000 and r["payload_digest"] == hashlib.sha1(b"a" * 2000).hexdigest() and bytes(r["payload"]) == b"" for r in visits)


def test_predicates_and_headers_alone(spark, archive):
    read = lambda *p, **o: read_archives(spark, archive, *p, **o)
    visits = read(("EqualTo", "record_type", "revisit"))
    assert visits.count() == 2 and visits.where("record_id = 'urn:page:1'").count() == 1 and visits.count() == 2
    assert read(("In", "record_id", ["urn:page:5", "urn:page:6"]), ("EqualTo", "target_uri", "http://d.example")).count() == 2
    assert read(("StringStartsWith", "target_uri", "http://b"), ("IsNotNull", "payload_digest", None)).where("length(payload) > 1500").count() == 2
    assert read(("IsNull", "target_uri", None)).count() == 1
    few = read(columns=["record_id", "record_type"], split=1000)
    assert few.columns == ["record_id", "record_type"] and few.count() == len(PAGES) and few.rdd.getNumPartitions() > 1
    both = read().alias("a").join(read(("EqualTo", "record_type", "revisit")).alias("b"), F.expr("b.refers_to = a.record_id"))
    assert both.count() == 4
    with pytest.raises(ValueError):
        read(("EqualTo", "payload", "x"))


def test_filters_of_the_optimizer(spark, archive):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = Warc({"path": archive, "pushdown": "true"}).reader(StructType.fromDDL("record_id string"))
    other = GreaterThan(("payload_length",), 5)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), other])) == [other]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("warc").option("pushdown", "true").load(archive).where("record_type = 'revisit'")
        assert rows.count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archives_without_an_index(spark, archive, tmp_path):
    for path in glob.glob(f"{archive}/*.warc.gz"):
        os.link(path, tmp_path / os.path.basename(path))
    assert not glob.glob(f"{tmp_path}/*{INDEX}")
    rows = spark.read.format("warc").load(str(tmp_path))
    assert rows.count() == len(PAGES) and rows.where("record_type = 'revisit'").count() == 2 and rows.agg(F.sum(F.length("payload"))).first()[0] == 4000 + 1200 + 10 + 3_000_000


def test_ranges_without_an_index(spark, archive, tmp_path):
    """Members are found by the task, in the index or by their headers; each is read once, whatever the ranges."""
    want = sorted((r["record_id"], r["record_type"], bytes(r["payload"])) for r in read_archives(spark, archive).collect())
    for path in glob.glob(f"{archive}/*.warc.gz"):
        os.link(path, tmp_path / os.path.basename(path))
    for folder in (archive, str(tmp_path)):
        for split in (50, 333, 4000):
            got = read_archives(spark, folder, split=split)
            assert got.rdd.getNumPartitions() >= (3 if split < 1000 else 1)
            assert sorted((r["record_id"], r["record_type"], bytes(r["payload"])) for r in got.collect()) == want


def test_rejected_records_are_not_inflated(archive, monkeypatch):
    import json

    from spindrift.llm import warc

    inflated = 0

    class Counting:
        def __init__(self, bits):
            self.real = zlib.decompressobj(bits)

        def decompress(self, *args):
            nonlocal inflated
            out = self.real.decompress(*args)
            inflated += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.real, name)

    monkeypatch.setattr(warc, "zlib", types.SimpleNamespace(decompressobj=Counting, error=zlib.error))
    sizes = {}
    for kind, columns in (("response", "record_id string, payload binary"), ("revisit", "record_id string, payload_length long"), ("none", "record_id string")):
        reader = Warc({"path": archive, "predicates": json.dumps([["EqualTo", "record_type", kind]])}).reader(StructType.fromDDL(columns))
        inflated = 0
        n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        sizes[kind] = inflated
        assert n == {"response": len(PAGES) - 2, "revisit": 2, "none": 0}[kind]
    assert sizes["response"] > 3_000_000 and sizes["revisit"] <= 4096 * len(PAGES) and sizes["none"] <= 4096 * len(PAGES)


def test_parts_of_lost_tasks_go(archive, tmp_path):
    writer = Warc({"path": str(tmp_path)}).writer(StructType.fromDDL("record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"), False)
    lost, kept = writer.write(iter([])), writer.write(iter([]))
    other = tmp_path / ".of-another-job.part"
    other.touch()
    writer.commit([kept, None])
    assert not os.path.exists(lost.part) and sorted(os.listdir(tmp_path)) == sorted([other.name, kept.name, kept.name + INDEX])


def test_empty_table_and_bad_use(spark, tmp_path):
    register(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    page_records(pages).write.format("warc").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no bad"):
        spark.read.format("warc").schema("bad string").load(str(tmp_path)).collect()


def test_op10_equals_sql(spark, sf):
    same_as_sql(op10_license_scan(spark, sf), OP10_SQL, sf)


def brute_places(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = {}
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places[label] = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, places


def test_op10_base_equals_brute_force(spark, sf, texts):
    for r in op10_license_scan(spark, sf).collect():
        w, places = brute_places(texts[r["doc_id"]])
        every = [i for x in places.values() for i in x]
        labels = ",".join(sorted(k for k, x in places.items() if x))
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(every), labels)
        assert (r["first_word"], r["last_word"]) == ((min(every), max(every)) if every else (None, None))
        assert set(labels.split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_notices_are_found_with_changes(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    changed = mit.replace("free of charge", "at no charge whatever").replace("associated ", "")
    rows = [(1, "some words before " + mit + " and after"), (2, changed), (3, "granted to any person a copy of nothing at all"), (4, "Released under the MIT License. " * 3 + "All Rights Reserved"), (5, "CC BY cc by")]
    got = rows_of(license_scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["matches"][0]["start"] == 3
    assert got[2]["labels"] == "mit" and 0.7 <= got[2]["score"] < 1 and got[3]["labels"] == ""
    assert got[4]["labels"] == "mit,reserved" and (got[4]["first_word"], got[5]["n_base"], got[5]["last_word"]) == (15, 2, 2)
    few = rows_of(license_scan(spark.createDataFrame(rows, "doc_id long, text string"), most_broadcast=-1), "doc_id")
    assert {k: r["labels"] for k, r in few.items()} == {k: r["labels"] for k, r in got.items()}


def test_chains_of_notices_equal_sql(spark, sf, tmp_path):
    """Notices that follow each other, overlap or repeat their first words, so that chains of diagonals are long."""
    import random

    r, rows = random.Random(2), []
    for i in range(150):
        words_ = []
        for _ in range(r.randint(1, 6)):
            own = r.choice(TEMPLATES)[1].split()
            cut = r.randint(0, len(own) - 1) if r.random() < 0.4 else 0
            words_ += own[cut : r.randint(cut + 1, len(own))] if r.random() < 0.4 else own[cut:]
            words_ += own[:3] * r.randint(0, 25) if r.random() < 0.4 else ["x"] * r.randint(0, 3)
        rows.append((i, " ".join(words_)))
    for t in TABLES:
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet") if t != "documents" else None
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    os.rename(next(tmp_path.glob("d/*.parquet")), tmp_path / "documents.parquet")
    same_as_sql(op10_license_scan(spark, str(tmp_path)), OP10_SQL, str(tmp_path))
    last = "licensed under the " * 200 + TEMPLATES[1][1]
    got = license_scan(spark.createDataFrame([(1, last)], "doc_id long, text string")).first()
    assert "apache-2.0" in got["labels"] and any(m["similarity"] > 0.95 for m in got["matches"])


def test_awkward_rows(awkward, nothing):
    rows = license_scan(awkward).collect()
    assert len(rows) == awkward.count()
    (notice,) = [r for r in rows if r["n_base"]]
    assert notice["labels"] == "cc-by,cc-by-nc-4.0,reserved" and notice["doc_id"] is None
    assert license_scan(nothing).collect() == []
    assert awkward.where("doc_id = 5").select(words(F.col("text"))).first()[0] == []
