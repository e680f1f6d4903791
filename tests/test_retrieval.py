import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.operators import resolution as N
from spindrift.operators import retrieval as R

ITEMS = [
    (1, "Бумага офисная A4 500 листов", "белый 80 г/м2 A4 500 листов", "Канцтовары", "Бумага для печати"),
    (2, "Картридж HP 12A 2 шт", "HP 12A черный 2 шт", "Картриджи", "Картридж для принтера"),
    (3, "Принтер лазерный", "A4 usb", "Оргтехника", "Печать документов"),
    (4, "Сервер Dell", "Dell 64 гб", "Серверное оборудование", "Сервер для стойки"),
]


@pytest.fixture(scope="module")
def docs(spark):
    fields = ["title", "attributes", "category", "description"]
    rows = spark.createDataFrame(ITEMS, "doc_id int, title string, attributes string, category string, description string").withColumns({f: T.normalize(F.col(f)) for f in fields})
    rows = rows.withColumns({"title_terms": T.terms(F.col("title")), "category_terms": T.terms(F.col("category")), "attribute_terms": T.terms(F.col("attributes"))})
    rows = rows.withColumns({"title_lemmas": T.lemmas(F.col("title_terms")), "category_lemmas": T.lemmas(F.col("category_terms"))})
    return T.with_analysis(rows, F.concat_ws(" ", *fields), "d").cache()


def scored(spark, docs, text):
    query = T.with_analysis(spark.createDataFrame([(1, text)], "query_id int, q string"), F.col("q"), "q")
    return {r["doc_id"]: r for r in R.structured_scores(docs.crossJoin(query.drop("query_id"))).collect()}


def test_exact_channel_finds_brand_and_amount(spark, docs):
    got = scored(spark, docs, "картридж hp 12a 2 шт")
    best = max((r for r in got.values() if r["exact_score"] is not None), key=lambda r: r["exact_score"])
    assert best["doc_id"] == 2 and best["brand_match"] and best["numeric_match"] and best["strict_coverage"] == 1.0


def test_attribute_channel(spark, docs):
    got = scored(spark, docs, "бумага a4 500 листов")
    best = max((r for r in got.values() if r["attribute_score"] is not None), key=lambda r: r["attribute_score"])
    assert best["doc_id"] == 1 and best["attribute_overlap"] >= 2


def test_bm25_and_synonyms(spark, docs):
    index = R.postings(docs, {"title": "title_terms", "category": "category_terms", "attributes": "attribute_terms"})
    wanted = spark.createDataFrame([(1, "серверное"), (1, "оборудование"), (2, "канцтовары"), (3, "nothing")], "query_id int, token string")
    got = {r["query_id"]: r["doc_id"] for r in R.top(R.bm25(wanted, index, V.FIELD_WEIGHTS), 1).collect()}
    assert got == {1: 4, 2: 1}


def test_fuzzy_channel(spark, docs):
    rows = docs.select("doc_id", F.col("title").alias("text"), F.concat(F.array("title"), "title_terms").alias("variants"))
    query = spark.createDataFrame([(1, "принтэр", ["принтэр"])], "query_id int, text string, variants array<string>")
    best = R.top(R.fuzzy(query, rows, 5), 1).first()
    assert best["doc_id"] == 3 and best["edit"] > 0.5


def test_resolution(spark):
    queries = spark.createDataFrame([(1, "принтэр hp"), (2, "ghbynth"), (3, "кампьютер"), (4, "бумага")], "query_id int, q string")
    vocabulary = spark.createDataFrame([("принтер", 12), ("бумага", 9), ("компьютер", 7)], "candidate string, freq long")
    got = {r["query_id"]: (r["text"], r["source"]) for r in N.variants(queries, {"кампьютер": "компьютер"}, vocabulary).where("is_primary").collect()}
    assert got == {1: ("принтер hp", "fuzzy"), 2: ("принтер", "layout"), 3: ("компьютер", "dictionary"), 4: ("бумага", "original")}


def test_expansion_and_synthesis(spark):
    row = spark.createDataFrame([(["мфу"], ["a", "b", "c"], ["c", "x"], ["y"])], "t array<string>, c array<string>, i array<string>, k array<string>")
    got = row.select(N.expanded(F.col("t")).alias("e"), N.synthesized(F.col("c"), F.col("i"), F.col("k"), 3).alias("q")).first()
    assert got["e"][:2] == ["мфу", "многофункциональное устройство"] and got["q"] == "c a b"


def test_fallback_is_asked_for_only_where_few_are_found(spark):
    hits = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 1)], "query_id int, doc_id int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert sorted(map(tuple, R.short_of_hits(hits, queries, 5).collect())) == [(2, 1), (3, 0)]


def test_cosine(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    got = R.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>"), vectors, 5, 0.2).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(2, 0.707107)]
