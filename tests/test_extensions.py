import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import localise as L
from spindrift.functions import text as T
from spindrift.operators import dataset as D
from spindrift.operators import plugins as X
from spindrift.operators import retrieval as R
from spindrift.operators import spelling as S
from spindrift.plans import registry
from spindrift.sources import synthetic


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_texts_are_localised_in_order(spark):
    def loop(text):
        out = text
        for source, target in L.REPLACEMENTS:
            out = re.sub(rf"(?<!\w){re.escape(source)}(?!\w)", target, out, flags=re.IGNORECASE)
        out = " ".join(out.split())
        return out[:1].upper() + out[1:] if text[:1].isupper() and out else out

    cases = ["Postavka printer dlya ofisov", "  IT   support, it", "fleet_support fleet_supporter", "Office and supplies", "Municipal organization 7", "", "Bumaga A4", "server-switch", "Арenda toner", "noutbukk/noutbuk", "x Dlya"]
    r = random.Random(4)
    cases += [" ".join(r.choice([r.choice(L.REPLACEMENTS)[0], "x", "A4", "IT"]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", L.localised(F.col("x")).alias("y")).collect()
    assert {x["i"]: x["y"] for x in rows} == {i: loop(c) for i, c in enumerate(cases)}
    assert one(spark, L.localised, None) is None


def test_names_are_localised(spark):
    assert one(spark, L.localised_supplier, "OOO Astra12 Unknown3  city-42") == "ООО Астра12 Unknown3 city-42"
    assert one(spark, L.localised_category, "Services") == "Услуги" and one(spark, L.localised_role, "boss") == "boss"


def test_terms_are_expanded(spark):
    got = one(spark, T.expand, "ибп")
    assert got[:5] == ["ибп", "источник бесперебойного питания", "источник", "бесперебойного", "бесперебойный"] and "ups" in got
    assert one(spark, T.expand, "x") == []


def test_catalogue_tokenizers(spark):
    assert one(spark, T.catalog_tokens, "Ёлка HP-12a x 2 HP") == ["лка", "hp", "12a"]
    assert one(spark, T.name_tokens, "ООО Group Ромашка ab") == ["ромашка"]
    assert one(spark, T.spelling_tokens, "Ёлка 123 а1б ab") == ["ёлка", "а1б"]
    assert one(spark, T.plain, " Ё  Ж\n") == "е ж" and one(spark, T.plain, None) == ""


def test_slots_equal_a_loop(spark):
    rows = [(g, k) for g, n in ((0, 100), (1, 24), (2, 3), (3, 25)) for k in random.Random(g).sample(range(10_000), n)]
    want = {}
    for g in range(4):
        held = []
        for k in sorted(k for g_, k in rows if g_ == g):
            if len(held) < 24:
                held.append(k)
            else:
                held[(k * 7919 + 13) % 24] = k
        want |= {(g, i): k for i, k in enumerate(held)}
    got = D.slot_sample(spark.createDataFrame(rows, "g int, k long"), "g", "k", 24).collect()
    assert {(r["g"], r["slot"]): r["k"] for r in got} == want


def test_gram_matches_equal_all_pairs(spark):
    r = random.Random(6)
    text = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(0, 14)))
    a, b = [(i, text()) for i in range(40)], [(i, text()) for i in range(120)]
    left, right = (spark.createDataFrame(x, f"{k} int, t string").withColumn("grams", T.grams(F.col("t"))) for x, k in ((a, "query_id"), (b, "doc_id")))
    grams = lambda t: {f"  {t} "[i : i + 3] for i in range(len(t) + 1)} if t else set()
    for kind, least in (("dice", 0.3), ("dice", 0.11), ("jaccard", 0.3)):
        want = {}
        for (i, x), (j, y) in itertools.product(a, b):
            p, q = grams(x), grams(y)
            if p and q:
                share = len(p & q) / len(p | q) if kind == "jaccard" else 2 * len(p & q) / (len(p) + len(q))
                if round(share, 6) >= least:
                    want[i, j] = round(share, 6)
        got = {(x["query_id"], x["doc_id"]): x["similarity"] for x in R.gram_candidates(left, right, least, share=kind).collect()}
        assert got == want and want


def test_nearest_equals_all_pairs(spark):
    rows = np.random.default_rng(3).integers(-3, 4, (300, 5)).tolist()
    vectors = spark.createDataFrame([(i, [float(x) for x in v] if i != 7 else None) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(5)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in R.nearest(queries, vectors, 4, 0.2, block=6).collect())
    want = []
    for q in range(0, 300, 20):
        scored = []
        for d, v in enumerate(rows):
            n = (sum(x * x for x in rows[q]) * sum(x * x for x in v)) ** 0.5
            if d not in (q, 7) and n and (s := round(sum(x * y for x, y in zip(rows[q], v, strict=True)) / n, 6)) >= 0.2:
                scored.append((-s, d))
        want += [(q, i, d, -s) for i, (s, d) in enumerate(sorted(scored)[:4], 1)]
    assert got == sorted(want)


def test_providers_rank(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = spark.createDataFrame([(1, 1, 0.92, 0.9, 0.1), (1, 2, 0.41, 0.35, 0.9), (2, 1, 0.5, 0.5, 0.5)], "query_id int, doc_id int, score double, retrieval double, f double")
    order = lambda df: [(r["query_id"], r["doc_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert order(X.PROVIDERS["noop"]().rank(rows)) == [(1, 1), (1, 2), (2, 1)] == order(X.PROVIDERS["local_ml"]().rank(rows))
    model = Pipeline(stages=[VectorAssembler(inputCols=["f"], outputCol="features"), LinearRegression(labelCol="f")]).fit(rows)
    ranked = X.ModelProvider(model).rank(rows)
    assert order(ranked) == [(1, 2), (1, 1), (2, 1)] and {(r["query_id"], r["doc_id"]): r["score"] for r in ranked.collect()}[1, 2] == 0.7


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    Pipeline(stages=[SQLTransformer(statement="SELECT *, -score AS prediction FROM __THIS__")]).fit(spark.range(1)).save(str(tmp_path / "m"))
    rows = spark.createDataFrame([(1, 1, 0.9, 0.0), (1, 2, 0.1, 0.0)], "query_id int, doc_id int, score double, retrieval double")
    assert X.ModelProvider.load(str(tmp_path / "m")).rank(rows).where("rank = 1").first()["doc_id"] == 2


def test_analysers_and_encoders_plug_in(spark):
    words = spark.createDataFrame([("принтеры",), (None,), ("hp",)], "w string")
    upper = X.lemmatizer(lambda: str.upper)
    assert [r[0] for r in words.select(upper("w")).collect()] == ["ПРИНТЕРЫ", None, "HP"]
    assert words.select(X.lemmatizer()(F.col("w"))).first()[0] == "принтер"
    sizes = X.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r[0] for r in words.select(sizes("w")).collect()] == [[8.0, 1.0], [0.0, 1.0], [2.0, 1.0]]


def test_near_variants(spark):
    vocabulary = spark.createDataFrame([("принтер", 12), ("принтеры", 4), ("сервер", 3), ("пиксель", 2)], "candidate string, freq long")
    ranked = S.ranked_candidates(spark.createDataFrame([("принтэрр",)], "token string"), vocabulary)
    assert [(r["candidate"], r["rank"]) for r in S.near_variants(ranked, 2).orderBy("rank").collect()] == [("принтеры", 1), ("принтер", 2)]
    token = spark.createDataFrame([("принтэр", False), ("для", False), ("printer", False), ("ab12", False), ("сервер", True)], "t string, known boolean")
    assert [r[0] for r in token.select(S.is_skipped(F.col("t"), F.col("known"), F.lit(False))).collect()] == [False, True, True, True, True]


def test_cover_density_shuffles_no_words(spark):
    docs = spark.createDataFrame([(1, ["a", "bb", "x", "a"]), (2, ["a"]), (3, None), (None, ["bb", "a"])], "doc_id int, words array<string>")
    terms = spark.createDataFrame([(1, "a"), (1, "bb"), (2, "a"), (3, "a"), (3, None)], "query_id int, token string")
    want = {(1, 1): 0.15, (2, 1): 0.2, (2, 2): 0.1, (1, None): 0.1, (2, None): 0.1}
    for most in (1 << 25, 40):  # one pass, and several
        found = R.cover_density(terms, docs, most_bytes=most)
        assert {(r["query_id"], r["doc_id"]): r["score"] for r in found.collect()} == want
    plan = R.cover_density(terms, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "strategy=broadcast" in plan


def test_covers_equal_all_stretches(spark):
    r = random.Random(8)
    for _ in range(200):
        words = [r.choice("abcx") for _ in range(r.randint(0, 14))]
        need = r.sample("abc", r.randint(1, 3))
        held = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(need) <= set(words[i : j + 1])]
        least = [(i, j) for i, j in held if not any((a, b) != (i, j) and i <= a and b <= j for a, b in held)]
        assert R.covers([[i for i, w in enumerate(words) if w == t] for t in need]) == least
    docs = spark.createDataFrame([(1, "a x x b a".split()), (2, ["a"]), (3, [])], "doc_id int, words array<string>")
    got = R.cover_density(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "query_id int, token string"), docs).collect()
    assert {(x["query_id"], x["doc_id"]): x["score"] for x in got} == {(1, 1): round(0.1 / 3 + 0.1, 6), (2, 1): 0.2, (2, 2): 0.1}


def test_made_up_tables_repeat(spark):
    a, b, c = (synthetic.tables(spark, seed) for seed in (1, 1, 2))
    for name in a:
        rows = sorted(map(str, a[name].collect()))
        assert rows and rows == sorted(map(str, b[name].collect()))
    assert sorted(map(str, a["events"].collect())) != sorted(map(str, c["events"].collect()))
    assert a["events"].join(a["impressions"], ["session_id", "rank_position", "item_id"], "left_anti").isEmpty()


def test_search_reaches_by_every_channel(spark, sf):
    rows = registry.queries()["two_phase_search"](spark, sf).collect()
    reasons = {q: set(",".join(r["reasons"] for r in rows if r["query_id"] == q).split(",")) for q in {r["query_id"] for r in rows}}
    assert {"retrieval_bm25", "retrieval_morphology", "retrieval_exact", "retrieval_synonym", "retrieval_rrf"} <= reasons[1]
    assert reasons[7] == {"retrieval_fuzzy"} and any(r["title"].split()[1] in ("gizmo", "bolt") for r in rows if r["query_id"] == 7)
    assert all(sorted(r["rank"] for r in rows if r["query_id"] == q) == list(range(1, len([r for r in rows if r["query_id"] == q]) + 1)) for q in reasons)
