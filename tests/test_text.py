import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import spelling as S
from spindrift.operators.retrieval import alignment_distance


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("  Бумага А4 80 г/м2  ", "бумага а4 80 гм2"), ("10 x 20x30", "10х20х30"), ("канцелярские товары", "канцтовары"), ("Wi-Fi/LAN", "wi fi lan"), ("ёж №5", "еж 5"), (None, ""), ("", ""), ("рабочие станции hp", "рабочая станция hp")],
)
def test_normalize(spark, text, wanted):
    assert one(spark, T.normalize, text) == wanted


def test_terms_keep_a_unit_of_several_words_whole(spark):
    got = one(spark, lambda x: T.terms(T.normalize(x)), "бумага а4 80 г/м2 10 шт")
    assert got == ["бумага", "а4", "80", "грамм на квадратный метр", "10", "штука"]


@pytest.mark.parametrize(("text", "wanted"), [("ghbynth", "принтер"), ("noutbuk", None), ("linux", None), ("", None)])
def test_layout(spark, text, wanted):
    assert one(spark, lambda x: T.fix_layout(T.normalize(x)), text) == wanted


def test_analysis(spark):
    rows = spark.createDataFrame([("картридж HP 12a 2 шт",), ("бумага a4 500мл 500мл",), (None,)], "x string")
    a, b, c = (r["a"] for r in T.with_analysis(rows, F.col("x"), "a").collect())
    assert (a["brands"], a["models"], a["units"], a["is_hard"]) == (["hp"], ["12a"], ["штука"], True)
    assert [(q["value"], q["unit"]) for q in a["quantities"]] == [("2", "штука")]
    assert [(q["raw"], q["unit"]) for q in b["quantities"]] == [("500мл", "миллилитр")]
    assert (b["sizes"], c["tokens"], c["is_hard"]) == (["a4"], [], False)


def test_attribute_entries(spark):
    got = one(spark, T.attribute_entries, "Цвет:белый;Цвет:белый;Цвет:синий;x;a:b:c")
    assert [tuple(e) for e in got] == [("Цвет", "белый"), ("Цвет (2)", "синий"), ("Атрибут 3", "x"), ("a", "b:c")]
    assert one(spark, T.attribute_entries, None) == []


def test_lemma(spark):
    assert one(spark, lambda x: T.lemma(x), "принтеры") == "принтер"
    assert one(spark, lambda x: T.fallback_variants(x), "hp") == []


def test_alignment_distance_is_restricted():
    assert alignment_distance("ca", "abc") == 3
    assert alignment_distance("abcd", "abdc") == 1
    assert alignment_distance("", "abc") == 3


def test_correction_takes_the_much_more_frequent(spark):
    tokens = spark.createDataFrame([("принтэр",), ("бумагаа",)], "token string")
    vocabulary = spark.createDataFrame([("принтер", 12), ("бумага", 9), ("сервер", 3)], "candidate string, freq long")
    got = {r["token"]: (r["corrected"], r["confidence"]) for r in S.corrections(tokens, vocabulary).collect()}
    assert got == {"принтэр": ("принтер", "high"), "бумагаа": ("бумага", "high")}


def test_words_of_any_length_are_corrected(spark, tmp_path):
    from spindrift.plans.search import spell_corrections

    right = "internationalization nut bolt " + "q" * 61
    wrong = "internationalizatoin nuut bolf " + "q" * 60 + "w"
    rows = [(i, right) for i in range(6)] + [(6, wrong)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"]: r["corrected"] for r in spell_corrections(spark, str(tmp_path)).collect()}
    assert got == dict(zip(wrong.split(), right.split(), strict=True))


def test_near_pairs_equal_plain_edit_distances():
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abя😀"), n))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for size, most in ((2, 1), (4, 1), (8, 2), (12, 3), (300, 3)):
        left = ["ab" + word(size - 2) for _ in range(30)]
        right = ["ab" + word(max(1, size - 2 + int(r.integers(-4, 5)))) for _ in range(40)] + [x[:-1] + "b" for x in left[:5]]
        own, other, distance = S.near_pairs(left, right, 2, most)
        want = {(i, j): d for i, a in enumerate(left) for j, b in enumerate(right) if (d := plain(a, b)) <= most}
        assert dict(zip(zip(own.tolist(), other.tolist(), strict=True), distance.tolist(), strict=True)) == want and want
        kept = S.nearest(own, distance, 2)
        for i in set(own.tolist()):
            near = sorted(distance[own == i])[:2]
            assert sorted(distance[(own == i) & kept]) == [d for d in sorted(distance[own == i]) if d <= near[-1]]


def test_spelling_makes_no_row_for_each_pair_of_a_block(spark):
    tokens = spark.createDataFrame([(f"ab{i:05d}x".translate(str.maketrans("0123456789", "cdefghijkl")),) for i in range(3000)], "token string")
    vocabulary = tokens.select(F.concat("token", F.lit("yy")).alias("candidate"), F.lit(5).cast("long").alias("freq"))
    found = S.blocked_candidates(tokens, vocabulary, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("distance = 2").count() == 3000


def test_dictionary_replaces_whole_words(spark):
    assert one(spark, lambda x: S.dictionary(x, {"принтэр": "принтер", "a.b": "c"}), "принтэр принтэрный") == "принтер принтэрный"
