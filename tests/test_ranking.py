import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.operators import dataset as D
from spindrift.operators import ranking as R
from spindrift.operators import retrieval as S


def test_perfect_order_has_ndcg_one(spark):
    rows = spark.createDataFrame([(g, i, l, float(l)) for g in range(5) for i, l in enumerate((3, 2, 1, 0))], "g int, id int, label int, score double")
    got = R.metrics(rows, "g", "label", "score", "id", 10).first()
    assert (got["ndcg"], got["hit_rate"], got["mrr"], got["map"], got["n_groups"]) == (1.0, 1.0, 1.0, 1.0, 5)


def test_metrics_without_gain(spark):
    got = R.metrics(spark.createDataFrame([(1, 1, 0, 0.5)], "g int, id int, label int, score double"), "g", "label", "score", "id", 10).first()
    assert (got["ndcg"], got["hit_rate"], got["mrr"], got["map"]) == (0.0, 0.0, 0.0, 0.0)


def loop_prepend(old, new, most):
    if not new:
        return old
    out = list(old)
    for x in new:
        if x not in out:
            out.insert(0, x)
    return out[:most]


def loop_recent(values, most):
    out = []
    for x in values:
        if x not in out:
            out.append(x)
            out = out[-most:]
    return out


def test_lists_equal_loops(spark):
    random.seed(4)
    cases = [([random.randint(0, 9) for _ in range(random.randint(0, 9))], [random.randint(0, 9) for _ in range(random.randint(0, 6))]) for _ in range(60)]
    cases = [(list(dict.fromkeys(a)), b) for a, b in cases]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, old array<int>, new array<int>")
    for r in df.select("i", R.prepend(F.col("old"), F.col("new"), 8).alias("x")).collect():
        assert r["x"] == loop_prepend(*cases[r["i"]], 8)
    flat = spark.createDataFrame([(i, p, v) for i, (_, b) in enumerate(cases) for p, v in enumerate(b * 2)], "i int, p int, v int")
    for r in R.recent_distinct(flat, ["i"], "v", "p", 3, "x").collect():
        assert r["x"] == loop_recent(cases[r["i"]][1] * 2, 3)


def test_fusion_grows_with_channels(spark):
    hits = spark.createDataFrame([(1, 10, "bm25", 2.0, 1), (1, 10, "fuzzy", 0.5, 3), (1, 11, "bm25", 1.0, 2)], "query_id int, doc_id int, channel string, score double, rank int")
    got = {r["doc_id"]: r for r in S.fuse(hits).collect()}
    assert got[10]["score"] > got[11]["score"] and got[10]["n_channels"] == 2
    assert got[10]["score"] == pytest.approx(round((1.2 / 61 + 0.9 / 63) / (7.35 / 61), 4))


def test_blend_of_equal_values_is_zero(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.92, 0.9), (1, 0.9, 0.41, 0.35), (2, 1.0, 1.0, 1.0)], "g int, prediction double, baseline double, retrieval double")
    assert sorted(r["blended"] for r in R.blend(rows, ["g"]).collect()) == [0.0, 0.3, 0.7]


def test_rule_score_tiers(spark):
    row = ("red bolt", ["red", "bolt"], "red bolt", "", "", 0.0, 0, False, False, False, ["t"], [], ["s"], [], "t", "s", 1)
    schema = "query string, terms array<string>, title string, description string, attributes string, retrieval double, attribute_overlap int, brand_match boolean, numeric_match boolean, category_match boolean, top_categories array<string>, recent_items array<int>, top_suppliers array<string>, popular_items array<int>, category string, supplier string, doc_id int"
    got = R.rule_score(spark.createDataFrame([row, ("red bold", *row[1:])], schema), fuzzy=True).collect()
    assert got[0]["score"] == pytest.approx(0.75 + 0.16 + 0.3) and got[0]["reasons"][0] == "exact_title_match"
    assert got[1]["reasons"][0] == "fuzzy_title_match"


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_alignment_distance_is_symmetric(a, b):
    assert S.alignment_distance(a, b) == S.alignment_distance(b, a) <= max(len(a), len(b))


def test_slots_equal_the_loop(spark):
    ids = random.Random(2).sample(range(100_000), 300)
    df = spark.createDataFrame([(i % 3, i) for i in ids], "g int, id int")
    wanted = {}
    for g in range(3):
        slots = []
        for i in sorted(x for x in ids if x % 3 == g):
            if len(slots) < 24:
                slots.append(i)
            else:
                slots[(i * 7919 + 13) % 24] = i
        wanted |= {(g, s): i for s, i in enumerate(slots)}
    assert {(r["g"], r["slot"]): r["id"] for r in D.slot_sample(df, "g", "id", 24).collect()} == wanted


def test_time_split_equals_the_sorted_cut(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)]
    got = {r["k"]: r["split"] for r in D.time_split(spark.createDataFrame(rows, "k int, at int"), ["k"], "at").collect()}
    order = [k for k, at in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [got[k] for k in order] == ["train"] * 80 + ["val"] * 10 + ["test"] * 11


def test_gates_name_the_first_that_fails(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, None)], "a int, b int")
    got = [r["reject_reason"] for r in D.gates(df, [("a", F.col("a") == 1), ("b", F.col("b") == 1)]).collect()]
    assert got == [None, "a", "b"]
