import itertools
import zlib

import duckdb
import numpy as np
import pytest
from test_quality import brute_removal
from test_simhash import roots
from test_tokens_and_packing import naive_places
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm.decontaminate import common, fit, leaks, op1_latent_decontamination, words
from spindrift.llm.packing import packing_order
from spindrift.llm.quality_rules import OP2_SQL
from spindrift.llm.shared import documents, tokenizer_path


def slow_common(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        last = row
    return last[-1]


def test_common_subsequences():
    for a, b in itertools.product(("", "a b c", "a a b", "c b a d", "b a b a c"), repeat=2):
        assert common(a.encode().split(), b.encode().split()) == slow_common(a.split(), b.split())


def brute_leaks(texts, items):
    """Pairs (text, item) by all windows of each text, as long as the item and a third more."""
    found = set()
    for d, t in texts.items():
        text = words(t or "")
        places = set(text)
        for j, item in items.items():
            if sum(w in places for w in item) < 0.75 * len(item):
                continue
            size = len(item) * 4 // 3
            if any(common(item, text[i : i + size]) >= 0.75 * len(item) for i in range(0, max(1, len(text) - len(item) + 1), 4)):
                found.add((d, j))
    return found


@pytest.fixture(scope="module")
def whole(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    items = {r["item_id"]: words(r["text"]) for r in documents(spark, sf, "benchmark").collect()}
    return sf, brute_leaks({r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}, items)


def test_recall_against_brute_force(spark, whole):
    sf, want = whole
    got = {(r["doc_id"], r["item_id"]) for r in op1_latent_decontamination(spark, sf).collect()}
    assert len(want) >= 15 and len(want & got) >= 0.9 * len(want)
    clean = documents(spark, sf).count() - len({d for d, _ in want})
    assert len({d for d, _ in got} - {d for d, _ in want}) <= 0.01 * clean


def test_paraphrases_need_the_answer(spark):
    item = " ".join(f"term{i}" for i in range(30))
    filler = lambda k: " ".join(f"filler{k}x{i}" for i in range(40))
    half = " ".join(f"term{i}" if i % 3 or i >= 22 else f"other{i}" for i in range(30))
    no_answer = " ".join(f"term{i}" if i < 22 and i % 5 else f"other{i}" for i in range(30))
    rows = [(1, f"{filler(1)} {item} {filler(2)}"), (2, f"{filler(3)} {half} {filler(4)}"), (3, f"{filler(5)} {no_answer} {filler(6)}"), (4, filler(7)), (5, item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks(docs, bench, cosine=0.1).collect()}
    assert set(got) == {1, 2, 5} and got[1]["n_common"] == 30 and got[2]["answer_share"] == 1.0
    blocks = leaks(docs, bench.unionByName(spark.createDataFrame([(12, filler(7))], "item_id long, text string")), cosine=0.1, item_block=1)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == {(1, 9), (2, 9), (5, 9), (4, 12)}


def test_awkward_rows(awkward, nothing, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, None)], "item_id long, text string")
    latent = fit(awkward.select("text"), features=256, rank=8, sketch=12)
    assert sorted(r["doc_id"] for r in leaks(awkward, bench, latent, cosine=0.0).collect()) == [1, 1, 2]
    assert leaks(nothing, bench).collect() == [] and leaks(awkward, bench.limit(0)).collect() == []


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    """Each stage's rows against a plain version of it, on what the stage before has kept."""
    docs = documents(spark, sf)
    was = {r["doc_id"]: r["text"] for r in docs.collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {d for (d,) in con.sql(f"SELECT doc_id FROM ({OP2_SQL}) WHERE kept").fetchall()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if number == 0:
            assert got == {d: t for d, t in was.items() if d in good} and len(got) < len(was)
        elif number == 1:
            left = brute_removal(was)
            assert got == {d: t for d, t in left.items() if t == was[d] or t.encode().split()} and got != was
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] != was[r["doc_id"]])
        elif number == 2:
            sets = {}
            for d, t in was.items():
                w = t.encode().lower().split()
                sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            groups = roots(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
            assert got == {d: was[d] for d in set(groups.values())}
        else:
            leaking = {d for d, _ in brute_leaks(was, {r["item_id"]: words(r["text"]) for r in documents(spark, sf, "benchmark").collect()})}
            assert len(leaking - set(got)) >= 0.9 * len(leaking) and len(set(was) - set(got) - leaking) <= 0.01 * len(was) + 1
            assert all(was[d] == t for d, t in got.items())
        was = got
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    library, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for d, t in was.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want |= {(d, i // 4096): ids[i : i + 4096] for i in range(0, len(ids), 4096)}
    ordered = last.orderBy(*packing_order(last)).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in ordered} == {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in want.items()}
    assert [(r["sequence_id"] & (1 << 40) - 1, r["offset"]) for r in ordered] == naive_places([len(want[r["doc_id"], r["piece"]]) for r in ordered], 4096, 256)
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.collect())) == sorted(map(str, last.select(*run.columns).collect()))


def test_stages_take_awkward_rows(awkward, nothing, spark, sf):
    for docs in (awkward, nothing, awkward.drop("removed")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= docs.count() + 200
