import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import ngram_lm
from spindrift.llm.elias_fano import Sequence, coded, mapped, to_bytes
from spindrift.llm.hashing import word_hashes
from spindrift.llm.ngram_lm import Prior, build, fold, op4_ngram_trie, score


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (1, 2**64 - 1), (5, 6), (1000, 1000), (20_000, 2**63), (30_000, 45_000), (3000, 2**40)])
def test_sequences(tmp_path, n, universe):
    r = np.random.default_rng(n)
    v = np.unique(r.integers(0, universe, n, dtype=np.uint64))
    (tmp_path / "f").write_bytes(to_bytes(coded(v, universe, "k")))
    s = Sequence(mapped(str(tmp_path / "f")), "k")
    assert (s.values(np.arange(len(v))) == v).all()
    q = np.r_[v[:2000], r.integers(0, universe, 2000, dtype=np.uint64), np.array([0, universe - 1], np.uint64)]
    at = np.searchsorted(v, q)
    assert (s.successor(q) == at).all()
    there = np.array([i < len(v) and v[i] == x for i, x in zip(at, q, strict=True)])
    assert (np.where(there, at, -1) == s.find(q)).all()


def test_dense_buckets():
    v = np.r_[np.arange(5000, dtype=np.uint64), np.uint64(2**40) + np.arange(3, dtype=np.uint64)]
    s = Sequence(coded(v, 2**41, "k"), "k")
    assert (s.find(v) == np.arange(len(v))).all() and (s.find(np.array([6000, 2**40 + 3], np.uint64)) == -1).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, sf, texts, order):
    docs, prior = spark.read.parquet(f"{sf}/documents.parquet"), Prior(20.0, 1.5, 0.8)
    trie = build(docs, order=order, prior=prior, shards=5)
    rows = score(docs, trie).collect()
    words = {d: [b"", *(t or "").encode().lower().split(), b""] for d, t in texts.items()}
    train = [w for d, w in words.items() if zlib.crc32(str(d).encode()) % 10]
    c = [Counter(), Counter(), Counter()]
    for w in train:
        c[0].update(w[1:])
        c[1].update(zip(w, w[1:], strict=False))
        c[2].update(zip(w, w[1:], w[2:], strict=False))
    followed = Counter()
    for (a, b, _), n in c[2].items():
        followed[a, b] += n
    total, distinct = c[0].total(), len(c[0])

    def p(g):
        if len(g) == 1:
            return (c[0][g[0]] + 0.1) / (total + 0.1 * (distinct + 1))
        context = c[0][g[0]] if len(g) == 2 else followed[g[:2]]
        m = 20.0 + 1.5 * context**0.8
        return (c[len(g) - 1][g] + m * p(g[1:])) / (context + m)

    steps = [0.0] * 3  # the largest half steps of probabilities and weights, by level
    for name in os.listdir(trie.folder):
        level, arrays = int(name[5]), mapped(os.path.join(trie.folder, name))
        steps[level - 1] = max(steps[level - 1], sum(float(arrays[k][1]) / 2 for k in ("logp.scale", "left.scale") if k in arrays))
    signed, tokens = 0.0, 0
    for r in rows:
        w = words[r["doc_id"]]
        base = sum(math.log10(p((x,))) for x in w[1:])
        full = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(1, len(w)))
        assert r["base_score"] == pytest.approx(base) and abs(r["score"] - full) <= sum(steps) * len(w) + 1e-6
        signed, tokens = signed + r["score"] - full, tokens + len(w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) - 1, sum(c[0][x] > 0 for x in w[1:]), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    assert abs(signed) <= 0.001 * tokens  # the codes' errors cancel out
    assert len(os.listdir(trie.folder)) == sum(len(x.bounds) for x in trie.levels)


def test_held_out_texts_score_better_than_the_base(spark, sf):
    held = [r for r in op4_ngram_trie(spark, sf.replace("sf0.001", "sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_shards_stay_small_however_few_partitions_there_are(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    want = {r["doc_id"]: r["score"] for r in score(docs, build(docs)).collect()}
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 4000)
    trie = build(docs)
    for level in trie.levels[1:]:
        assert np.diff(np.r_[level.offsets, level.size]).max() <= 8000 < level.size
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in score(docs, trie).collect()}
    assert got.keys() == want.keys() and all(abs(x - want[i]) <= 0.02 * n for i, (x, n) in got.items())  # only the codes' steps differ


def test_awkward_rows(awkward, nothing):
    trie = build(awkward)
    rows = score(awkward, trie).collect()
    assert len(rows) == awkward.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(math.isfinite(r["score"]) for r in rows)
    empty = build(nothing)
    assert score(nothing, empty).collect() == [] and {r["score"] for r in score(awkward, empty).collect()} == {0.0}


def test_null_ids_have_a_fold():
    assert fold(None) == 0 and fold(3) == zlib.crc32(b"3") % 10


def test_hashes_do_not_depend_on_what_stands_around():
    one, _ = word_hashes(["Alpha beta"])
    many, sizes = word_hashes(["x", "", "alpha\tBETA gamma", " "])
    assert (one == many[1:3]).all() and sizes.tolist() == [1, 0, 3, 0]
    long = "z" * 1_200_000
    got, sizes = word_hashes([long + " alpha", "alpha " + long])
    assert got[1] == got[2] == one[0] and got[0] == got[3] and sizes.tolist() == [2, 2]
