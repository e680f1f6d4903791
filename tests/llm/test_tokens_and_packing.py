import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spindrift.llm.packing import OpenBins, WordIds, op5_best_fit_packing, pack, packing_order, token_pieces
from spindrift.llm.shared import tokenizer_path
from spindrift.llm.token_counts import Counter, count_tokens, op7_token_counts

MODEL, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
LETTERS = " \n\t▁abcdeéßÉ中文😀<>s/|0x1A'Σİ  theing.,́\x1c\x85\xa0\x0b"


def scraps(n):
    r = random.Random(7)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["", " ", "  ", "a" * 5000, " " * 5000, "ab" * 4000, *("".join(r.choice(letters) for _ in range(size)) for letters in ("ab", "the", "ingthe", "abcdefghijklmnopqrstuvwxyz", LETTERS.replace(" ", "")) for size in (300, 5000, 40_000)), "<s> </s> <0x0A>", "<|endoftext|>", "don't 'tis"]


def test_counts_equal_the_library():
    library, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), scraps(3000)
    assert Counter.of(MODEL, 1000).count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_ids_equal_the_library():
    texts = scraps(3000)
    want = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    for keep in (10**6, 50):
        ids = WordIds(WORDS, keep)
        got = [x for i in range(0, len(texts), 100) for x in ids.ids(texts[i : i + 100])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in want]


def test_op7_on_the_table(spark, sf, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in op7_token_counts(spark, sf).collect():
        n = len(library.encode(texts[r["doc_id"]] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 4096)


def test_counts_of_awkward_rows(awkward, nothing):
    rows = count_tokens(awkward, MODEL).collect()
    assert len(rows) == awkward.count() and sum(r["n_tokens"] == 0 for r in rows) == 3
    assert count_tokens(nothing, MODEL).collect() == []


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_op5_on_the_table(spark, sf, texts):
    rows = op5_best_fit_packing(spark, sf).collect()
    library, total = Tokenizer.from_file(WORDS), 0
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and r["length"] == min(4096, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        total += r["length"]
    assert len(check_packed(rows, 4096)) <= 1.05 * total / 4096 + 1


def naive_places(lengths, capacity, most):
    """Best-fit by its words: a list of open bins that is searched whole each time."""
    open_, out, opened = [], [], 0  # [room, number]
    for x in lengths:
        fitting = [b for b in open_ if b[0] >= x]
        if fitting:
            room = min(b[0] for b in fitting)
            best = [b for b in fitting if b[0] == room][-1]
            open_.remove(best)
        else:
            if len(open_) == most:
                least = min(b[0] for b in open_)
                open_.remove([b for b in open_ if b[0] == least][-1])
            best, opened = [capacity, opened], opened + 1
        out.append((best[1], capacity - best[0]))
        best[0] -= x
        if best[0]:
            open_.append(best)
    return out


def test_op5_equals_naive_bins(spark, sf):
    rows = op5_best_fit_packing(spark, sf)
    ordered = rows.orderBy(*packing_order(rows)).collect()
    want = naive_places([r["length"] for r in ordered], 4096, 256)
    assert [(r["sequence_id"] & (1 << 40) - 1, r["offset"]) for r in ordered] == want and len({r["sequence_id"] >> 40 for r in ordered}) == 1


def test_tasks_pack_their_share(spark):
    pieces = spark.range(20_000).selectExpr("id AS doc_id", "1 + pmod(xxhash64(id), 500) AS length", "'mine' AS sequence_id", "true AS offset")
    got = pack(pieces, 512, 8, task_tokens=1 << 20)
    assert got.columns == ["doc_id", "length", "sequence_id", "offset", "sequence_id_1", "offset_1"]
    rows = [{"sequence_id": r["sequence_id_1"], "offset": r["offset_1"], "length": r["length"]} for r in got.collect()]
    assert len(rows) == 20_000 and len({r["sequence_id"] >> 40 for r in rows}) == 5 and len(check_packed(rows, 512)) <= 1.1 * sum(r["length"] for r in rows) / 512
    assert sorted(map(str, got.collect())) == sorted(map(str, got.collect()))


def test_packing_of_awkward_rows(awkward, nothing):
    pieces = token_pieces(awkward, WORDS, capacity=64, with_ids=True)
    rows = pack(pieces, capacity=64, open_bins=3, task_tokens=1 << 16).collect()
    check_packed(rows, 64)
    assert sum(r["length"] == 1 and r["ids"] == [1] for r in rows) >= 3
    assert pack(token_pieces(nothing, WORDS)).collect() == []


def test_bins_take_the_tightest_and_close_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = OpenBins(10, 2)
    assert [bins.place(x)[0] for x in (5, 8, 6, 5, 4)] == [0, 1, 2, 0, 2]  # the third opens a bin, and the one of 8 closes
    for bad in (0, 11):
        with pytest.raises(ValueError):
            bins.place(bad)


def test_packing_is_near_the_bound():
    r = random.Random(1)
    sizes = [r.randint(1, 4096) if r.random() < 0.3 else r.randint(50, 1500) for _ in range(20_000)]
    bins = OpenBins(4096, 128)
    for x in sizes:
        bins.place(x)
    assert bins.opened <= 1.03 * sum(sizes) / 4096
