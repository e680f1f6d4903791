import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spindrift.llm.decontaminate import word_features
from spindrift.llm.line_chunks import BASE, Chunker, op8_line_chunks, remove_repeats
from spindrift.llm.quality_rules import OP2_SQL, keep_good, op2_host_quality, quality_rules, text_counts
from spindrift.llm.weak_labels import BUCKETS, classify, expectation_maximisation, measure, op3_weak_label_quality
from tests_shared import rows_of, same_as_sql


def test_op2_equals_sql(spark, sf):
    same_as_sql(op2_host_quality(spark, sf), OP2_SQL, sf)


def test_counts_of_a_text():
    assert text_counts("a b c a b c\nx#\nx#\n\n") == (8, 10, 2, 1, 6, 3)
    assert text_counts("") == (0, 0, 0, 0, 0, 0)


def test_hosts_of_junk_face_strict_limits(spark):
    good = " ".join(f"word{i}" for i in range(80))
    some = good + " " + "#" * 6  # 7 % symbols: passes the usual limit only
    junk = good + " " + "#" * 40
    rows = [(i, junk, "bad") for i in range(60)] + [(100, some, "bad"), (101, good, "bad")] + [(200 + i, good, "fine") for i in range(60)] + [(300, some, "fine"), (301, good, None)]
    got = rows_of(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")), "doc_id")
    assert got[100]["failed_rule"] == "symbols" and got[300]["kept"] and got[301]["kept"]
    assert got[101]["failed_rule"] == "host" and got[200]["kept"] and not got[0]["kept"]


def test_awkward_rows_are_judged(awkward, nothing):
    assert quality_rules(awkward).count() == awkward.count()
    assert keep_good(awkward).columns == awkward.columns and keep_good(nothing).collect() == []


def brute_cuts(lines, chunk_words=25, spread_words=25):
    """Chunks by the definition alone: no deque, no prefix sums."""
    size = [len(x.split()) for x in lines]

    def end(i, words):
        return next((e for e in range(i + 1, len(lines) + 1) if sum(size[i:e]) >= words), None)

    def rolling(i):
        h = 0
        for x in lines[i : end(i, chunk_words)]:
            h = (h * BASE + xxhash.xxh64_intdigest(x.encode())) % 2**64
        return h

    starts = set()
    for i in range(len(lines)):
        if size[i] and (e := end(i, spread_words)):
            some = [(rolling(j), j) for j in range(i, e) if size[j] and end(j, chunk_words)]
            if some:
                starts.add(min(some)[1])
    return [(i, end(i, chunk_words)) for i in sorted(starts)]


def brute_removal(texts, spread_words=25, chunk_words=25):
    """What stays of each text {id: text}: places of equal chunks but the least go, and lines beside them that equal those beside the least."""
    split = {d: (t or "").split("\n") for d, t in texts.items()}
    cuts = {d: brute_cuts(x) for d, x in split.items()}
    places = {}
    for d in sorted(split):
        ends = {}
        for n, (a, b) in enumerate(cuts[d]):
            chunk = "\n".join(split[d][a:b])
            if a >= ends.get(chunk, 0):
                ends[chunk] = b
                places.setdefault(chunk, []).append((d, n))
    places = {c: x for c, x in places.items() if len(x) > 1}
    held = {d: set() for d in split}
    for at in places.values():
        for d, n in at:
            held[d] |= set(range(*cuts[d][n]))
    gone = {d: set() for d in split}
    for at in places.values():
        k, kn = at[0]
        ka, kb = cuts[k][kn]
        for d, n in at[1:]:
            a, b = cuts[d][n]
            gone[d] |= set(range(a, b))
            for step, own, other, words in ((-1, a - 1, ka - 1, spread_words - 1), (1, b, kb, chunk_words + spread_words - 2)):
                some = []
                while 0 <= own < len(split[d]) and 0 <= other < len(split[k]) and len(some) < 64:
                    line = split[k][other]
                    words -= len(line.split())
                    if len(line.split()) >= spread_words or words < 0 or d == k and own in held[d] or split[d][own] != line:
                        break
                    some.append(own)
                    own, other = own + step, other + step
                while some and not split[d][some[-1]].split():
                    some.pop()
                gone[d] |= set(some)
    return {d: "\n".join(x for i, x in enumerate(split[d]) if i not in gone[d]) if gone[d] else texts[d] for d in split}


def test_chunks_equal_their_definition():
    r = np.random.default_rng(3)
    for _ in range(300):
        lines = [" ".join(f"w{r.integers(40)}" for _ in range(r.integers(0, int(r.choice([3, 12, 40]))))) for _ in range(r.integers(0, 30))]
        assert [(a, b) for a, b, _ in Chunker().cut(lines)] == brute_cuts(lines)


def test_op8_equals_brute_force(spark, sf, texts):
    want = brute_removal(texts)
    assert {r["doc_id"]: r["text"] for r in op8_line_chunks(spark, sf).collect()} == want and want != texts


def test_shuffled_joins_give_the_same(spark, sf, texts):
    got = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"), most_broadcast=-1)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_removal(texts)


def test_made_up_repeats_equal_brute_force(spark):
    r = np.random.default_rng(4)
    line = lambda: " ".join(f"w{r.integers(10**6)}" for _ in range(r.integers(0, int(r.choice([2, 10, 30])))))
    pool = [[line() for _ in range(r.integers(1, 12))] for _ in range(12)]
    texts = {i: "\n".join(x for part in r.choice(len(pool), 4) for x in [*pool[part], *(line() for _ in range(r.integers(0, 4)))]) for i in range(60)}
    got = remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_removal(texts)


def test_boundaries_resist_shifts():
    lines = [f"line number {i} of the passage, with a few words" for i in range(60)]
    a = {"\n".join(lines[x:y]) for x, y, _ in Chunker().cut(lines)}
    b = Chunker().cut(["put in front", *lines])
    shifted = {"\n".join(["put in front", *lines][x:y]) for x, y, _ in b}
    assert len(a & shifted) >= len(a) - 2


def test_passages_go_wherever_they_stand(spark):
    passage = " ".join(f"shared{i}" for i in range(55))
    rows = [(i, f"own first line of {i}\n{passage}\nown last line of {i}") for i in range(5)]
    got = rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    assert passage in got[0]["text"] and all(passage not in got[i]["text"] and f"own last line of {i}" in got[i]["text"] for i in range(1, 5))


def test_passages_of_short_lines_go(spark):
    r = np.random.default_rng(8)
    line = lambda a, b: " ".join(f"w{r.integers(10**9)}" for _ in range(r.integers(a, b)))
    for _ in range(3):
        passage = [line(4, 20) for _ in range(8)]
        rows = [(i, "\n".join([*(line(4, 30) for _ in range(4)), *passage, *(line(4, 30) for _ in range(3))])) for i in range(4)]
        got = rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
        assert all(x in got[0]["text"] for x in passage)
        for i in (1, 2, 3):
            assert not any(x in got[i]["text"] for x in passage) and got[i]["text"].count("\n") == 6


def test_passages_of_long_and_short_lines_go(spark):
    r = np.random.default_rng(9)
    line = lambda n: " ".join(f"w{r.integers(10**9)}" for _ in range(n))
    shapes = [[20, 30, 20], [5, 45, 5], [24, 25, 2], [30, 4, 30, 4, 30], [3, 0, 26, 0, 24]]
    shapes += [x for x in (r.integers(lo, hi, r.integers(2, 9)).tolist() for lo, hi in [(4, 31), (10, 41)] * 20) if sum(x) > 50]
    passages = [[line(n) for n in x] for x in shapes]
    rows = [(1000 * i + k, "\n".join([line(12), line(33), *passage, line(28), line(7)])) for i in range(3) for k, passage in enumerate(passages)]
    got = rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    for k, passage in enumerate(passages):
        assert "\n".join(passage) in got[k]["text"]
        for i in (1, 2):
            left = got[1000 * i + k]["text"].split("\n")
            assert not any(x in left for x in passage if x) and sum(map(bool, left)) == 4


def test_lines_repeated_in_one_text_keep_the_first(spark):
    text = "\n".join(["a line of six words only"] * 30)
    got = remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert 1 <= got.count("a line of six words only") < 30


def test_line_dedup_of_awkward_rows(awkward, nothing):
    done = remove_repeats(awkward)
    assert done.columns == [*awkward.columns, "removed_1"] and done.count() == awkward.count()
    kept = {(r["doc_id"], r["text"]) for r in done.select("doc_id", "text").collect()}
    assert (3, None) in kept and (4, "") in kept and (5, " \t\n ") in kept and (None, None) in kept
    assert remove_repeats(nothing).collect() == [] and remove_repeats(nothing.drop("removed")).columns[-1] == "removed"


def test_line_dedup_keeps_the_least_place(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(None, passage), (2, f"other words\n{passage}"), (1, f"{passage}\nmine\n{passage}"), (1, f"{passage}\nof the same id"), (3, passage), (3, passage)]
    got = {(r["doc_id"], r["text"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, t in got if passage in t} == {1} and (2, "other words") in got and (None, "") in got and (3, "") in got
    assert sum(t.count(passage) for _, t in got) == 1


def test_expectation_maximisation_finds_the_accuracies():
    r = np.random.default_rng(5)
    truth = r.random(20_000) < 0.3
    votes = np.stack([np.where(r.random(20_000) < 0.2, -1, np.where(r.random(20_000) < p, truth, ~truth)) for p in (0.9, 0.8, 0.7, 0.85)], 1).astype(int)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    got = expectation_maximisation(table, np.full(len(table), -1), counts.astype(float), 0.3, 1)
    assert np.allclose(got.accuracy(), [0.9, 0.8, 0.7, 0.85], atol=0.03) and abs(got.prior - 0.3) < 0.03


def test_capitals_are_counted_over_whole_texts():
    for unit, share in (("Ab", 0.5), ("Éb", 0.5), ("ab cd ef G", 0.1), ("ǅ𝐀ⅣⒶaßª中", 0.375), ("", 0.0)):
        for n in (1, 3, 2000, 3001):
            quality, _, buckets = measure(unit * n)
            assert buckets[4] == min(BUCKETS - 1, int(share * (BUCKETS - 1) + 0.999)) and (quality[4] == 0) == (share > 0.3)


def brute_posteriors(votes, given, one, rare):
    """Expectation-maximisation over single rows, by its formulas."""

    def held(p, g):
        return p if g < 0 else 0.98 if g == 1 else 0.02

    p = []
    for v, g in zip(votes, given, strict=True):
        start = rare if rare in v else 1 - rare if 1 - rare in v else one
        p.append(held(min(0.95, max(0.05, start)), g))
    for _ in range(200):
        rates = []
        for j in range(len(votes[0])):
            count = {(c, x): 1.0 for c in (0, 1) for x in (-1, 0, 1)}
            for v, q in zip(votes, p, strict=True):
                count[1, v[j]] += q
                count[0, v[j]] += 1 - q
            rates.append({(c, x): n / sum(count[c, y] for y in (-1, 0, 1)) for (c, x), n in count.items()})
        prior, before, free = (sum(p) + 1) / (len(p) + 2), p, []
        for v in votes:
            a, b = prior, 1 - prior
            for j, x in enumerate(v):
                a, b = a * rates[j][1, x], b * rates[j][0, x]
            free.append(a / (a + b))
        p = [held(x, g) for x, g in zip(free, given, strict=True)]
        if max(abs(x - y) for x, y in zip(p, before, strict=True)) < 1e-9:
            break
    return free, p


def brute_scorer(columns, targets, use, features, size):
    """Logistic regression by Adam, one row and one column at a time."""
    n_one = sum(u * t for u, t in zip(use, targets, strict=True))
    n_zero = sum(u * (1 - t) for u, t in zip(use, targets, strict=True))
    one, zero = {}, {}
    for own, t, u in zip(columns, targets, use, strict=True):
        for c in own:
            one[c], zero[c] = one.get(c, 0) + u * t, zero.get(c, 0) + u * (1 - t)
    tied = set()
    for c in one:
        share = min(1 - 1e-9, max(1e-9, (one[c] + zero[c]) / (n_one + n_zero)))
        error = (share * (1 - share) * (1 / n_one + 1 / n_zero)) ** 0.5
        odds = math.log((one[c] + 0.5) / n_one) - math.log((zero[c] + 0.5) / n_zero)
        if abs(one[c] / n_one - zero[c] / n_zero) >= 5 * error and abs(odds) >= math.log(6):
            tied.add(c)
    keys = [*sorted(tied), size - 1]
    w, m, v = ({c: 0.0 for c in keys} for _ in range(3))
    for step in range(1, 151):
        g = {c: 5e-4 * w[c] for c in keys}
        for own, t, u in zip(columns, targets, use, strict=True):
            some = [c for c in own if c in tied]
            e = u * (t / n_one + (1 - t) / n_zero) * (1 / (1 + math.exp(-sum(w[c] for c in some) - w[size - 1])) - t)
            for c in [*some, size - 1]:
                g[c] += e
        for c in keys:
            m[c], v[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * v[c] + 0.001 * g[c] ** 2
            w[c] -= 0.1 * (m[c] / (1 - 0.9**step)) / ((v[c] / (1 - 0.999**step)) ** 0.5 + 1e-6)
    return w


def test_op3_equals_plain_loops(spark, sf, texts):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = sorted(texts)
    got = [measure(texts[d] or "") for d in ids]
    out = rows_of(op3_weak_label_quality(spark, sf), "doc_id")
    features = 1 << 17
    size = 3 * features + 9 * BUCKETS + 1
    columns = []
    for d, (_, _, buckets) in zip(ids, got, strict=True):
        own = {kind * features + int(c) for kind, prefix in enumerate((None, 5, 7)) for c in word_features([texts[d] or ""], features, prefix)[0]}
        columns.append(sorted(own | {3 * features + i * BUCKETS + b for i, b in enumerate(buckets)}))
    drawn = sorted({(tuple(c), tuple(q), labels.get(d, (-1, -1))[0], tuple(t), labels.get(d, (-1, -1))[1]): i for i, (d, c, (q, t, _)) in enumerate(zip(ids, columns, got, strict=True))}.values())
    for i, (name, one, rare) in enumerate((("quality", 0.8, 0), ("toxic", 0.05, 1))):
        given = [labels.get(d, (-1, -1))[i] for d in ids]
        free, p = brute_posteriors([g[i] for g in got], given, one, rare)
        use = [1.0 if given[r] >= 0 else {"quality": 1.0, "toxic": 0.005}[name] * (max(got[r][i]) >= 0) for r in drawn]
        w = brute_scorer([columns[r] for r in drawn], [p[r] for r in drawn], use, features, size)
        for r, d in enumerate(ids):
            assert abs(out[d][f"{name}_posterior"] - free[r]) < 1e-6
            z = w[size - 1] + sum(w.get(c, 0.0) for c in columns[r])
            assert abs(out[d][f"{name}_score"] - 1 / (1 + math.exp(-z))) < 1e-4
            if name == "toxic":
                assert out[d]["kept"] == (out[d]["quality_score"] >= 0.5 and out[d]["toxic_score"] < 0.5)


def test_op3_on_labels_kept_back(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((got.quality_score >= 0.5) == (got.quality == 1)).mean() >= 0.97
    toxic = got.toxic == 1
    assert (got.toxic_score[~toxic] < 0.5).mean() >= 0.97 and (got.toxic_score[toxic] >= 0.5).mean() >= 0.6


def test_op3_catches_what_is_labelled(spark, sf):
    got = op3_weak_label_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.quality_score[got.quality == 0] < 0.5).mean() >= 0.9 and got.kept[(got.quality == 1) & (got.toxic == 0)].mean() >= 0.9


def test_classify_awkward_rows(awkward, nothing):
    assert classify(awkward).count() == awkward.count() and classify(nothing).collect() == []
    assert classify(awkward, awkward.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(7).alias("toxic"))).count() == awkward.count()
