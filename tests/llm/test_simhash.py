import itertools

import numpy as np
import xxhash

from spindrift.llm.components import cells, components
from spindrift.llm.near_copies import near_copies, one_of_each
from spindrift.llm.simhash import Covering, forest, op9_simhash, simhash_components


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op9_on_the_table(spark, sf, texts):
    fp = {d: brute_fingerprint(t) for d, t in texts.items()}
    ids = sorted(fp)
    want = roots(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    for r in op9_simhash(spark, sf).collect():
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def test_hot_group_of_near_fingerprints(spark):
    """A few thousand fingerprints within three bits of each other's neighbours: one component, found in small cells."""
    from spindrift.llm import simhash

    r = np.random.default_rng(3)
    base, fps = 0x0123456789ABCDEF, set()
    while len(fps) < 1500:
        x = base
        for b in r.integers(0, 64, 2):
            x ^= 1 << int(b)
        fps.add(x)
    classes = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in fps], "fp long")
    found = simhash.links(classes, cell=256)
    assert found.count() < 100 * len(fps)
    got = components(found).collect()
    assert len(got) == len(fps) and len({g["root"] for g in got}) == 1


def test_anchors_meet_whatever_bits_differ():
    r = np.random.default_rng(1)
    for threshold in (0, 1, 2, 3, 4, 5):
        covering = Covering(threshold)
        x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(64, threshold, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        row, key, home = covering.anchors(x)
        homes = [set() for _ in x]
        for a, k in zip(row[home], key[home], strict=True):
            homes[a].add(int(k))
        row, key, _ = covering.anchors(y)
        others = [set() for _ in x]
        for a, k in zip(row, key, strict=True):
            others[a].add(int(k))
        assert all(a & b for a, b in zip(homes, others, strict=True))


def test_awkward_rows(awkward, nothing):
    rows = simhash_components(awkward).collect()
    assert len(rows) == awkward.count()
    blank = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {3}
    assert simhash_components(nothing).collect() == []


def test_components(spark):
    for links in ([(1, 2), (2, 3)], [(1, 3), (2, 3)], [(5, 1), (5, 2), (2, 9), (9, 0), (7, 8)], [(i, i + 1) for i in range(70)]):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == roots({x for p in links for x in p}, links)
    odd = spark.createDataFrame([(1, None), (2, 2), (None, None)], "a long, b long")
    assert components(odd).collect() == []


def test_cells_let_all_rows_of_a_key_meet(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3)) for i in range(n)], "key int, id int")
    met = {}
    for r in cells(rows, "key", "id", 10).collect():
        met.setdefault((r["key"], r["cell_lo"], r["cell_hi"]), set()).add(r["id"])
    for k, n in ((1, 40), (2, 3)):
        pairs = {p for c, ids in met.items() if c[0] == k for p in itertools.combinations(sorted(ids), 2)}
        assert pairs == set(itertools.combinations(range(n), 2))
    assert max(map(len, met.values())) <= 30


def test_forest_has_the_components_of_all_links():
    points = np.array([0, 1, 2, 10, 11, 30])
    links = forest(lambda i, others: np.abs(points[others] - points[i]) <= 1, len(points))
    assert len(links) == 3 and len(set(roots(range(6), links).values())) == 3


def test_near_copies_equal_brute_force(spark, sf, texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = roots(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["root_id"] for r in near_copies(docs.select("doc_id", "text")).collect()}
    assert got == want
    assert {r["doc_id"] for r in one_of_each(docs).select("doc_id").collect()} == set(want.values())


def test_near_copies_of_one_stretch(spark):
    """Pairs at 0.80 to 0.85 that differ in one stretch: appended, cut off, replaced at the end."""
    r, rows = np.random.default_rng(5), []
    for n in range(40, 300, 2):
        for kind in ("appended", "cut", "replaced"):
            for least in (0.8, 0.83):
                pair = len(rows) // 2
                w = [f"w{pair}x{r.integers(10**9)}" for _ in range(n)]
                new = [f"v{pair}x{r.integers(10**9)}" for _ in range(n)]
                size = n - 4
                if kind == "replaced":  # of d words, one stretch at the end: (size - d) / (size + d)
                    d = int(size * (1 - least) / (1 + least))
                    other, share = w[: n - d] + new[:d], (size - d) / (size + d)
                elif kind == "cut":
                    d = int(size * (1 - least))
                    other, share = w[: n - d], (size - d) / size
                else:
                    d = int(size * (1 / least - 1))
                    other, share = w + new[:d], size / (size + d)
                assert 0.8 <= share <= 0.87
                rows += [(2 * pair, " ".join(w)), (2 * pair + 1, " ".join(other))]
    got = {x["doc_id"]: x["root_id"] for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_near_copies_of_few_long_words(spark):
    """The words that differ are the only ones of five bytes or more."""
    short = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijkl" for c in "mnop"]
    rows = [(i, " ".join([*short, word])) for i, word in enumerate(("elephants", "crocodiles"))]
    assert {x["root_id"] for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_one_of_each_of_awkward_rows(awkward, nothing):
    kept = one_of_each(awkward)
    assert kept.columns == awkward.columns
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect())
    assert got == [(False, 1), (False, 3), (False, 6), (False, 7), (True, None)]
    assert one_of_each(nothing).collect() == []
