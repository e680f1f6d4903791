"""An n-gram language model in an Elias-Fano trie.

Level 1 holds the hashes of all words in ascending order; a word's id is its place. Level k holds, for each context (an n-gram of level
k - 1, named by its place there), the ids of the words that follow it. Every level is cut into shards by key range, one file each in the
shared folder, mapped into memory by the workers that read it. A shard of level k >= 2 has

- monotone pointers: for each context of the shard, where its words start, Elias-Fano coded,
- the word ids, made ascending over all contexts by adding the last value of the context before, Elias-Fano coded,
- 8-bit codes of the smoothed log10 probability and, below the highest level, of the weight left to shorter contexts.

A word of a context is found by the successor of (value before the context) + 1 + id, in the context's own stretch.

Smoothing is interpolation: P(w|u) = (c(u,w) + m P(w|u')) / (c(u) + m), u' one word shorter, where the weight of the shorter context grows
with the context's count as the number of different words after it does: m = prior + growth c(u)^power. Words without context have (c + 0.1) / (N + 0.1 (V + 1)). Words are known by 64-bit hashes; two of a billion words share one with a chance of 3 %, which
would only add their counts.

Counting: each task makes keys (context place, word id) of its texts, adds up equal ones, and sends each shard its sorted keys as
differences, by byte planes. The shards' bounds split even a context that a third of all words follow. Reducers add up and write. A shard has
about `SHARD_TOKENS` tokens whatever the size of the scan's partitions, and texts go through in pieces of about `TEXT_BYTES`, so what a
worker holds doesn't grow with the input.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.elias_fano import Sequence, coded, mapped, to_bytes
from spindrift.llm.hashing import word_hashes
from spindrift.llm.shared import columns, documents, frames, give_back, hold, publish, scan_partitions, shared_folder, strings

U = np.uint64
#: What stands for the end among the words' hashes.
END = 0x51ED270B9F1C53A7
#: Tokens of a shard above level 1; a reducer's arrays are as long.
SHARD_TOKENS = 1 << 22
#: Keys that are added up, or looked up, at a time.
RUN, STEP = 2_000_000, 1 << 18
#: Bytes of texts that are looked up at a time; the arrays for that take some forty times as much.
TEXT_BYTES = 4_000_000
#: Reduce tasks at most; each takes several shards beyond it, one after the other.
TASKS = 2000


def fold(doc_id, folds: int = 10) -> int:
    """crc32 of the id as text, modulo `folds`; a null id counts as an empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included, and each text's number of tokens."""
    words, sizes = word_hashes(texts)
    ends = np.cumsum(sizes + 1) - 1
    out = np.empty(len(words) + len(texts), U)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = words, END
    return out, sizes + 1


def planes(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane, so that Spark's compression finds the empty planes."""
    return np.ascontiguousarray(np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U).ravel(), dtype=U)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their counts."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def codes(x: np.ndarray, bits: int = 8) -> dict[str, np.ndarray]:
    """Values in equal steps between the least and the largest; read back as the middle of the step's range."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / ((1 << bits) - 1) or 1.0
    return {"q": np.rint((x - low) / step).astype(np.uint8), "scale": np.array([low, step])}


@dataclass
class Level:
    """What the driver knows of a level: bounds of its shards' keys, places before each shard, and the first context of each."""

    bounds: np.ndarray
    offsets: np.ndarray
    size: int
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass(frozen=True)
class Prior:
    """What a shorter context weighs against a context's count."""

    least: float = 50.0
    growth: float = 2.0
    power: float = 0.9

    def weight(self, counts: np.ndarray) -> np.ndarray:
        return self.least + self.growth * np.asarray(counts, float) ** self.power

    def left(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the share that goes to the shorter context."""
        m = self.weight(counts)
        return np.log10(m / (counts + m))


@dataclass
class Trie:
    """A model in a shared folder. Small: a few numbers for each shard."""

    folder: str
    order: int
    prior: Prior
    total: int
    distinct: int
    levels: list[Level]

    @property
    def word_bits(self) -> int:
        return max(1, self.distinct.bit_length())


class Reader:
    """Lookups in a trie; one for each worker and folder."""

    def __init__(self, trie: Trie):
        self.trie, self.files = trie, {}

    @classmethod
    def of(cls, trie: Trie) -> Reader:
        return hold("trie", (trie.folder, len(trie.levels)), lambda: cls(trie))

    def shard(self, level: int, number: int) -> tuple:
        if (level, number) not in self.files:
            arrays = mapped(os.path.join(self.trie.folder, f"level{level}-{number:06d}"))
            self.files[level, number] = arrays, Sequence(arrays, "words"), Sequence(arrays, "pointers") if level > 1 else None
        return self.files[level, number]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each hash."""
        level, ids, counts = self.trie.levels[0], np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for number, at in by_shard(level.bounds, hashes):
            arrays, sequence, _ = self.shard(1, number)
            if sequence.n:
                found = sequence.find(hashes[at] - level.bounds[number])
                hit = at[found >= 0]
                ids[hit] = found[found >= 0] + level.offsets[number]
                counts[hit] = arrays["counts"][found[found >= 0]]
        return ids, counts

    def grams(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the level (-1 without one), log10 probability and log10 weight left of keys (context << word_bits | word)."""
        info, bits = self.trie.levels[level - 1], U(self.trie.word_bits)
        place, logp, left = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for number, at in by_shard(info.bounds, keys):
            arrays, words, pointers = self.shard(level, number)
            context = (keys[at] >> bits).astype(np.int64) - info.contexts[number]
            inside = (context >= 0) & (context + 1 < pointers.n)
            at, context = at[inside], context[inside]
            if not len(at):
                continue
            new = np.r_[True, context[1:] != context[:-1]]  # equal contexts stand together if keys are in order
            own, back = context[new], np.cumsum(new) - 1
            start, end = pointers.values(own).astype(np.int64), pointers.values(own + 1).astype(np.int64)
            base = np.zeros(len(own), U)
            later = np.flatnonzero(start > 0)
            base[later] = words.values(start[later] - 1) + U(1)
            found = words.find(base[back] + (keys[at] & ((U(1) << bits) - U(1))))
            ok = (found >= start[back]) & (found < end[back])
            hit, found = at[ok], found[ok]
            place[hit] = found + info.offsets[number]
            low, step = arrays["logp.scale"]
            logp[hit] = low + step * arrays["logp.q"][found]
            if "left.q" in arrays:
                low, step = arrays["left.scale"]
                left[hit] = low + step * arrays["left.q"][found]
        return place, logp, left

    def shorter(self, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 P(w|u) for bigrams (t, u) by their places in level 2 and words w."""
        info, last = self.trie.levels[1], np.zeros(len(places), np.int64)
        for number, at in by_shard(info.offsets.astype(U), places.astype(U)):
            _, sequence, pointers = self.shard(2, number)
            local, back = np.unique(places[at] - info.offsets[number], return_inverse=True)
            start = pointers.values(pointers.successor((local + 1).astype(U)) - 1).astype(np.int64)
            base = np.zeros(len(local), U)
            base[start > 0] = sequence.values(start[start > 0] - 1) + U(1)
            last[at] = (sequence.values(local) - base)[back].astype(np.int64)
        keys, back = np.unique((last.astype(U) << U(self.trie.word_bits)) | words, return_inverse=True)
        place, logp, _ = (x[back] for x in self.grams(2, keys))
        less = self.trie.prior.left(word_counts(self, last)) + self.base(word_counts(self, words.astype(np.int64)))
        return np.where(place >= 0, logp, less)

    def base(self, counts: np.ndarray) -> np.ndarray:
        t = self.trie
        return np.log10((counts + 0.1) / (t.total + 0.1 * (t.distinct + 1)))

    def tokens(self, hashes: np.ndarray, sizes: np.ndarray, upto: int) -> dict:
        """For each token: count, base log10 probability, and its n-gram's place and log10 probability for n-grams of up to `upto` words."""
        unique, back = np.unique(hashes, return_inverse=True)
        ids, counts = (x[back] for x in self.words(unique))
        base = self.base(counts)
        first = np.zeros(len(hashes), bool)
        first[np.cumsum(sizes) - sizes] = True
        end_id, end_count = (int(x[0]) for x in self.words(np.array([END], U)))
        context = np.r_[-1, ids[:-1]]
        context[first] = end_id  # a text starts after an end
        context_counts = np.r_[0, counts[:-1]]
        context_counts[first] = end_count
        bits = U(self.trie.word_bits)
        left = self.trie.prior.left(context_counts)
        out = {"ids": ids, "counts": counts, "base": base, "logp": base, "context": context, "context_counts": context_counts, "first": first}
        level = 2
        while level <= min(upto, self.trie.order) and level <= len(self.trie.levels):
            key = np.where((context >= 0) & (ids >= 0), (np.maximum(context, 0).astype(U) << bits) | np.maximum(ids, 0).astype(U), ~U(0))
            unique, back = np.unique(key, return_inverse=True)
            real = unique != ~U(0)
            place, logp, weight = np.full(len(unique), -1, np.int64), np.zeros(len(unique)), np.zeros(len(unique))
            place[real], logp[real], weight[real] = self.grams(level, unique[real])
            place, logp, weight = place[back], logp[back], weight[back]
            out["logp"] = np.where(place >= 0, logp, np.where(context >= 0, left, 0.0) + out["logp"])
            context, left = np.r_[-1, place[:-1]], np.r_[0.0, weight[:-1]]
            context[first] = -1  # longer n-grams start inside the text
            out["place"], out["context"] = place, context
            level += 1
        return out


def by_shard(bounds: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shards that keys belong to (bounds[i] <= key < bounds[i + 1]; the last has no end) and the keys' places."""
    if not len(keys):
        return
    number = np.searchsorted(bounds, keys, "right") - 1
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        if number[order[a]] >= 0:
            yield int(number[order[a]]), order[a:b]


def added(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and counts of all parts; equal keys are added up whenever `RUN` more have come."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > RUN:
            held, size = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))], 0
    return held[0] if len(held) == 1 else summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def count_level(train: DataFrame, keys_of, bounds: np.ndarray, write) -> list:
    """Rows (shard, n, total, cuts) of a level: `keys_of(texts)` gives keys, and `write(shard, keys, counts)` writes a shard of them; what it returns are the cuts.

    Each task adds up its own keys, in runs of a few million, and sends each shard the sorted rest. A shard is written once, by one task.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            cuts = np.r_[np.searchsorted(keys, bounds), len(keys)]
            some = [i for i in range(len(bounds)) if cuts[i] < cuts[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([planes(keys[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()), pa.array([counts[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary())], ["shard", "keys", "counts"])

        for batch in frames(batches, most_bytes=TEXT_BYTES):
            held.append(summed(keys_of(strings(batch.column(0)))))
            size += len(held[-1][0])
            if size > RUN:
                yield out()
                size = 0
        if held:
            yield out()

    def reduce(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        keys, counts = added((unplanes(k.as_buffer()), np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)) for k, c in zip(rows["keys"], rows["counts"], strict=True))
        del rows
        cuts = write(shard, keys, counts)
        n, total = len(keys), int(counts.sum())
        del keys, counts
        give_back()
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64()), "cuts": pa.array([cuts], pa.binary())})

    sent = train.mapInArrow(gather, "shard int, keys binary, counts binary")
    return sorted(sent.repartition(min(len(bounds), TASKS), "shard").groupBy("shard").applyInArrow(reduce, "shard int, n long, total long, cuts binary").collect())


def build(docs: DataFrame, order: int = 3, prior: Prior = Prior(), id_col: str = "doc_id", text_col: str = "text", folds: int = 10, shards: int | None = None) -> Trie:
    """Train on the whole texts of all rows whose fold isn't 0. Null texts are empty: a text of one end.

    `order` is 1, 2 or 3 and takes as many passes over the texts. Level 1 has as many shards as the scan has partitions, the others have one for about
    `SHARD_TOKENS` tokens, unless `shards` is given. What the driver gets is a row for each shard. Keys must fit 64 bits: bits of a level's places and of word ids together.
    """
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    source = columns(docs, doc_id=id_col, text=text_col)
    n = shards or max(4, scan_partitions(source))
    in_train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != 0
    train = source.where(in_train).select("text")
    folder = shared_folder(spark, "lm")

    bounds = np.array([(i << 64) // n for i in range(n)], U)

    def write_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
        span = (int(bounds[shard + 1]) if shard + 1 < n else 1 << 64) - int(bounds[shard])
        arrays = coded(keys - bounds[shard], span, "words") | {"counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else U)}
        publish(os.path.join(folder, f"level1-{shard:06d}"), to_bytes(arrays))
        return b""

    rows = {r["shard"]: r for r in count_level(train, lambda texts: token_hashes(texts)[0], bounds, write_words)}
    sizes = [rows[i]["n"] if i in rows else 0 for i in range(n)]
    for i in range(n):
        if i not in rows:
            publish(os.path.join(folder, f"level1-{i:06d}"), to_bytes(coded(np.zeros(0, U), 1, "words") | {"counts": np.zeros(0, np.uint32)}))
    trie = Trie(folder, order, prior, sum(r["total"] for r in rows.values()), sum(sizes), [Level(bounds, np.cumsum([0, *sizes[:-1]]), sum(sizes))])
    each = -(-trie.total // shards) if shards else SHARD_TOKENS
    cuts = None
    for level in range(2, order + 1):
        cuts = _add_level(train, trie, level, max(1, each), cuts)
    return trie


def _add_level(train: DataFrame, trie: Trie, level: int, each: int, places_cut: np.ndarray | None) -> np.ndarray:
    """Add a level with shards of about `each` tokens, above level 2 from the `places_cut` of the level below; returns the places at which the next one is cut."""
    bits, places = trie.word_bits, trie.levels[-1].size
    if places.bit_length() + bits > 64:
        raise ValueError(f"keys of level {level} need more than 64 bits")
    if not places:
        bounds = np.zeros(1, U)
    elif level == 2:  # as many tokens to each shard: a context's count tells how many follow it, and ids are evenly dealt within it
        bounds = _even_bounds(trie, -(-trie.total // each))
    else:  # contexts by their counts; one context isn't split, as its count is the sum of its n-grams'
        bounds = np.unique(np.r_[0, places_cut].astype(U) << U(bits))
    order, prior, folder = trie.order, trie.prior, trie.folder

    def keys_of(texts: list[str]) -> np.ndarray:
        reader = Reader.of(trie)
        hashes, sizes = token_hashes(texts)
        got = reader.tokens(hashes, sizes, level - 1)
        context = got["context"]
        ok = context >= 0
        return (context[ok].astype(U) << U(bits)) | got["ids"][ok].astype(U)

    def write(shard: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
        reader = Reader.of(trie)
        context, word = (keys >> U(bits)).astype(np.int64), keys & U((1 << bits) - 1)
        first = int(bounds[shard] >> U(bits))
        start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        lengths = np.diff(np.r_[start, len(keys)])
        pointers = np.searchsorted(context, np.arange(first, int(context[-1]) + 2))
        spans = word[start + lengths - 1] + U(1)  # what each context adds to the ones after it
        values = word + np.repeat(np.cumsum(spans, dtype=U) - spans, lengths)
        totals = word_counts(reader, context[start]) if level == 2 else np.add.reduceat(counts, start)
        context_count, p = np.repeat(totals, lengths), np.empty(len(keys))
        for i in range(0, len(keys), STEP):
            some = slice(i, i + STEP)
            shorter = reader.base(word_counts(reader, word[some].astype(np.int64))) if level == 2 else reader.shorter(context[some], word[some])
            m = prior.weight(context_count[some])
            p[some] = (counts[some] + m * 10.0**shorter) / (context_count[some] + m)
        del context, word, context_count
        arrays = coded(values, int(values[-1]) + 1, "words")
        del values
        arrays |= coded(pointers.astype(U), len(keys) + 1, "pointers") | {f"logp.{k}": v for k, v in codes(np.log10(p)).items()}
        if level < order:
            arrays |= {f"left.{k}": v for k, v in codes(prior.left(counts)).items()}
        publish(os.path.join(folder, f"level{level}-{shard:06d}"), to_bytes(arrays))
        if level == order:
            return b""
        upto, pieces = np.cumsum(counts), max(1, round(int(counts.sum()) / each))
        return np.searchsorted(upto, [int(upto[-1]) * i // pieces for i in range(pieces)], "right").astype(np.int64).tobytes()

    rows = {r["shard"]: r for r in count_level(train, keys_of, bounds, write)}
    sizes = [rows[i]["n"] if i in rows else 0 for i in range(len(bounds))]
    empty = coded(np.zeros(0, U), 1, "words") | coded(np.zeros(1, U), 1, "pointers") | {f"logp.{k}": v for k, v in codes(np.zeros(0)).items()}
    for i in range(len(bounds)):
        if i not in rows:
            publish(os.path.join(folder, f"level{level}-{i:06d}"), to_bytes(empty))
    level_ = Level(bounds, np.cumsum([0, *sizes[:-1]]), sum(sizes), (bounds >> U(bits)).astype(np.int64))
    trie.levels.append(level_)
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["cuts"], np.int64) + level_.offsets[i] for i, r in sorted(rows.items()))])


def word_counts(reader: Reader, ids: np.ndarray) -> np.ndarray:
    """Counts of words by id."""
    level, out = reader.trie.levels[0], np.zeros(len(ids), np.int64)
    for number, at in by_shard(level.offsets.astype(U), ids.astype(U)):
        out[at] = reader.shard(1, number)[0]["counts"][ids[at] - level.offsets[number]]
    return out


def _even_bounds(trie: Trie, n: int) -> np.ndarray:
    """Bounds of n ranges of (context, word) with about as many tokens each, from the words' counts alone."""
    reader, level = Reader(trie), trie.levels[0]
    sums = [int(reader.shard(1, i)[0]["counts"].sum(dtype=np.int64)) for i in range(len(level.bounds))]
    before, out = np.cumsum([0, *sums]), [U(0)]
    for i in range(1, n):
        want = trie.total * i // n
        shard = int(np.searchsorted(before, want, "right")) - 1
        inside = np.cumsum(reader.shard(1, shard)[0]["counts"], dtype=np.int64)
        place = int(np.searchsorted(inside, want - before[shard], "right"))
        done = want - before[shard] - (int(inside[place - 1]) if place else 0)
        of = int(inside[place]) - (int(inside[place - 1]) if place else 0)
        out.append((U(int(level.offsets[shard]) + place) << U(trie.word_bits)) | U(trie.distinct * done // of))
    return np.unique(np.array(out, U))


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Rows doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each whole text. No shuffle.

    Null texts are empty, which is one token, the end. A null id counts as an empty text in the fold. Each row gives a row.
    """
    id_type = columns(docs, doc_id=id_col).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(trie)
        for batch in frames(batches, most_bytes=TEXT_BYTES):
            hashes, sizes = token_hashes(strings(batch.column(1)))
            got = reader.tokens(hashes, sizes, trie.order)
            start = np.cumsum(sizes) - sizes
            add = lambda x, t: pa.array(np.add.reduceat(x, start).astype(t))
            held = [fold(x, folds) == 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(sizes), add((got["counts"] > 0).astype(np.int64), np.int64), pa.array(np.full(len(sizes), trie.total, np.int64)), add(got["base"], float), add(got["logp"], float)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_ngram_trie(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, build(docs))
