"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits are cut into blocks so that two within the threshold differ in at most one bit of some block. The anchors of a
block are the words of a Hamming code over its first 2^r - 1 bits (covering radius 1), with any values of the few bits left over. Every
fingerprint goes to all anchors within radius + 1 = 2 of its block; one of them is its home, at distance 1 at most. If x and y differ
in at most one bit of the block, then y is within 2 of x's home, so they meet there and are compared over all 64 bits.

Equal fingerprints are one class from the start. Anchors with many fingerprints are split into cells (see components.cells), in which
a spanning forest of the links is reported, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.components import cells, components, spread_join
from spindrift.llm.shared import columns, documents, frames, settle, strings

LANES = np.uint64(0x0101010101010101)


def words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(parts: list[bytes], size: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `size` words, repeats included; of all words, if there are fewer; none without words."""
    h = xxhash.xxh64_intdigest
    if len(parts) < size:
        return [h(b" ".join(parts), seed)] if parts else []
    return [h(b" ".join(parts[i : i + size]), seed) for i in range(len(parts) - size + 1)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of consecutive groups of hashes, of the sizes given, the 64 bits that are set in over half of its hashes; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    pieces = -(-sizes // 255)  # runs of at most 255 hashes, whose sums fit a byte for each bit
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * 255
    first = np.cumsum(pieces) - pieces
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, fp (long): the SimHash of each row's whole text. Null, empty and blank texts have 0. No shuffle."""
    id_type = columns(docs, doc_id=id_col).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            flat, counts = [], []
            for text in strings(batch.column(1)):
                got = shingle_hashes(words(text), shingle)
                flat.append(np.array(got, np.uint64))
                counts.append(len(got))
            fp = majority(np.concatenate(flat) if flat else np.zeros(0, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {id_type}, fp long")


class Covering:
    """Anchors of the blocks of 64 bits for a threshold: a block for each two differing bits, rounded up."""

    def __init__(self, threshold: int):
        self.blocks = (threshold + 2) // 2
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        self.spans = list(zip(cuts, cuts[1:], strict=False))

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each fingerprint all anchors within distance 2 of each block: row number, anchor (a key over all blocks), and whether it is the home."""
        rows, keys, homes = [], [], []
        for block, (low, high) in enumerate(self.spans):
            width = high - low
            part = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1) if width < 64 else fp
            coded = (1 << ((width + 1).bit_length() - 1)) - 1
            syndrome = np.zeros(len(fp), np.uint64)
            for i in range(1, coded + 1):
                syndrome ^= ((part >> np.uint64(i - 1)) & np.uint64(1)) * np.uint64(i)
            bit = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
            home = part ^ bit
            off = syndrome > 0
            found = [(np.ones(len(fp), bool), home, True)]
            for i in range(1, coded + 1):  # two coded bits whose numbers xor to the syndrome
                j = syndrome ^ np.uint64(i)
                ok = off & (j > i) & (j <= coded)
                found.append((ok, part ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (np.where(ok, j, np.uint64(1)) - np.uint64(1))), False))
            for i in range(coded, width):  # one bit of the rest, and two where no coded bit is off
                found.append((np.ones(len(fp), bool), home ^ np.uint64(1 << i), False))
                found += [(~off, part ^ np.uint64(1 << i) ^ np.uint64(1 << j), False) for j in range(i + 1, width)]
            for ok, anchor, is_home in found:
                at = np.flatnonzero(ok)
                rows.append(at)
                keys.append(anchor[at] * np.uint64(self.blocks) + np.uint64(block) if self.blocks > 1 else anchor[at])
                homes.append(np.full(len(at), is_home))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(near: Callable[[int, np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """A spanning forest of n items; near(i, others) tells which of the others item i links to. Each item is compared with those not reached yet."""
    links, left = [], np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            queue += (new := left[hit].tolist())
            links += [(at, x) for x in new]
            left = left[~hit]
    return links


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and group starts (with the end) of whole groups of rows that agree in the first `by` columns and stand together."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept and all(a[-1] == b[0] for a, b in zip(kept[-1][:by], now[:by], strict=True)) and all((c == c[0]).all() for c in now[:by]):
            kept.append(now)  # all of it goes on with the group
            continue
        kept.append(now)
        cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:by]], axis=0)) + 1
        if len(change):
            yield [c[: change[-1]] for c in cols], np.r_[0, change]
            cols = [c[change[-1] :] for c in cols]
        kept = [cols]
    if kept:
        cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:by]], axis=0)) + 1
        yield cols, np.r_[0, change, len(cols[0])]


def links(classes: DataFrame, threshold: int = 3, cell: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` of `classes` whose components are those of all pairs within the threshold."""
    covering = Covering(threshold)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches, 20_000):
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            row, key, home = covering.anchors(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, signed, home), starts in groups(batches, 3):
            fp, a, b = signed.view(np.uint64), [], []  # numpy counts the bits of a signed number's absolute value
            sizes = np.diff(starts)
            for at in np.flatnonzero(sizes > 32):
                own = fp[starts[at] : starts[at + 1]]
                for i, j in forest(lambda i, others, own=own: np.bitwise_count(own[i] ^ own[others]) <= threshold, len(own)):
                    a.append(own[i : i + 1])
                    b.append(own[j : j + 1])
            size = np.repeat(sizes, sizes)
            place = np.arange(len(fp)) - np.repeat(starts[:-1], sizes)
            for d in range(1, 32):
                i = np.flatnonzero((size <= 32) & (place + d < size))
                if not len(i):
                    break
                i = i[(home[i] | home[i + d]) & (np.bitwise_count(fp[i] ^ fp[i + d]) <= threshold)]
                a.append(fp[i])
                b.append(fp[i + d])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    replicas = classes.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    by = ["anchor", "cell_lo", "cell_hi"]
    dealt = cells(replicas, "anchor", "fp", cell).select(*by, "fp", "home")
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, threshold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links of at most `threshold` differing bits reach.

    Each row of `docs` gives a row. Null and empty texts have fingerprint zero and are linked like any other. Null ids get a component_id
    but are none, unless all of a component are null. An empty table gives an empty one. No link is lost, whatever the size of a bucket.
    """
    each = settle(fingerprints(docs, shingle, id_col, text_col))
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes, threshold))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    linked = rooted.where("root IS NOT NULL")
    named = spread_join(linked, linked.groupBy("root").agg(F.min("least").alias("component_id")), "root", ["fp"]).select("fp", "component_id")
    named = named.unionByName(rooted.where("root IS NULL").select("fp", F.col("least").alias("component_id")))
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
