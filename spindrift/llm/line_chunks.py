"""Removal of repeated multi-line chunks.

Lines are hashed. The rolling hash of a line is a polynomial over the hashes of the fewest lines from it on that hold `chunk_words` words.
Boundaries are winnowed: in every shortest stretch of lines that holds `spread_words` words, the line of the least rolling hash (the first
of equals) is one, so boundaries depend on the lines around them only and resist shifts. A chunk begins at each boundary and goes on, over
lines of any length, until it has `chunk_words` words. A passage of chunk_words + spread_words - 1 words or more, whatever its lines, holds
a whole chunk wherever it stands (its first stretch of spread_words words has its least line in every text), so all its copies meet.

1. Hashes of chunks and their places go through one shuffle, without any text; a hash that occurs once is done with.
2. The texts of the rest are cut out and compared byte by byte: rows of equal hashes and equal text are one class. In each class the least
   place (by id, place in the text, hash of the text) stays and all others go.
3. What goes is extended line by line to both sides, while the lines equal those beside the place that stays; if that is in the same text,
   not over lines of repeated chunks. What stays is always the least place, so of equal lines one is left. Lines of `spread_words` words begin chunks themselves, so only shorter ones, and few words of them, are sent for that: less than
   spread_words before a chunk, less than chunk_words + spread_words - 1 after it, which is as far as a passage reaches beyond its chunks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import broadcast_if_small, columns, documents, frames, free_name, settle, strings

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
HALF = 1 << 63
#: Most lines, blank ones included, that a chunk is extended by on a side.
MOST_BESIDE = 64


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


class Chunker:
    """Chunks of a text's lines as (first line, line after the last, hash), ascending by first line."""

    def __init__(self, chunk_words: int = 25, spread_words: int = 25):
        self.chunk_words, self.spread_words = chunk_words, spread_words

    def _ends(self, sizes: list[int], words: int) -> list[int]:
        """For each line the end of the fewest lines from it on that hold so many words; 0 where there are too few, and for lines without words."""
        out, end, total = [0] * len(sizes), 0, 0
        for i, size in enumerate(sizes):
            while total < words and end < len(sizes):
                total += sizes[end]
                end += 1
            if total < words:
                break
            if size:
                out[i] = end
            total -= size
        return out

    def cut(self, lines: list[str]) -> list[tuple[int, int, int]]:
        sizes = [len(x.split()) for x in lines]
        chunk_ends = self._ends(sizes, self.chunk_words)
        stretch_ends = chunk_ends if self.chunk_words == self.spread_words else self._ends(sizes, self.spread_words)
        before, powers = [0], [1]
        for x in lines:
            before.append((before[-1] * BASE + line_hash(x)) & MASK)
            powers.append(powers[-1] * BASE & MASK)
        rolling = [(before[e] - before[i] * powers[e - i]) & MASK if e else MASK for i, e in enumerate(chunk_ends)]
        found, least, ahead = set(), deque(), 0  # least: lines of the stretch whose rolling hash no later line undercuts
        for i, end in enumerate(stretch_ends):
            if not end:
                continue
            while ahead < end:
                if chunk_ends[ahead]:
                    while least and rolling[least[-1]] > rolling[ahead]:
                        least.pop()
                    least.append(ahead)
                ahead += 1
            while least and least[0] < i:
                least.popleft()
            if least:
                found.add(least[0])
        return [(i, chunk_ends[i], rolling[i]) for i in sorted(found)]

    def beside(self, lines: list[str], first: int, after: int) -> tuple[str, str]:
        """The short lines before and after a chunk that its extension may need, each with its line end, the nearest first."""
        out = []
        for at, step, words in ((first - 1, -1, self.spread_words - 1), (after, 1, self.chunk_words + self.spread_words - 2)):
            near = []
            while 0 <= at < len(lines) and len(near) < MOST_BESIDE:
                size = len(lines[at].split())
                words -= size
                if size >= self.spread_words or words < 0:
                    break
                near.append(lines[at] + "\n")
                at += step
            out.append("".join(near))
        return out[0], out[1]


def _places(docs: DataFrame, chunker: Chunker) -> DataFrame:
    """Rows doc_id, text_hash, place (the chunk's number in its text), hash, check (of the bytes), apart (lines lie between it and the chunk before). Places of a chunk in a text don't overlap."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            row, place, hashes, checks, apart = [], [], [], [], []
            for i, text in enumerate(strings(batch.column(2))):
                lines, ends, last = text.split("\n"), {}, 0
                for n, (a, b, h) in enumerate(chunker.cut(lines)):
                    if a >= ends.get(h, 0):
                        ends[h] = b
                        row.append(i)
                        place.append(n)
                        hashes.append(h - HALF)
                        checks.append(xxhash.xxh64_intdigest("\n".join(lines[a:b]).encode("utf-8", "surrogatepass"), 1) - HALF)
                        apart.append(a > last)
                    last = max(last, b)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int32()), pa.array(hashes, pa.int64()), pa.array(checks, pa.int64()), pa.array(apart, pa.bool_())], ["doc_id", "text_hash", "place", "hash", "check", "apart"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {id_type}, text_hash long, place int, hash long, check long, apart boolean")


def _texts(wanted: DataFrame, chunker: Chunker) -> DataFrame:
    """Rows hash, check, chunk, doc_id, text_hash, place, before, after of the places wanted (doc_id, text_hash, text, places)."""
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            row, out = [], []
            for i, (text, places) in enumerate(zip(strings(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                lines = text.split("\n")
                cuts = chunker.cut(lines)
                for n in places:
                    a, b, h = cuts[n]
                    chunk = "\n".join(lines[a:b])
                    row.append(i)
                    out.append((h - HALF, xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), 1) - HALF, chunk, n, *chunker.beside(lines, a, b)))
            at = pa.array(row, pa.int64())
            h, c, chunk, n, before, after = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(chunk, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int32()), pa.array(before, pa.string()), pa.array(after, pa.string())], ["hash", "check", "chunk", "doc_id", "text_hash", "place", "before", "after"])

    return wanted.select("doc_id", "text_hash", "text", "places").mapInArrow(run, f"hash long, check long, chunk string, doc_id {id_type}, text_hash long, place int, before string, after string")


def _same_row(left: DataFrame, id_col: str, text_hash: str) -> F.Column:
    return (F.col(text_hash) == F.col("__hash")) & left[f"`{id_col}`"].eqNullSafe(F.col("__id"))


def repeated_places(own: DataFrame, chunker: Chunker, most_broadcast: int) -> DataFrame:
    """Rows __id, __hash, __places: for each text of `own` (doc_id, text, text_hash) with repeated chunks its array of (place, goes, own, before, after).

    own: the place that stays is in the same text; before and after are the lines beside it. Places that stay have neither, nor have places
    beside another that goes for the place beside the same one, as that one's extension is as long.
    """
    places = settle(_places(own, chunker))
    repeated = places.groupBy("hash", "check").agg(F.count("*").alias("n")).where("n > 1").select("hash", "check")
    hits = settle(places.join(repeated, ["hash", "check"], "left_semi"))
    by_text = settle(hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_set("place")).alias("places")))
    wanted = own.join(broadcast_if_small(by_text, F.lit(24) + 4 * F.size("places"), most_broadcast), _same_row(own, "doc_id", "text_hash")).drop("__id", "__hash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "text_hash", "before", "after")).alias("stays")
    classes = _texts(wanted, chunker).groupBy("hash", "check", "chunk").agg(least, F.count("*").alias("n")).drop("chunk")
    alone = Window.partitionBy("hash", "check")  # two texts of equal hashes: neither is removed
    classes = settle(classes.withColumn("texts", F.count("*").over(alone)).where("texts = 1 AND n > 1").select("hash", "check", "stays"))  # apart from the join, so that Spark may split a hot chunk there
    found = hits.join(classes, ["hash", "check"])
    own_text = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    found = found.withColumn("own", own_text).withColumn("goes", ~(F.col("own") & (F.col("place") == F.col("stays.place"))))
    beside = [F.when(F.col("goes") & (F.col(f"stays.{side}") != ""), F.col(f"stays.{side}")).alias(side) for side in ("before", "after")]
    kept = [F.xxhash64("stays.doc_id", "stays.text_hash").alias("text"), F.col("stays.place").alias("at")]
    entries = found.select("doc_id", "text_hash", F.struct("place", "goes", "own", "apart", *kept, *beside).alias("e"))
    grouped = entries.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_set("e")).alias("e")).where(F.exists("e", lambda e: e["goes"]))

    def trimmed(e: F.Column, i: F.Column) -> F.Column:
        def goes_on(a: F.Column, b: F.Column) -> F.Column:
            return F.coalesce(a["goes"] & b["goes"] & (a["place"] + 1 == b["place"]) & ~b["apart"] & (a["text"] == b["text"]) & (a["at"] + 1 == b["at"]), F.lit(False))

        before, after = F.get("e", i - 1), F.get("e", i + 1)
        return F.struct(e["place"].alias("place"), e["goes"].alias("goes"), e["own"].alias("own"), F.when(~goes_on(before, e), e["before"]).alias("before"), F.when(~goes_on(e, after), e["after"]).alias("after"))

    return settle(grouped.select("__id", "__hash", F.transform("e", trimmed).alias("__places")))


def _near(context: str | None) -> list[str]:
    return context.split("\n")[:-1] if context else []


def without_repeats(lines: list[str], cuts: list[tuple[int, int, int]], entries: list[dict]) -> list[tuple[int, int]]:
    """What goes as (first, after), from the entries of repeated_places."""
    held = {i for e in entries for i in range(*cuts[e["place"]][:2])}
    out = []
    for e in entries:
        if not e["goes"]:
            continue
        first, after = cuts[e["place"]][:2]
        ends = []
        for at, step, near in ((first - 1, -1, _near(e["before"])), (after, 1, _near(e["after"]))):
            edge = at
            for line in near:
                if not 0 <= at < len(lines) or e["own"] and at in held or lines[at] != line:
                    break
                at += step
                if line.split():  # blank lines go only between lines that go
                    edge = at
            ends.append(edge)
        out.append((ends[0] + 1, ends[1]))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 25, spread_words: int = 25, most_broadcast: int = 32 << 20) -> DataFrame:
    """`docs` with all its columns, the text without the lines that go, and removed: array of (first, after), lines from 0, for each chunk that went.

    Where `docs` has a column named removed, the new one is removed_1 (or the next number that is free). A text that loses nothing stays as it
    is, a null text null and an empty one empty. Rows equal in id and text lose the same lines: together they are one text. Rows that share an
    id but not the text are texts of their own. Null ids come last, so a chunk stays in such a row only where no other has it. Empty tables
    give empty ones. Tables of places are summed up first, and broadcast up to `most_broadcast` bytes, else joined by a shuffle, where Spark
    splits hot keys. Equal chunks are added up in each task before they are sent.
    """
    chunker = Chunker(chunk_words, spread_words)
    own = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_hash", F.xxhash64("text"))
    going = repeated_places(own, chunker, most_broadcast)
    size = F.lit(24) + F.aggregate("__places", F.lit(0), lambda s, e: s + 16 + F.coalesce(F.length(e["before"]), F.lit(0)) + F.coalesce(F.length(e["after"]), F.lit(0)))
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))))
    marked = hashed.join(broadcast_if_small(going, size, most_broadcast), _same_row(docs, id_col, "__text_hash"), "left").select(*[docs[f"`{c}`"] for c in docs.columns], "__places")
    names, removed_col = docs.columns, free_name(docs, "removed")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            texts, removed = batch.column(at), []
            for i, entries in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                gone = []
                if entries:
                    if isinstance(texts, pa.Array):
                        texts = texts.to_pylist()
                    lines = texts[i].split("\n")
                    gone = without_repeats(lines, chunker.cut(lines), entries)
                    out = set().union(*(range(a, b) for a, b in gone))
                    texts[i] = "\n".join(x for n, x in enumerate(lines) if n not in out)
                removed.append([{"first": a, "after": b} for a, b in gone])
            cols = [*batch.columns[:-1], pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))]
            cols[at] = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*names, removed_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{removed_col}` array<struct<first:int,after:int>>"
    return marked.mapInArrow(run, schema)


def op8_line_chunks(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    lines = F.size(F.array_distinct(F.flatten(F.transform("removed", lambda x: F.sequence(x["first"], x["after"] - 1))))).cast("long")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed_chunks"), lines.alias("n_removed_lines"))
