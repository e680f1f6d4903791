"""Bounded-space online best-fit packing of token sequences.

Texts become token ids (`token_pieces`), sequences longer than the capacity are cut, and the pieces are packed (`pack`): each task keeps a
fixed number of open bins, indexed by a bitset whose bit f is set while some open bin has f tokens free. A piece goes to the bin with
the least room that holds it: the lowest set bit from the piece's length on. If none holds it, a bin is opened; if that is one too many,
the fullest, which is the lowest set bit of all, closes first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import columns, documents, frames, free_name, hold, settle, strings, tokenizer_path

#: Letters and white space of Latin-1, after lower-casing.
LETTERS, BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "\t-\r \x85\xa0"


class WordIds:
    """Ids of texts by a tokenizer whose words never span white space; ids of parts that a worker has seen are kept, up to `cache` of them.

    A text in Latin-1 without apostrophes is cut into runs of letters and of other characters, lower-cased; any other text only at
    blanks. Both are places where the tokenizer's own rule cuts, so ids of the parts put together are those of the text.
    """

    def __init__(self, path: str, cache: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.seen, self.before = Tokenizer.from_file(path), cache, {}, {}
        self.fine = re.compile(f"[{LETTERS}]+|[^{BLANKS}{LETTERS}]+").findall
        self.specials = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "$^")

    @classmethod
    def of(cls, path: str, cache: int) -> WordIds:
        return hold("word ids", (path, cache), lambda: cls(path, cache))

    def parts(self, text: str) -> list[str]:
        if "'" not in text and not self.specials.search(text):
            try:
                text.encode("latin-1")
                return self.fine(text.lower())
            except UnicodeEncodeError:
                pass
        return text.split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self.parts(t) for t in texts]
        if len(self.seen) > self.cache:
            self.seen, self.before = {}, self.seen
        new = list(set().union(*parts).difference(self.seen))
        if self.before:  # of the words kept before, those still in use move on
            self.seen.update((w, self.before[w]) for w in new if w in self.before)
            new = [w for w in new if w not in self.before]
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            self.seen.update((w, array("I", got.ids).tobytes()) for w, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        get = self.seen.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache: int = 400_000) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 (and ids, if asked for): the ids of each row's text, then `end_id`, in pieces of at most `capacity`.

    Only longer sequences are cut; the last piece of one may be shorter. A null or empty text is the end id alone. Repeated rows and null
    ids give their own pieces. ids_crc32 is that of the piece's little-endian unsigned 32-bit ids. No shuffle.
    """
    id_type = columns(docs, doc_id=id_col).schema["doc_id"].dataType.simpleString()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_file, cache)
        end = np.array([end_id], "<u4").tobytes()
        for batch in frames(batches):
            row, piece, cut = [], [], []
            for i, ids in enumerate(words.ids(strings(batch.column(1)))):
                ids += end
                for k in range(0, len(ids), width):
                    row.append(i)
                    piece.append(k // width)
                    cut.append(ids[k : k + width])
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)


class OpenBins:
    """A fixed number of open bins. place() returns the bin's number and the offset in it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.opened = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't go into {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, room = self.opened, self.capacity
            self.opened += 1
        if room > length:
            self.free[room - length].append(number)
            self.bits |= 1 << (room - length)
            self.open += 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        at = self.free[room]
        number = at.pop()
        if not at:
            self.bits ^= 1 << room
        self.open -= 1
        return number


def packing_order(pieces: DataFrame) -> list[F.Column]:
    """An order by the pieces' values alone, mixed by a hash, so that long and short pieces come in turns. Rows that it can't tell apart are equal but for columns that it doesn't read."""
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    return [F.xxhash64("length", *keys), F.col("length"), *[F.col(c) for c in keys]]


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 256, task_tokens: int = 1 << 26) -> DataFrame:
    """`pieces` (any columns, `length` among them) with sequence_id and offset: the place of each piece, gapless within its sequence.

    The pieces are written to the shared folder first and their tokens are added up, so the number of tasks follows from the data: each
    packs about `task_tokens` tokens in one pass with `open_bins` bins and no other state. Rows are dealt out evenly whatever their keys,
    and sorted within a task (packing_order), so a task that runs again packs as before, however its rows arrive. Ties and repeated rows
    have places of their own; null ids are packed like others; an empty table gives an empty one. Where `pieces` has a column sequence_id
    or offset, the new one gets the next free number (sequence_id_1). Lengths must be from 1 to `capacity`; null lengths raise an error.
    """
    pieces = settle(pieces)
    total = pieces.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // task_tokens))
    added = [free_name(pieces, "sequence_id"), free_name(pieces, "offset")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), *(f"`{c}` long" for c in added)])
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(x) for x in batch.column(at).to_pylist()]
            number, offset = zip(*places, strict=True) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + x for x in number], pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, *added])

    return pieces.repartition(n).sortWithinPartitions(*packing_order(pieces)).mapInArrow(run, schema)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))
