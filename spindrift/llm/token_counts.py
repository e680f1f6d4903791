"""Token counts by rank-synchronous merging of ragged numpy arrays.

The vocabulary is a SentencePiece BPE model with byte fallback. A text is cut into pre-tokens at places that no piece spans: before
a run of word marks, and around characters that are no piece (these become bytes). The distinct pre-tokens of a batch are held as one
ragged array of piece ids. In each round, every sequence looks up its adjacent pairs in the pair table, takes its pair of lowest rank
(leftmost of equals, as the library's agenda does) and merges it; all sequences do so at once. Sequences without a pair are counted
and leave the array. A worker keeps counts of pre-tokens it has seen, up to `cache` of them.

In a round, a pair is merged as well if no pair of lower rank (or equal rank, on its left) is within `reach` symbols of it, the length of
the longest piece. What such a pair could set off before stays in the one symbol that grows from it, which never has more characters than
that, so it can't reach this pair: the merges are those of the agenda, and a long sequence takes many of them in a round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm.shared import columns, frames, hold, strings, tokenizer_path

MARK = "▁"
NONE = np.int64(1 << 40)


class MergeTable:
    """Pieces, and for each pair of pieces the piece that they make and its rank."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        normal = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        scores = np.array([model.get_score(i) for i in range(size)])
        by_score = np.unique(-scores)
        rank = np.searchsorted(by_score, -scores)
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece spans words; pre-tokens can't be cut before word marks")
        keys, made = [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    made.append(i)
        order = np.argsort(keys)
        self.size, self.keys, self.made = size, np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.rank = rank[self.made].astype(np.int64)
        self.reach = max(map(len, normal), default=1)
        self.char = {p: i for p, i in normal.items() if len(p) == 1}
        self.of_code = np.full(0x110000, -1, np.int64)
        for c, i in self.char.items():
            self.of_code[ord(c)] = i

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one) and place in the table of each pair."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def count(self, sequences: list[str], step: int = 1_000_000) -> np.ndarray:
        """Tokens of each pre-token; about `step` characters at a time."""
        total = np.zeros(len(sequences), np.int64)
        first, size = 0, 0
        for i, x in enumerate(sequences):
            size += len(x)
            if size >= step or i + 1 == len(sequences):
                total[first : i + 1] = self._by_rounds(sequences[first : i + 1])
                first, size = i + 1, 0
        return total

    def _alone(self, rank: np.ndarray) -> np.ndarray:
        """Places of pairs without one of lower rank, or of equal rank on the left, within `reach`."""
        n, r = len(rank), self.reach
        least = np.full(n + 2 * r, NONE)
        least[r : r + n] = rank
        width, left = 1, None
        while width < r:  # least of stretches of r, from each place on
            more = min(width, r - width)
            least[: len(least) - more] = np.minimum(least[: len(least) - more], least[more:])
            width += more
        left, right = least[:n], least[r + 1 : r + 1 + n]
        return np.flatnonzero((rank < left) & (rank <= right) & (rank < NONE))

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters, -1 for those that are no piece, and the bytes beyond one of each of the latter."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        ids = self.of_code[codes]
        more = (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        return ids, np.where(ids < 0, more, 0)

    def _by_rounds(self, sequences: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        flat, more = self._symbols("".join(sequences))
        sums = np.r_[0, np.cumsum(more)]
        ends = np.cumsum(lengths)
        extra = sums[ends] - sums[ends - lengths]
        counts = lengths.copy()
        owner = np.repeat(np.arange(len(sequences)), lengths)
        rank, at = np.full(len(flat), NONE), np.zeros(len(flat), np.int64)
        if len(flat) > 1:
            rank[:-1], at[:-1] = self.pairs(flat[:-1], flat[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NONE
        while len(flat):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(flat)])
            going = np.repeat(lowest < NONE, sizes)
            if not going.all():  # finished sequences leave
                flat, owner, rank, at = flat[going], owner[going], rank[going], at[going]
                sizes, lowest = sizes[lowest < NONE], lowest[lowest < NONE]
                if not len(flat):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]  # the leftmost of each sequence
            if sizes.max() > 2 * self.reach:
                hit = np.union1d(hit, self._alone(rank))
            flat[hit] = self.made[at[hit]]
            np.subtract.at(counts, owner[hit], 1)
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            moved = (np.cumsum(keep) - 1)[hit]
            flat, owner, rank, at = flat[keep], owner[keep], rank[keep], at[keep]
            for left in (moved, moved - 1):  # only pairs that touch a merged symbol change
                left = left[left >= 0]
                right = np.minimum(left + 1, len(flat) - 1)
                rank[left], at[left] = self.pairs(flat[left], flat[right])
                rank[left[(right == left) | (owner[left] != owner[right])]] = NONE
        return counts + extra


class Counter:
    """Counts texts; one for each worker and model."""

    def __init__(self, model_file: str, cache: int):
        self.table, self.cache, self.seen = MergeTable(model_file), cache, {}
        self.newline_apart = "\n" not in self.table.char and not any("\n" in p for p in self.table.char)
        self.odd = re.compile(f"^ |  |{MARK}")
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+" if self.newline_apart else f"{MARK}*[^{MARK}]+|{MARK}+")

    @classmethod
    def of(cls, model_file: str, cache: int) -> Counter:
        return hold("token counts", (model_file, cache), lambda: cls(model_file, cache))

    def pretokens(self, text: str) -> list[str]:
        """Parts between which no piece spans; newlines, when they are no piece, are left out."""
        if not text:
            return []
        if self.odd.search(text):
            return self.cut.findall(MARK + text.replace(" ", MARK))
        spaced = (MARK + text).replace(" ", " " + MARK)
        return (spaced.replace("\n", " ") if self.newline_apart else spaced).split(" ")

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.pretokens(t) for t in texts]
        if len(self.seen) > self.cache:
            self.seen.clear()
        seen = self.seen
        new = set().union(*parts).difference(seen) if parts else set()
        if new:
            listed = sorted(new)
            seen.update(zip(listed, self.table.count(listed).tolist(), strict=True))
        seen[""] = 0
        get = seen.__getitem__
        return [sum(map(get, p)) + (t.count("\n") if self.newline_apart else 0) for p, t in zip(parts, texts, strict=True)]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", cache: int = 400_000) -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of `docs`.

    Null and empty texts have 0 bytes and tokens. Repeated rows and null ids give a row each. Texts are read whole; other columns aren't read. No shuffle.
    """
    id_type = columns(docs, doc_id=id_col).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model_file, cache)
        for batch in frames(batches):
            texts = strings(batch.column(1))
            n = counter.count(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    from spindrift.llm.shared import documents

    return count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
