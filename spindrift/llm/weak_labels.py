"""A classifier from weak labels.

Overlapping heuristic labellers vote 1, 0 or abstain (-1) on each text; a table of human labels, which may cover some rows, fixes the class
of these. Texts are counted by their vector of votes and label, in Spark; the table has at most 3^(n + 1) rows for n labellers and goes to
the driver. Expectation-maximisation over it estimates the share of each class and, for each
labeller and class, how often it votes what, as if votes were independent within a class; it gives the posterior of each vector. The
posteriors of a bounded sample of texts (about `sample` rows, by a hash of the text) train a linear scorer over hashed words and beginnings
of words, by logistic loss, and the scorer judges every text. Only columns whose share differs between the classes by `least_z` standard
errors, and `least_odds`-fold, get weights: rare words are many, and chance alone ties some to a class. Where there are human labels, texts with neither label nor vote say nothing
about the class, and the scorer isn't trained on them. Rows that only labellers call toxic weigh `UNLABELLED` of one with a human label: the
labellers know few insults, and their many rows would drown the few of other languages.

Two models are made in the same passes: quality (1: natural prose) and toxic (1: insults).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.decontaminate import word_features
from spindrift.llm.quality_rules import text_counts
from spindrift.llm.shared import columns, documents, frames, strings

#: Insults to persons, and contempt, in several languages. Words that are common in another of these languages are left out.
PERSONS = "idiot idiots moron morons loser losers clown clowns scum scumbag imbecile imbeciles dumbass bastard bastards cretin cretins idiota idiotas imbécile imbéciles abruti connard dummkopf trottel gilipollas"
CONTEMPT = "stupid pathetic worthless disgusting trash garbage filthy despicable dumb idiotic moronic stupide pathétique dégoûtant wertlos widerlich erbärmlich patético asqueroso estúpido estúpida"
LISTS = [frozenset(x.split()) for x in (PERSONS, CONTEMPT)]
ANY = re.compile(r"(?<!\w)(?:" + "|".join(sorted(PERSONS.split() + CONTEMPT.split())) + r")(?!\w)")

QUALITY = ["symbols", "repeats", "lines", "variety", "capitals", "letters", "sentences"]
TOXIC = ["persons", "contempt", "kinds", "density"]
BUCKETS = 16
#: Whether str.isupper holds, by code; the last entry, which is none, stands for all codes beyond.
IS_CAPITAL = np.array([chr(i).isupper() for i in range(0x20000)])
#: Whole words, and their first bytes: each kind has columns of its own.
PREFIXES = (None, 5, 7)
#: The weight of a row without a human label in training, where there are such labels, by model.
UNLABELLED = {"quality": 1.0, "toxic": 0.005}


def vote(bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


def count_capitals(text: str) -> int:
    """Characters of the whole text for which str.isupper holds."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(np.count_nonzero(IS_CAPITAL[np.minimum(codes, len(IS_CAPITAL) - 1)]))


def measure(text: str) -> tuple[list[int], list[int], list[int]]:
    """Votes on quality and on toxicity, and buckets (0 to BUCKETS - 1) of the shares that labellers look at."""
    n_words, chars, symbols, dup_lines, repeated, n_lines = text_counts(text)
    n, c = max(1, n_words), max(1, chars)
    lower = text.lower()
    distinct = len(set(lower.split()))
    capitals = count_capitals(text) if not lower == text else 0
    marks = sum(map(text.count, ".!?"))
    insults = ANY.findall(lower)
    kinds = len(set(insults))
    persons, contempt = (sum(w in x for w in insults) for x in LISTS[:2])
    shares = [symbols / n, repeated / n, dup_lines / max(1, n_lines), distinct / n, capitals / max(1, len(text)), (c - symbols) / c, marks / n]
    prose = n_words < 50 or marks > 0.02 * n_words
    quality = [
        vote(shares[0] > 0.1, False),
        vote(shares[1] > 0.5, prose and shares[1] < 0.05),
        vote(shares[2] > 0.3 and n_lines > 3, False),
        vote(n_words >= 50 and distinct < 4 * n_words**0.35, prose and distinct > 0.4 * n),
        vote(shares[4] > 0.3, prose and shares[4] < 0.08),
        vote(shares[5] < 0.85, prose and shares[5] > 0.985),
        vote(n_words >= 50 and marks < 0.004 * n_words, prose),
    ]
    both = persons + contempt
    toxic = [
        vote(False, persons >= 1),
        vote(False, contempt >= 1),
        vote(False, kinds >= 2),
        vote(False, both >= 3 or 100 * both > n_words),
    ]
    shares += [min(1.0, both / 4), min(1.0, 20 * both / n)]
    return quality, toxic, [min(BUCKETS - 1, int(x * (BUCKETS - 1) + 0.999)) for x in shares]


@dataclass
class Estimate:
    """Share of class 1, and for each labeller, by class, the log shares of its outcomes (abstains, 0, 1)."""

    prior: float
    rates: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, table in enumerate(self.rates):
            logit += (table[1] - table[0])[votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def accuracy(self) -> list[float]:
        """Share of right votes among those that each labeller casts."""
        shares = np.array([1 - self.prior, self.prior])
        return [float((shares * [np.exp(t[0, 1]), np.exp(t[1, 2])]).sum() / (shares[:, None] * np.exp(t[:, 1:])).sum()) for t in self.rates]


def fixed(p: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Posteriors, where a class is given 0.98 for it."""
    return np.where(given < 0, p, np.where(given == 1, 0.98, 0.02))


def expectation_maximisation(votes: np.ndarray, given: np.ndarray, counts: np.ndarray, one: float, rare: int, rounds: int = 200, tolerance: float = 1e-9) -> Estimate:
    """Prior and accuracies from the table of vectors of votes (rows of -1, 0, 1), the class given (or -1) and their counts.

    Starts from class `rare` where a labeller votes for it, else from the other class if there is a vote, else from `one`, the share of 1.
    Counts are smoothed by one text for each outcome.
    """
    start = np.where((votes == rare).any(1), rare, np.where((votes == 1 - rare).any(1), 1 - rare, one))
    p = fixed(np.clip(start, 0.05, 0.95), given)
    total = float(counts.sum())
    for _ in range(rounds):
        rates = []
        for j in range(votes.shape[1]):
            table = np.array([[((votes[:, j] == v) * counts) @ q + 1.0 for v in (-1, 0, 1)] for q in (1 - p, p)])
            rates.append(np.log(table / table.sum(1, keepdims=True)))
        found = Estimate(float((counts @ p + 1) / (total + 2)), rates)
        before, p = p, fixed(found.posterior(votes), given)
        if np.abs(p - before).max(initial=0) < tolerance:
            break
    return found


def hashed(texts: list[str], buckets: list[list[int]], features: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of each text, ascending within it, and their numbers: words, hashed, then one column for each share's bucket."""
    wide, keys = len(PREFIXES) * features, []
    for kind, prefix in enumerate(PREFIXES):
        words, sizes = word_features(texts, features, prefix)
        keys.append(np.repeat(np.arange(len(texts)), sizes) * wide + kind * features + words)
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    per = len(buckets[0]) if buckets else 0
    extra = np.array([wide + i * BUCKETS + b for row in buckets for i, b in enumerate(row)], np.int64)
    owner = np.r_[key // wide, np.repeat(np.arange(len(texts)), per)]
    column = np.r_[key % wide, extra]
    order = np.argsort(owner, kind="stable")
    return column[order], np.bincount(owner, minlength=len(texts))


@dataclass
class Scorer:
    """Weights of the words' columns, which count by the root of the number of distinct words, of the buckets, and an intercept."""

    features: int
    weights: np.ndarray

    def logits(self, column: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[column], np.cumsum(sizes) - sizes) + self.weights[-1] if len(sizes) else np.zeros(0)


def train(column: np.ndarray, sizes: np.ndarray, target: np.ndarray, use: np.ndarray, features: int, least_z: float = 5.0, least_odds: float = 6.0, epochs: int = 150, rate: float = 0.1, l2: float = 5e-4) -> Scorer:
    """Logistic regression on soft targets by full-batch Adam, over columns tied to a class; classes weigh alike, and rows by `use`."""
    n = len(PREFIXES) * features + 9 * BUCKETS + 1
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    if not len(target):
        return Scorer(features, w)
    one, zero = use * target, use * (1 - target)
    n_one, n_zero = max(1e-9, one.sum()), max(1e-9, zero.sum())
    in_one, in_zero, ends = np.zeros(n), np.zeros(n), np.r_[0, np.cumsum(sizes)]
    for i in range(0, len(sizes), 1000):  # a thousand texts at a time, to keep the driver's memory small
        j = min(i + 1000, len(sizes))
        some = column[ends[i] : ends[j]]
        in_one += np.bincount(some, np.repeat(one[i:j], sizes[i:j]), n)
        in_zero += np.bincount(some, np.repeat(zero[i:j], sizes[i:j]), n)
    share = np.clip((in_one + in_zero) / (n_one + n_zero), 1e-9, 1 - 1e-9)
    error = np.sqrt(share * (1 - share) * (1 / n_one + 1 / n_zero))
    odds = np.log((in_one + 0.5) / n_one) - np.log((in_zero + 0.5) / n_zero)
    tied = (np.abs(in_one / n_one - in_zero / n_zero) >= least_z * error) & (np.abs(odds) >= np.log(least_odds))
    kept = tied[column]
    row, column = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept], column[kept]
    weight = one / n_one + zero / n_zero
    for step in range(1, epochs + 1):
        z = np.bincount(row, w[column], len(target)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.bincount(column, g[row], n).astype(float)
        grad[-1] = g.sum()
        grad += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return Scorer(features, w.astype(np.float32))


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", features: int = 1 << 17, sample: int = 16_000) -> DataFrame:
    """Rows doc_id, quality_posterior, quality_score, toxic_posterior, toxic_score, kept, one for each row of `docs`.

    Posteriors are of the heuristics' votes on the row, scores of the scorer; all are between 0 and 1. kept: quality_score is at least 0.5
    and toxic_score below. Null texts count as empty. Null ids and repeated rows are judged like others; an empty table gives an empty one.
    Of several labels of an id the largest counts; null labels abstain. Votes are counted over all texts; `sample` bounds what the scorer
    is trained on: texts whose hash is in a range that holds about so many, each once, and of these the first 2 * `sample` in the order of
    another hash, so a run that is repeated trains on the same. The driver holds those rows' columns. Three passes over the texts; votes alone are joined to the labels.
    """
    own = columns(docs, doc_id=id_col, text=text_col)
    id_type = own.schema["doc_id"].dataType.simpleString()
    nothing = own.select("doc_id", F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("t")).limit(0)
    known = nothing if labels is None else columns(labels, doc_id=label_id_col, q=quality_col, t=toxic_col)
    known = known.groupBy("doc_id").agg(*[F.when(F.max(c).isin(0, 1), F.max(c)).otherwise(-1).cast("int").alias(c) for c in ("q", "t")])

    def with_labels(rows: DataFrame) -> DataFrame:
        votes = F.concat_ws(" ", "quality", F.coalesce("q", F.lit(-1)).cast("string"), "toxic", F.coalesce("t", F.lit(-1)).cast("string"))
        return rows.join(known, "doc_id", "left").withColumn("votes", votes).drop("q", "t", "quality", "toxic")

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            got = [measure(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([" ".join(map(str, g[i])) for g in got], pa.string()) for i in (0, 1))], ["doc_id", "quality", "toxic"])

    votes_cast = own.mapInArrow(cast, f"doc_id {id_type}, quality string, toxic string")
    patterns = with_labels(votes_cast).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    k = len(QUALITY) + 1
    votes = np.array([[int(x) for x in r["votes"].split()] for r in patterns], np.int64).reshape(len(patterns), k + len(TOXIC) + 1)
    counts = np.array([r["n"] for r in patterns], float)
    targets = (("quality", slice(0, k - 1), k - 1, 0.8, 0), ("toxic", slice(k, -1), -1, 0.05, 1))
    estimates = [expectation_maximisation(votes[:, part], votes[:, label], counts, one, rare) for _, part, label, one, rare in targets]
    bound = int(min(1.0, sample / max(1.0, counts.sum())) * (1 << 32))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            all_texts = strings(batch.column(1))
            at = [i for i, t in enumerate(all_texts) if zlib.crc32(t.encode("utf-8", "surrogatepass")) <= bound]
            texts = [all_texts[i] for i in at]
            got = [measure(t) for t in texts]
            column, sizes = hashed(texts, [b for _, _, b in got], features)
            parts = [x.astype("<i4").tobytes() for x in np.split(column, np.cumsum(sizes)[:-1])] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([" ".join(map(str, g[i])) for g in got], pa.string()) for i in (0, 1)), pa.array(parts, pa.binary())], ["doc_id", "quality", "toxic", "columns"])

    drawn = own.mapInArrow(draw, f"doc_id {id_type}, quality string, toxic string, columns binary")
    rows = with_labels(drawn).select("columns", "votes").dropDuplicates().orderBy(F.xxhash64("columns", "votes"), "columns", "votes").limit(2 * sample).collect()
    sizes = np.array([len(r["columns"]) // 4 for r in rows], np.int64)
    drawn_votes = np.array([[int(x) for x in r["votes"].split()] for r in rows], np.int64).reshape(len(rows), votes.shape[1])
    column = np.empty(int(sizes.sum()), np.int32)
    for end, size in zip(np.cumsum(sizes)[::-1], sizes[::-1], strict=True):  # from the last, so that rows can go as they are copied
        column[end - size : end] = np.frombuffer(rows.pop()["columns"], "<i4")
    scorers = []
    for estimate, (name, part, label, _, _) in zip(estimates, targets, strict=True):
        own_votes, given = drawn_votes[:, part], drawn_votes[:, label]
        use = np.where(given >= 0, 1.0, UNLABELLED[name] * (own_votes >= 0).any(1)) if (given >= 0).any() else np.ones(len(given))
        scorers.append(train(column, sizes, fixed(estimate.posterior(own_votes), given), use, features))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            texts = strings(batch.column(1))
            got = [measure(t) for t in texts]
            column, sizes = hashed(texts, [b for _, _, b in got], features)
            votes = [np.array([g[i] for g in got], np.int64).reshape(len(got), -1) for i in (0, 1)]
            posteriors = [estimate.posterior(v) if len(v) else np.zeros(0) for estimate, v in zip(estimates, votes, strict=True)]
            quality, toxic = (1 / (1 + np.exp(-np.clip(s.logits(column, sizes).astype(float), -50, 50))) for s in scorers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posteriors[0]), pa.array(quality), pa.array(posteriors[1]), pa.array(toxic), pa.array((quality >= 0.5) & (toxic < 0.5))], ["doc_id", "quality_posterior", "quality_score", "toxic_posterior", "toxic_score", "kept"])

    return own.mapInArrow(judge, f"doc_id {id_type}, quality_posterior double, quality_score double, toxic_posterior double, toxic_score double, kept boolean")


def op3_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
