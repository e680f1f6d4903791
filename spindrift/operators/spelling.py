"""Spelling correction: blocked candidates, their order, and the confidence of the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.session import ship


#: Pairs whose letters are compared at a time, and pairs whose edits are counted at a time.
LETTER_PAIRS, EDIT_PAIRS = 1 << 20, 1 << 16


def letters(words: np.ndarray) -> np.ndarray:
    """For words as rows of code points: a bit for each of 32 classes of letters that a word has, and one for each that it has twice. An edit changes two bits at most, one if it changes the length."""
    once, twice = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for c in words.T:
        bit = np.where(c > 0, np.uint64(1) << (c.astype(np.uint64) & np.uint64(31)), np.uint64(0))
        twice |= once & bit
        once |= bit
    return once | twice << np.uint64(32)


def edits(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of pairs, `most` + 1 if there are more: a column of `a` (letters of one length) and one of `b` (padded to the longest; `sizes` letters, `most` more or fewer at most). A band of the table, for all pairs at once."""
    far, n = np.uint8(most + 1), a.shape[1]
    last = [np.full(n, d if d >= 0 else far, np.uint8) for d in range(-most, most + 1)]
    for i in range(1, len(a) + 1):
        row = []
        for t in range(len(last)):
            j = i + t - most
            if j <= 0 or j > len(b):
                cell = np.full(n, min(i, far) if j == 0 else far, np.uint8)
            else:
                cell = last[t] + (a[i - 1] != b[j - 1])
                if t + 1 < len(last):
                    np.minimum(cell, last[t + 1] + np.uint8(1), out=cell)
                if t:
                    np.minimum(cell, row[-1] + np.uint8(1), out=cell)
                np.minimum(cell, far, out=cell)
            row.append(cell)
        last = row
    return np.stack(last)[sizes - len(a) + most, np.arange(n)]


def near_pairs(left: list[str], right: list[str], prefix: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of `left` (of one length) and `right` that are `most` edits apart at most, and their distances. All begin with the same `prefix` letters.

    Pairs whose letters differ too much are left out before their edits are counted; that loses none.
    """
    width = max(1, *map(len, left), *map(len, right))
    points = np.array([*left, *right], f"U{width}").view(np.uint32).reshape(-1, width)
    masks, sizes = letters(points), np.array([len(x) for x in right])
    codes, back = np.unique(points, return_inverse=True)
    back = back.reshape(points.shape).astype(np.uint8 if len(codes) <= 256 else np.uint32)
    a, b = back[: len(left), prefix : len(left[0])], back[len(left) :, prefix:]
    apart = np.abs(sizes - len(left[0]))
    allowed = np.where(apart <= most, 2 * most - apart, -1).astype(np.int8)
    step, found = max(1, LETTER_PAIRS // max(1, len(right))), []
    for i in range(0, len(left), step):
        x, y = np.nonzero(np.bitwise_count(masks[i : min(i + step, len(left)), None] ^ masks[None, len(left) :]).astype(np.int8) <= allowed)
        for at in range(0, len(x), EDIT_PAIRS):
            own, other = x[at : at + EDIT_PAIRS] + i, y[at : at + EDIT_PAIRS]
            distance = edits(np.ascontiguousarray(a[own].T), np.ascontiguousarray(b[other].T), sizes[other] - prefix, most)
            ok = distance <= most
            found.append((own[ok], other[ok], distance[ok].astype(np.int32)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    own, other, distance = (np.concatenate(c) for c in zip(*found, strict=True))
    return own, other, distance


def nearest(own: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Which pairs are among the `n` nearest of `own`; ties all stay."""
    order = np.lexsort((distance, own))
    first = np.searchsorted(own[order], own[order])
    nth = np.minimum(first + n, np.searchsorted(own[order], own[order], "right")) - 1
    out = np.zeros(len(own), bool)
    out[order] = distance[order] <= distance[order][nth]
    return out


def blocked_candidates(tokens: DataFrame, vocabulary: DataFrame, prefix: int, least: int | None = None) -> DataFrame:
    """Pairs of token and candidate (candidate, freq) whose signatures begin alike, whose lengths and edits differ little enough; with `least`, only those among the so many nearest of a token, and ties.

    Tokens meet candidates by their prefix and length. Signatures replace letter by letter, so they are never farther apart than the words.
    """
    a = tokens.withColumn("sig", T.signature(F.col("token"))).withColumn("most", T.most_edits(F.col("sig")))
    b = vocabulary.withColumn("other", T.signature(F.col("candidate"))).where(F.length("other") >= 3)
    keyed = lambda df, c, size: df.withColumn("block", F.substring(c, 1, prefix)).withColumn("size", size)
    left = keyed(a.where("sig IS NOT NULL"), "sig", F.length("sig"))
    right = keyed(b, "other", F.explode(F.sequence(F.greatest(F.length("other") - 3, F.lit(1)), F.length("other") + 3)))
    schema = StructType([*a.schema.fields, *b.schema.fields, StructField("distance", IntegerType())])

    def pairs(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.select(a_names), y.select(b_names)
        own, other, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        if len(x) and len(y):
            own, other, distance = near_pairs(x["sig"].to_pylist(), y["other"].to_pylist(), prefix, x["most"][0].as_py())
            different = pc.not_equal(x["token"].take(pa.array(own)), y["candidate"].take(pa.array(other))).to_numpy().astype(bool)
            own, other, distance = own[different], other[different], distance[different]
            if least:
                some = nearest(own, distance, least)
                own, other, distance = own[some], other[some], distance[some]
        out = [*(t[c].take(pa.array(at)) for t, names, at in ((x, a_names, own), (y, b_names, other)) for c in names), pa.array(distance, pa.int32())]
        return pa.table(out, names=[*a_names, *b_names, "distance"])

    a_names, b_names = a.columns, b.columns
    ship(tokens.sparkSession)
    found = left.groupBy("block", "size").cogroup(right.groupBy("block", "size")).applyInArrow(pairs, schema)
    return found.withColumn("shared", T.shared_prefix(F.col("sig"), F.col("other"))).where("shared > 0 OR distance <= 1")


def vocabulary_of(documents: DataFrame, pairs: list[DataFrame], least: int) -> DataFrame:
    """Rows token, freq: the words of known pairs (two text columns each), and those that at least `least` documents (words) have."""
    counted = documents.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    out = counted
    for df in pairs:
        for c in df.columns:
            out = out.unionByName(df.select(F.explode(T.spelling_tokens(F.col(c))).alias("token"), F.lit(0).cast("long").alias("freq")))
    return out.groupBy("token").agg(F.max("freq").alias("freq"))


def is_skipped(token: Column, known: Column, protected: Column) -> Column:
    """Whether a token isn't corrected: a stop word, a known or protected one, a number, shorter than four, with a digit, or Latin."""
    return token.isin(V.STOP_WORDS) | known | protected | (F.length(token) < 4) | token.rlike("[0-9]") | token.rlike("^[a-z]+$")


def near_variants(ranked: DataFrame, limit: int) -> DataFrame:
    """Of ranked candidates (token, candidate, distance, shared, delta, freq) of each token the first `limit` that are at most one edit farther than the best and share a beginning, or are one edit away."""
    by = Window.partitionBy("token")
    near = ranked.withColumn("best", F.min("distance").over(by)).where("distance - best <= 1 AND (shared > 0 OR distance <= 1)")
    order = by.orderBy("distance", F.desc("shared"), "delta", F.desc("freq"), "candidate")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("best")


def confidence(distance: Column, shared: Column, freq: Column, next_distance: Column, next_freq: Column) -> Column:
    """From 0 to 0.99; the runner-up's columns are null without one."""
    alone = next_distance.isNull()
    margin = F.when(alone, 2).otherwise(next_distance - distance)
    score = F.lit(0.32) + F.when(distance <= 1, 0.3).when(distance == 2, 0.18).otherwise(0.08)
    score = score + F.when(shared >= 3, 0.2).when(shared >= 2, 0.15).when(shared >= 1, 0.08).otherwise(0.0)
    score = score + F.when(margin >= 2, 0.2).when(margin >= 1, 0.12).when(~alone, -0.08).otherwise(0.0)
    score = score + F.when(freq >= 5, 0.04).otherwise(0.0) + F.when(~alone & (freq >= 2 * F.greatest(next_freq, F.lit(1))), 0.04).otherwise(0.0) + F.when(alone, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(0.99))), 4)


def label(score: Column) -> Column:
    return F.when(score >= 0.82, "high").when(score >= 0.64, "medium").otherwise("low")


def ranked_candidates(tokens: DataFrame, vocabulary: DataFrame, least: int | None = None) -> DataFrame:
    """Candidates of each token: those that share two leading letters, or one for tokens for which the vocabulary has none that fits in length; delta is the difference of lengths. With `least`, only those among the so many nearest, and ties."""
    two = blocked_candidates(tokens, vocabulary, 2, least)
    sized = tokens.withColumn("sig", T.signature(F.col("token"))).withColumn("most", T.most_edits(F.col("sig"))).withColumn("block", F.substring("sig", 1, 2))
    pool = vocabulary.select(F.substring(T.signature(F.col("candidate")), 1, 2).alias("block"), F.length(T.signature(F.col("candidate"))).alias("len")).distinct()
    has_two = sized.join(pool, "block").where(F.col("len").between(F.greatest(F.lit(3), F.length("sig") - F.col("most")), F.length("sig") + F.col("most"))).select("token").distinct()
    one = blocked_candidates(tokens.join(has_two, "token", "left_anti"), vocabulary, 1, least)
    return two.unionByName(one).withColumn("delta", F.abs(F.length("candidate") - F.length("token")))


def corrections(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows token, corrected, score, confidence: the best candidate, unless another is as good and the best isn't far more frequent."""
    order = Window.partitionBy("token").orderBy("distance", F.desc("shared"), "delta", F.desc("freq"), "candidate")
    ranked = ranked_candidates(tokens, vocabulary, 2).withColumn("place", F.row_number().over(order)).where("place <= 2")
    for c in ("distance", "shared", "delta", "freq"):
        ranked = ranked.withColumn(f"next_{c}", F.lead(c).over(order))
    best = ranked.where("place = 1")
    tie = (F.col("distance") == F.col("next_distance")) & (F.col("shared") == F.col("next_shared")) & (F.col("delta") == F.col("next_delta"))
    rare = ~((F.col("freq") >= 5) & (F.col("freq") >= 4 * F.greatest("next_freq", F.lit(1))))
    at_most = (F.col("distance") == F.col("most")) & (F.col("next_distance") <= F.col("distance"))
    kept = best.where(~F.coalesce(tie & rare, F.lit(False)) & ~F.coalesce(at_most, F.lit(False)))
    score = confidence(F.col("distance"), F.col("shared"), F.col("freq"), F.col("next_distance"), F.col("next_freq"))
    return kept.select("token", F.col("candidate").alias("corrected"), score.alias("score")).withColumn("confidence", label(F.col("score")))


def dictionary(text: Column, corrections_: dict[str, str]) -> Column:
    """The text with wrong words replaced, longest first; null if nothing changes."""
    fixed = text
    for wrong, right in sorted(corrections_.items(), key=lambda x: (-len(x[0]), x[0])):
        pattern = "".join("\\" + c if not c.isalnum() and c != " " else c for c in wrong)
        fixed = F.regexp_replace(fixed, rf"(?U)(?<!\w){pattern}(?!\w)", right.replace("\\", "\\\\").replace("$", "\\$"))
    fixed = T.normalize(fixed)
    return F.when(fixed != text, fixed)
