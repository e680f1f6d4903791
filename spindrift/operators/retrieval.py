"""Multi-channel retrieval over many queries at once: postings, BM25, structured scores, fuzzy match, vectors, rank fusion.

Queries are rows (query_id, ...), hits are rows (query_id, doc_id, channel, score). Document statistics come from the whole index, before
any filter, as the scores need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V


def postings(docs: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Postings (field, token, doc_id, tf, len) and statistics (field, token, idf, avg_len) of array columns of `docs` (doc_id, ...).

    avg_len counts documents without words. Every aggregation is by a key that spreads: (field, token, document), then (field, token).
    """
    long = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col(column).alias("words")) for name, column in fields.items()])))
    lengths = long.groupBy("field").agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.size("words")), F.lit(1.0)).alias("avg_len"))
    tf = long.select("field", "doc_id", F.size("words").alias("len"), F.explode("words").alias("token")).groupBy("field", "token", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("field", "token").agg(F.count("*").alias("df"))
    stats = df.join(F.broadcast(lengths), "field").withColumn("idf", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return tf, stats.select("field", "token", "idf", "avg_len")


def weighted(index: tuple[DataFrame, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Rows token, doc_id, part, tf, len: what a token adds to a document's score, over all fields, its count and the fields' words. What an index keeps, sorted by token."""
    tf, stats = index
    weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("field"))
    denominator = F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / F.col("avg_len"))
    part = weight * F.col("idf") * F.col("tf") * (V.BM25_K1 + 1) / denominator * (1 + F.log(F.lit(2.0)))
    return tf.join(stats, ["field", "token"]).groupBy("token", "doc_id").agg(F.sum(part).alias("part"), F.sum("tf").alias("tf"), F.sum("len").alias("len")).sortWithinPartitions("token")


def met(terms: DataFrame, postings_: DataFrame) -> DataFrame:
    """Rows query_id, doc_id, score, got, wanted, tf, len for query terms (query_id, token) and weighted postings: the BM25 score, and how many of the query's distinct terms the document has. One join and one aggregation serve all channels that need them."""
    asked = terms.distinct()
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    found = asked.join(postings_, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("got"), F.sum("tf").alias("tf"), F.first("len").alias("len"))
    return found.join(sizes, "query_id")


def bm25(terms: DataFrame, index: tuple[DataFrame, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Rows query_id, doc_id, score for query terms (query_id, token): the fields' weighted BM25, added up. A term counts once for a query."""
    tf, stats = index
    weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("field"))
    asked = terms.distinct()
    scored = asked.join(stats, "token").join(tf, ["field", "token"])
    denominator = F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / F.col("avg_len"))
    part = weight * F.col("idf") * F.col("tf") * (V.BM25_K1 + 1) / denominator * (1 + F.log(F.lit(2.0)))
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query, with their rank; ties by document."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def all_terms_match(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows query_id, doc_id, score: documents that hold every term of a query; the score is the terms' share of the document's words."""
    asked = terms.distinct()
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    counted = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    lengths = tokens.groupBy("doc_id").agg(F.count("*").alias("len"))
    found = asked.join(counted, "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("got"), F.sum("tf").alias("tf"))
    return found.join(sizes, "query_id").where("got = wanted").join(lengths, "doc_id").select("query_id", "doc_id", F.round(F.col("tf") / F.col("len"), 6).alias("score"))


def covers(places: list[list[int]]) -> list[tuple[int, int]]:
    """The least stretches of words, from left to right, that hold a place of every term; none is part of another."""
    every = sorted((p, t) for t, own in enumerate(places) for p in own)
    seen, out = {}, []
    for p, t in every:
        seen[t] = p
        if len(seen) == len(places):
            first = min(seen.values())
            if not out or first > out[-1][0]:
                out.append((first, p))
    return out


def cover_density(terms: DataFrame, words: DataFrame, weight: float = 0.1, most_bytes: int = 1 << 25) -> DataFrame:
    """Rows query_id, doc_id, score for documents (doc_id, words) that hold every term of a query (query_id, token): the more the terms stand together, the more.

    Each least stretch that holds all terms adds `weight`, divided by one more than the words in it that are not the query's. A document meets
    the queries whose longest term it has, and is scored where it stands: no words are shuffled. Queries are broadcast, `most_bytes` of terms
    at a time; more take a further pass for each so many.
    """
    asked = terms.distinct().groupBy("query_id").agg(F.collect_list("token").alias("terms"), F.count("*").alias("wanted"), F.max(F.struct(F.length("token").alias("n"), "token"))["token"].alias("key"))
    asked = asked.where(F.size("terms") == F.col("wanted")).select("query_id", "key", "terms")  # a null term is in no document
    total = asked.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)), F.lit(0))).first()[0]
    passes = max(1, -(-total // most_bytes))

    @F.pandas_udf(DoubleType())
    def density(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for documents, queries in batches:
            out = []
            for own, wanted in zip(documents, queries, strict=True):
                places: dict[str, list[int]] = {t: [] for t in wanted}
                others = [0]  # words before each place that are not the query's
                for place, word in enumerate(own):
                    if word in places:
                        places[word].append(place)
                    others.append(others[-1] + (word not in places))
                score = 0.0
                for a, b in covers(list(places.values())):
                    score += weight / (1 + others[b + 1] - others[a])
                out.append(round(score, 6))
            yield pd.Series(out, dtype="float64")

    def met_by(some: DataFrame) -> DataFrame:
        pairs = words.select("doc_id", "words", F.explode(F.array_distinct("words")).alias("key")).join(F.broadcast(some), "key")
        whole = pairs.where(F.size(F.array_except("terms", "words")) == 0)
        return whole.select("query_id", "doc_id", density("words", "terms").alias("score"))

    parts = [met_by(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)) for i in range(passes)] if passes > 1 else [met_by(asked)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def capped(count: Column, each: float, most: float) -> Column:
    return F.least(count * F.lit(each), F.lit(most))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def structured_scores(pairs: DataFrame) -> DataFrame:
    """Exact and attribute scores of pairs: q (a query's analysis), d (a document's, of all its text), and title, attributes, description (normalized), title_terms, category_terms, attribute_terms, title_lemmas, category_lemmas.

    Adds exact_score and attribute_score, null where the channel rejects the pair, and the features of the match.
    """
    q, d = F.col("q"), F.col("d")
    has = lambda column: F.exists(q["phrases"], lambda p: F.col(column).contains(p))
    text = q["normalized"]
    phrase = F.when(text == F.col("title"), 1.55).when(F.col("title").startswith(text), 1.2).when(has("title"), 0.95).when(has("attributes"), 0.72).when(has("description"), 0.32).otherwise(0.0)
    hints_in = F.array_union(F.array_union("title_terms", "category_terms"), F.array_union("title_lemmas", "category_lemmas"))
    category = overlap(q["hints"], hints_in)
    attribute = overlap(q["attributes"], F.col("attribute_terms"))
    flagged = lambda n, base, each, most: F.when(n > 0, base + capped(n, each, most)).otherwise(0.0)
    brand, model, code, size = (overlap(q[k], d[k]) for k in ("brands", "models", "codes", "sizes"))
    amount = lambda x: F.concat_ws(" ", x["value"], x["unit"])
    matched = F.size(F.filter(q["quantities"], lambda x: F.array_contains(d["all_terms"], amount(x)) | (F.array_contains(d["tokens"], x["value"]) & F.array_contains(d["all_terms"], x["unit"]))))
    n_strict = F.size(q["strict"])
    coverage = F.when(n_strict > 0, overlap(q["strict"], d["all_terms"]) / n_strict).otherwise(0.0)
    parts = [phrase, capped(overlap(q["terms"], F.col("title_terms")), 0.16, 0.48), capped(overlap(q["lemmas"], F.col("title_lemmas")), 0.1, 0.2), capped(attribute, 0.2, 0.8), capped(category, 0.17, 0.51), flagged(brand, 0.36, 0.12, 0.24), flagged(model, 0.42, 0.12, 0.3), flagged(code, 0.35, 0.1, 0.2), flagged(size, 0.28, 0.12, 0.24), capped(matched, 0.28, 0.84), coverage * F.when(q["is_hard"], 0.8).otherwise(0.35)]
    exact = F.round(reduce(lambda a, b: a + b, parts), 6)
    allowed = (text != "") & (exact >= 0.24) & ~(q["is_hard"] & (n_strict > 0) & (coverage < 0.34))
    anywhere = F.array_union(F.array_union("attribute_terms", "title_terms"), F.col("category_terms"))
    attribute_score = F.round(capped(overlap(q["attributes"], anywhere), 0.34, 1.02) + capped(category, 0.22, 0.66) + capped(matched, 0.28, 0.84), 6)
    features = {"exact_score": F.when(allowed, exact), "attribute_score": F.when(attribute_score >= 0.2, attribute_score), "attribute_overlap": attribute, "category_match": category > 0, "brand_match": brand > 0, "numeric_match": (F.size(q["quantities"]) > 0) & (matched == F.size(q["quantities"])), "strict_coverage": F.round(coverage, 4)}
    return pairs.withColumns(features)


def gram_candidates(queries: DataFrame, docs: DataFrame, least: float, share: str = "dice") -> DataFrame:
    """Rows query_id, doc_id, similarity: Dice (or jaccard) of trigram sets (query_id or doc_id, grams) of at least `least`.

    Sets so alike share a gram among the query's rarest: with n grams, all but n * j of them, j the Jaccard similarity that `least` comes to,
    and one more. Only these are joined to the documents' grams, so the most common ones meet no one, and pairs found are compared whole.
    """
    jaccard = least if share == "jaccard" else least / (2 - least)
    grams = docs.select("doc_id", F.explode("grams").alias("gram"))
    asked = queries.select("query_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = grams.join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "gram")
    rare = asked.join(counts, "gram").withColumn("place", F.row_number().over(order))
    absent = asked.groupBy("query_id").agg(F.first("n").alias("n")).join(asked.join(counts, "gram").groupBy("query_id").agg(F.count("*").alias("there")), "query_id").select("query_id", (F.col("n") - F.col("there")).alias("missing"))
    rare = rare.join(absent, "query_id").where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * jaccard - 1e-9) + 1 - F.col("missing")).select("query_id", "gram")
    pairs = grams.join(F.broadcast(rare), "gram").select("query_id", "doc_id").distinct()
    both = pairs.join(queries.select("query_id", F.col("grams").alias("a")), "query_id").join(docs.select("doc_id", F.col("grams").alias("b")), "doc_id")
    common = F.size(F.array_intersect("a", "b"))
    total = F.size("a") + F.size("b")
    alike = common / (total - common) if share == "jaccard" else 2.0 * common / total
    return both.select("query_id", "doc_id", F.round(alike, 6).alias("similarity")).where(F.col("similarity") >= least)


def alignment_distance(a: str, b: str) -> int:
    """Edits between two strings where two neighbours may change places, each part of a string edited once at most."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + (x != y))
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(DoubleType())
def edit_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 - alignment distance / longer length; equal pairs of a worker are compared once."""
    seen: dict[tuple[str, str], float] = {}
    for left, right in batches:
        out = []
        for pair in zip(left, right, strict=True):
            if pair not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[pair] = max(0.0, 1 - alignment_distance(*pair) / max(len(pair[0]), len(pair[1]), 1))
            out.append(seen[pair])
        yield pd.Series(out, dtype="float64")


def fuzzy(queries: DataFrame, docs: DataFrame, limit: int, among: DataFrame | None = None) -> DataFrame:
    """Rows query_id, doc_id, trigram, edit, score: .58 trigram + .42 edit, over the best 6 * limit (at least 90) by trigrams, of all documents or of the pairs `among` (query_id, doc_id).

    Both have text (normalized) and variants (strings to compare by edits); documents may have whole, all their text, whose similarity counts
    where it is more than 1.18 times that of the text.
    """
    a, b = (x.withColumn("grams", T.grams(F.col("text"))) for x in (queries, docs))
    if among is None:
        found = gram_candidates(a, b, 0.13 / 1.18).withColumn("score", F.round(F.col("similarity") * 1.18, 6))
        if "whole" in docs.columns:
            by_whole = gram_candidates(a, docs.withColumn("grams", T.grams(F.col("whole"))), 0.13).withColumn("score", F.col("similarity"))
            found = found.unionByName(by_whole).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    else:
        pairs = among.select("query_id", "doc_id").distinct().join(a.select("query_id", F.col("grams").alias("a")), "query_id").join(b.withColumn("whole", T.grams(F.col("whole"))) if "whole" in docs.columns else b.withColumn("whole", F.array().cast("array<string>")), "doc_id")
        found = pairs.withColumn("score", F.round(F.greatest(1.18 * T.dice(F.col("a"), F.col("grams")), T.dice(F.col("a"), F.col("whole"))), 6))
    short = top(found.where("score >= 0.13").select("query_id", "doc_id", "score"), max(6 * limit, 90)).withColumnRenamed("score", "trigram").drop("rank")
    pairs = short.join(queries.select("query_id", F.explode("variants").alias("asked")), "query_id").join(docs.select("doc_id", F.explode("variants").alias("there")), "doc_id")
    edits = pairs.withColumn("edit", edit_similarity("asked", "there")).groupBy("query_id", "doc_id", "trigram").agg(F.max("edit").alias("edit"))
    score = F.round(0.58 * F.col("trigram") + 0.42 * F.col("edit"), 6)
    return edits.withColumn("score", score).where("edit >= 0.52 OR score >= 0.24")


def reasons(channel_scores: Column) -> Column:
    """Reasons of a result by the channels that found it, and retrieval_rrf for several."""
    named = F.transform(F.map_keys(channel_scores), lambda c: T.mapped(c, V.CHANNEL_REASONS))
    several = F.when(F.size(named) >= 2, F.array(F.lit("retrieval_rrf"))).otherwise(F.array().cast("array<string>"))
    return F.concat(named, several)


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked hits (query_id, doc_id, channel, score, rank): fused score, channels, best channel score, scores by channel."""
    weights = weights or V.CHANNEL_WEIGHTS
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("channel")), F.lit(1.0))
    most = sum(V.CHANNEL_WEIGHTS.values()) / (k + 1)
    fused = F.least(F.sum(weight / (k + F.col("rank"))) / most, F.lit(1.0))
    channels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", F.round("score", 4)))))
    return hits.groupBy("query_id", "doc_id").agg(F.round(fused, 4).alias("score"), F.count("*").alias("n_channels"), F.max("score").alias("best"), channels.alias("channel_scores"))


def best_first_order() -> list[Column]:
    """The order of fused results where a channel's best score counts before their number, and newer documents (larger ids) come first."""
    return [F.desc("score"), F.desc("best"), F.desc("doc_id")]


def fused_order() -> list[Column]:
    """The order of fused results where the number of channels counts before the best score."""
    return [F.desc("score"), F.desc("n_channels"), F.desc("best"), F.col("doc_id")]


def short_of_hits(hits: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Queries (query_id) with fewer distinct documents than a fallback channel needs to be asked for: max(min(limit, 20), 8)."""
    found = hits.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
    return queries.join(found, "query_id", "left").where(F.coalesce("n", F.lit(0)) < max(min(limit, 20), 8)).select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float, block: int = 2048) -> DataFrame:
    """The k vectors (vec_id, embedding) most alike each query (query_id, vector) by cosine, rounded to six places, at least `least`, other than itself; ties by id.

    A stated query set against all rows: queries go to the tasks `block` at a time, each block with a pass over the vectors, in which a
    task multiplies matrices and keeps each query's k best (with what equals the last), so what it sends doesn't grow with its rows.
    Vectors without a length, and null ones, are like nothing.
    """
    out, rows = None, []

    def search(rows: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in rows], np.int64)
        asked = unit(np.array([r["vector"] for r in rows], np.float64)) if rows else np.zeros((0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
            for batch in batches:
                some = batch.filter(pc.is_valid(batch.column(1)))
                if not some.num_rows or not len(ids):
                    continue
                own = some.column(0).to_numpy()
                likeness = np.round(asked @ unit(some.column(1).flatten().to_numpy().reshape(len(own), -1).astype(np.float64)).T, 6)
                for i, row in enumerate(likeness):
                    at = np.flatnonzero((row >= least) & (own != ids[i]))
                    if len(at):
                        scores, found = np.r_[best[i][0], row[at]], np.r_[best[i][1], own[at]]
                        if len(scores) > k:
                            keep = scores >= np.partition(scores, -k)[-k]
                            scores, found = scores[keep], found[keep]
                        best[i] = scores, found
            sizes = [len(s) for s, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([f for _, f in best]) if best else ids), pa.array(np.concatenate([s for s, _ in best]) if best else np.zeros(0))], ["query_id", "doc_id", "score"])

        return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, doc_id long, score double")

    for row in queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector").toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            out, rows = search(rows) if out is None else out.unionByName(search(rows)), []
    if rows or out is None:
        out = search(rows) if out is None else out.unionByName(search(rows))
    return top(out, k)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return rows / np.maximum(np.sqrt((rows * rows).sum(1)), 1e-300)[:, None]
