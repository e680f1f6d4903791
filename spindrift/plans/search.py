"""Queries of text processing and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.operators import retrieval as R
from spindrift.operators import spelling as S
from spindrift.operators.behaviour import best_of_variants
from spindrift.plans import bindings as B
from spindrift.plans.registry import query
from spindrift.session import settled, table
from spindrift.sources.portal import indexed

W = B.with_sql


def norm_sql(x: str) -> str:
    """The normalization of text without Cyrillic, for an engine without look-around: pairs of neighbours are replaced twice."""
    x = f"lower(coalesce({x}, ''))"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])\\s*x\\s*([0-9])', '\\1х\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([a-zа-яё])[-/]([a-zа-яё])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^0-9a-zа-яё./\\s-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def terms_sql(x: str) -> str:
    return f"list_filter({words_sql(x)}, lambda t: regexp_matches(t, '^[0-9]+$') OR length(t) BETWEEN 2 AND {V.LONGEST_TOKEN})"


#: Text queries over the parts: a fixed set.
ASKED = [(1, "red bolt"), (2, "blue gear"), (3, "steel"), (4, "brand 17 large"), (5, "small bolt green"), (6, "gear"), (7, "gizmoo bollt")]
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") t(query_id, q))"


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, q string")


def part_docs(spark, sf):
    """Parts as documents: normalized fields, and their terms."""
    items = B.items(spark, sf)
    fields = {"title": F.col("title"), "attributes": F.concat_ws(" ", "brand", F.col("size").cast("string")), "category": F.col("category"), "description": F.col("description"), "supplier": F.coalesce("supplier", F.lit(""))}
    normalized = items.select(F.col("item_id").alias("doc_id"), *[T.normalize(c).alias(n) for n, c in fields.items()])
    return normalized.withColumns({f"{n}_terms": T.terms(F.col(n), distinct=False) for n in fields})


def bm25_sql(index: str, weights: dict[str, float], terms: str) -> str:
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in weights.items()) + " END"
    return f"""{index},
lengths AS (SELECT field, count(*) AS n_docs, greatest(avg(len(w)), 1.0::DOUBLE) AS avg_len FROM fields GROUP BY 1),
tf AS (SELECT field, token, doc_id, count(*) AS tf, any_value(l) AS l FROM (SELECT field, doc_id, len(w) AS l, unnest(w) AS token FROM fields) GROUP BY 1, 2, 3),
idf AS (SELECT field, token, ln(1 + (any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, any_value(avg_len) AS avg_len FROM tf JOIN lengths USING (field) GROUP BY 1, 2),
terms AS (SELECT DISTINCT query_id, token FROM ({terms})),
scored AS (SELECT query_id, doc_id, round(sum({weight} * idf * tf * {V.BM25_K1 + 1}::DOUBLE / (tf + {V.BM25_K1}::DOUBLE * (1 - {V.BM25_B}::DOUBLE + {V.BM25_B}::DOUBLE * l / avg_len)) * (1 + ln(2.0::DOUBLE))), 6) AS score
  FROM terms JOIN idf USING (token) JOIN tf USING (field, token) GROUP BY 1, 2)"""


FIELDS = {"title": "title", "attributes": "brand || ' ' || size", "category": "category", "description": "description", "supplier": "coalesce(supplier, '')"}
PART_INDEX = B.ITEMS + ",\nfields AS (" + " UNION ALL ".join(f"SELECT item_id AS doc_id, '{n}' AS field, {terms_sql(norm_sql(c))} AS w FROM items" for n, c in FIELDS.items()) + ")"
ASKED_TERMS = f"SELECT query_id, unnest({terms_sql(norm_sql('q'))}) AS token FROM asked"


def part_bm25(spark, sf):
    index = R.postings(part_docs(spark, sf), {f: f"{f}_terms" for f in FIELDS})
    wanted = asked(spark).select("query_id", F.explode(T.terms(T.normalize(F.col("q")))).alias("token"))
    return R.bm25(F.broadcast(wanted), index, V.FIELD_WEIGHTS)


@query(W(ASKED_SQL, bm25_sql(PART_INDEX, V.FIELD_WEIGHTS, ASKED_TERMS)) + "SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored QUALIFY rank <= 10")
def bm25_parts(spark, sf):
    return R.top(part_bm25(spark, sf), 10)


DOC_WORDS = f"words AS (SELECT doc_id, unnest({terms_sql(norm_sql('text'))}) AS token FROM documents)"
PASSAGES = f"asked AS (SELECT item_id AS query_id, list_distinct({terms_sql(norm_sql('text'))}) AS w FROM benchmark)"


def doc_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.terms(T.normalize(F.col("text")), distinct=False)).alias("token"))


def passages(spark, sf):
    """Queries: all terms of each benchmark text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.terms(T.normalize(F.col("text")))).alias("token"))


def doc_postings(spark, sf):
    """The weighted postings of the documents, built once for each state of their files."""

    def build():
        docs = table(spark, sf, "documents").select("doc_id", T.terms(T.normalize(F.col("text")), distinct=False).alias("words"))
        return R.weighted(R.postings(docs, {"description": "words"}), V.FIELD_WEIGHTS)

    return indexed(spark, f"{sf}/documents.parquet", "postings", build)


DOC_INDEX = f"fields AS (SELECT doc_id, 'description' AS field, {terms_sql(norm_sql('text'))} AS w FROM documents)"


@query(W(PASSAGES, bm25_sql(DOC_INDEX, {"description": 0.7}, "SELECT query_id, unnest(w) AS token FROM asked")) + "SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored QUALIFY rank <= 10")
def bm25_documents(spark, sf):
    return R.top(R.met(passages(spark, sf), doc_postings(spark, sf)).select("query_id", "doc_id", "score"), 10)


@query(W(DOC_WORDS, PASSAGES) + """, terms AS (SELECT query_id, unnest(w) AS token FROM asked), c AS (SELECT doc_id, token, count(*) AS tf FROM words GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
f AS (SELECT query_id, doc_id, count(*) AS got, sum(tf) AS tf FROM terms JOIN c USING (token) GROUP BY 1, 2), s AS (SELECT query_id, count(*) AS wanted FROM terms GROUP BY 1)
SELECT query_id, doc_id, round(tf / n, 6) AS score FROM f JOIN s USING (query_id) JOIN l USING (doc_id) WHERE got = wanted""")
def phrase_and_match(spark, sf):
    found = R.met(passages(spark, sf), doc_postings(spark, sf)).where("got = wanted")
    return found.select("query_id", "doc_id", F.round(F.col("tf") / F.col("len"), 6).alias("score"))


@query(f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def normalize_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(W(DOC_WORDS) + "SELECT token, count(DISTINCT doc_id) AS df, count(*) AS n FROM words GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def tokens_df(spark, sf):
    return doc_postings(spark, sf).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).where("df >= 2")


TOKENS = f"tokens AS (SELECT DISTINCT unnest({words_sql(norm_sql('text'))}) AS token FROM documents)"


def doc_tokens(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.split_words(T.normalize(F.col("text")))).alias("token")).distinct()


@query(W(TOKENS) + "SELECT token, translate(token, 'ёэйъщф', 'ееиьшв') AS signature, (CASE WHEN length(token) <= 4 THEN 1 WHEN length(token) <= 8 THEN 2 ELSE 3 END)::INTEGER AS most_edits FROM tokens")
def spell_signature(spark, sf):
    return doc_tokens(spark, sf).select("token", T.signature(F.col("token")).alias("signature"), T.most_edits(T.signature(F.col("token"))).alias("most_edits"))


@query(W(TOKENS) + f"SELECT token, translate(token, '{V.LATIN_KEYS.replace(chr(39), chr(39) * 2)}', '{V.CYRILLIC_KEYS}') AS retyped FROM tokens WHERE regexp_matches(token, '^[a-z]{{4,}}$') AND token NOT IN ({', '.join(repr(x) for x in V.LATIN_KEPT)}) AND (length(regexp_replace(token, '[^aeiouy]', '', 'g')) / length(token) < 0.25 OR regexp_matches(token, '[^aeiouy]{{4}}'))")
def layout_fix(spark, sf):
    return doc_tokens(spark, sf).where(T.is_layout_mistake(F.col("token"))).select("token", F.translate("token", V.LATIN_KEYS, V.CYRILLIC_KEYS).alias("retyped"))


STRUCTURED = f"t AS (SELECT p_partkey AS item_id, {words_sql(norm_sql(chr(39) + chr(39) + ' || p_name || ' + chr(39) + ' ' + chr(39) + ' || p_brand || ' + chr(39) + ' ' + chr(39) + ' || p_size || ' + chr(39) + 'x' + chr(39) + ' || p_partkey % 50 || ' + chr(39) + ' a' + chr(39) + ' || p_size % 9'))} AS w FROM part)"


@query(W(STRUCTURED) + f"""SELECT item_id,
array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '{V.BRAND_PATTERN}') AND NOT list_contains({V.GENERIC_LATIN + V.SIZES}, x)))), ',') AS brands,
array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[a-zа-я0-9-]+$') AND regexp_matches(x, '[a-zа-я]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '{V.PAPER_PATTERN}')))), ',') AS models,
array_to_string(list_sort(list_distinct(list_filter(w, lambda x: list_contains({V.SIZES}, x) OR regexp_matches(x, '{V.PAPER_PATTERN}') OR regexp_matches(x, '{V.DIMENSION_PATTERN}')))), ',') AS sizes,
array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')))), ',') AS numbers FROM t""")
def structured_terms(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size"), F.lit("x"), F.col("p_partkey") % 50), F.concat(F.lit("a"), F.col("p_size") % 9))
    token = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), T.tokens(T.normalize(text)).alias("t"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return token.select("item_id", joined(T.brands(F.col("t"))).alias("brands"), joined(T.models(F.col("t"))).alias("models"), joined(T.sizes(F.col("t"))).alias("sizes"), joined(T.numbers(F.col("t"))).alias("numbers"))


NAMES = f"names AS (SELECT DISTINCT {norm_sql('p_name')} AS title FROM part), g AS (SELECT title, list_distinct([substring('  ' || title || ' ', i, 3) for i in range(1, length(title) + 2)]) AS grams FROM names)"


@query(W(ASKED_SQL, NAMES) + f", a AS (SELECT query_id, list_distinct([substring('  ' || n || ' ', i, 3) for i in range(1, length(n) + 2)]) AS grams FROM (SELECT query_id, {norm_sql('q')} AS n FROM asked)), s AS (SELECT query_id, title, round(2.0::DOUBLE * len(list_intersect(a.grams, g.grams)) / (len(a.grams) + len(g.grams)), 6) AS similarity FROM a, g) SELECT * FROM s WHERE similarity >= 0.3")
def trigram_similarity(spark, sf):
    names = table(spark, sf, "part").select(T.normalize(F.col("p_name")).alias("doc_id")).distinct().withColumn("grams", T.grams(F.col("doc_id")))
    wanted = asked(spark).select("query_id", T.grams(T.normalize(F.col("q"))).alias("grams"))
    return R.gram_candidates(wanted, names, 0.3).withColumnRenamed("doc_id", "title")


def sig_sql(x: str) -> str:
    return f"translate({x}, '{V.SIGNATURE_FROM}', '{V.SIGNATURE_TO}')"


def edits_sql(a: str, b: str) -> str:
    """The edit distance of words; the engine's counts bytes, so Cyrillic letters become single ones that words don't have."""
    cyrillic = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    single = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&("
    return f"levenshtein(translate({a}, '{cyrillic}', '{single}'), translate({b}, '{cyrillic}', '{single}'))"


def pairs_sql(wrong: str, good: str, both: bool) -> str:
    """Words to correct (token) and words to correct to (token, freq), with their signatures, and near pairs that begin with the same two letters, or with `both` one letter where there are no others."""
    edits = "CASE WHEN length(sig) <= 4 THEN 1 WHEN length(sig) <= 8 THEN 2 ELSE 3 END"
    pair = lambda n, of: f"SELECT w.token, g.token AS candidate, g.freq, w.sig, g.sig AS other, most FROM {of} w JOIN good g ON w.sig[:{n}] = g.sig[:{n}] AND abs(length(w.token) - length(g.token)) <= most AND length(g.sig) >= 3 AND w.token <> g.token"
    return f"""wrong AS (SELECT *, {edits} AS most FROM (SELECT token, {sig_sql("token")} AS sig FROM ({wrong}))), good AS (SELECT *, {sig_sql("token")} AS sig FROM ({good})),
sized AS (SELECT DISTINCT w.token FROM wrong w JOIN (SELECT DISTINCT sig[:2] AS block, length(sig) AS n FROM good) g ON w.sig[:2] = block AND n BETWEEN greatest(3, length(w.sig) - most) AND length(w.sig) + most),
rest AS (SELECT * FROM wrong WHERE token NOT IN (SELECT token FROM sized)),
two AS ({pair(2, "wrong")}), one AS ({pair(1, "rest")}),
measured AS (SELECT *, least({edits_sql("sig", "other")}, {edits_sql("token", "candidate")})::INTEGER AS distance FROM {"(SELECT * FROM two UNION ALL SELECT * FROM one)" if both else "two"}),
near AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(sig), length(other)) + 1), lambda i: sig[:i] = other[:i])), 0) AS shared FROM measured WHERE distance <= most)"""


RARE = DOC_WORDS + ", vocab AS (SELECT token, count(DISTINCT doc_id) AS freq FROM words WHERE regexp_matches(token, '^[a-zа-я]+$') GROUP BY 1)"
RARE_PAIRS = ("SELECT token FROM vocab WHERE freq = 1 AND length(token) >= 4", "SELECT token, freq FROM vocab WHERE freq >= 5 AND length(token) >= 3")


def rare_words(spark, sf):
    """The documents' words of letters and the documents that have them, counted once for all steps."""
    return settled(doc_words(spark, sf).where("token RLIKE '^[a-zа-я]+$'").groupBy("token").agg(F.count_distinct("doc_id").alias("freq")))


@query(W(RARE, pairs_sql(*RARE_PAIRS, both=False)) + "SELECT token, candidate, distance, freq FROM near WHERE shared > 0 OR distance <= 1")
def spell_candidates(spark, sf):
    vocab = rare_words(spark, sf)
    return S.blocked_candidates(vocab.where("freq = 1 AND length(token) >= 4").select("token"), vocab.where("freq >= 5 AND length(token) >= 3").select(F.col("token").alias("candidate"), "freq"), prefix=2).select("token", "candidate", "distance", "freq")


CORRECTED = """o AS (SELECT *, abs(length(candidate) - length(token)) AS delta FROM near WHERE shared > 0 OR distance <= 1),
r AS (SELECT *, row_number() OVER w AS place, lead(distance) OVER w AS d2, lead(shared) OVER w AS s2, lead(delta) OVER w AS l2, lead(freq) OVER w AS f2 FROM o WINDOW w AS (PARTITION BY token ORDER BY distance, shared DESC, delta, freq DESC, candidate)),
best AS (SELECT *, CASE WHEN d2 IS NULL THEN 2 ELSE d2 - distance END AS margin FROM r WHERE place = 1
  AND NOT coalesce(distance = d2 AND shared = s2 AND delta = l2 AND NOT (freq >= 5 AND freq >= 4 * greatest(f2, 1)), false) AND NOT coalesce(distance = most AND d2 <= distance, false)),
sc AS (SELECT token, candidate AS corrected, round(greatest(0::DOUBLE, least(0.99::DOUBLE, 0.32::DOUBLE + CASE WHEN distance <= 1 THEN 0.3::DOUBLE WHEN distance = 2 THEN 0.18::DOUBLE ELSE 0.08::DOUBLE END
  + CASE WHEN shared >= 3 THEN 0.2::DOUBLE WHEN shared >= 2 THEN 0.15::DOUBLE WHEN shared >= 1 THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN margin >= 2 THEN 0.2::DOUBLE WHEN margin >= 1 THEN 0.12::DOUBLE WHEN d2 IS NOT NULL THEN -0.08::DOUBLE ELSE 0 END
  + CASE WHEN freq >= 5 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN d2 IS NOT NULL AND freq >= 2 * greatest(f2, 1) THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN d2 IS NULL THEN 0.05::DOUBLE ELSE 0 END)), 4) AS score FROM best)"""


@query(W(RARE, pairs_sql(*RARE_PAIRS, both=True), CORRECTED) + "SELECT token, corrected, score, CASE WHEN score >= 0.82 THEN 'high' WHEN score >= 0.64 THEN 'medium' ELSE 'low' END AS confidence FROM sc")
def spell_corrections(spark, sf):
    vocab = rare_words(spark, sf)
    return S.corrections(vocab.where("freq = 1 AND length(token) >= 4").select("token"), vocab.where("freq >= 5 AND length(token) >= 3").select(F.col("token").alias("candidate"), "freq"))


def word_grams_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[0-9a-zа-яё]+'), lambda w: [substring('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)])))"


@query(W(ASKED_SQL, f"n AS (SELECT p_partkey AS doc_id, p_name AS title, {word_grams_sql('p_name')} AS b FROM part), a AS (SELECT query_id, {word_grams_sql('q')} AS a FROM asked WHERE length(q) >= 3)") + f"""
, s AS (SELECT query_id, doc_id, title, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM a, n),
t AS (SELECT query_id, doc_id, round(round(similarity, 6) * {V.TRIGRAM_WEIGHT}::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(round(similarity, 6) * {V.TRIGRAM_WEIGHT}::DOUBLE, 6) DESC, doc_id) AS rank FROM s WHERE round(similarity, 6) >= {V.TRIGRAM_MATCH}::DOUBLE QUALIFY rank <= {V.expanded_limit(20)})
SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM t WHERE score >= {V.TRIGRAM_LEAST}::DOUBLE""")
def trigram_match(spark, sf):
    """Titles like a query by trigrams of words; what is too little like it goes after the limit."""
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.word_grams(F.col("p_name")).alias("grams"))
    wanted = asked(spark).where("length(q) >= 3").select("query_id", T.word_grams(F.col("q")).alias("grams"))
    found = R.gram_candidates(wanted, names, V.TRIGRAM_MATCH, share="jaccard").select("query_id", "doc_id", F.round(F.col("similarity") * V.TRIGRAM_WEIGHT, 6).alias("score"))
    return R.top(found, V.expanded_limit(20)).where(F.col("score") >= V.TRIGRAM_LEAST)


def structured_pairs(spark, sf, k=300):
    """Pairs of the asked queries and their k best parts by BM25, with both analyses and bm25, the score."""
    docs = part_docs(spark, sf).withColumns({"title_lemmas": T.lemmas(F.col("title_terms")), "category_lemmas": T.lemmas(F.col("category_terms"))}).withColumnRenamed("attributes_terms", "attribute_terms")
    docs = T.with_analysis(docs, F.concat_ws(" ", "title", "attributes", "category", "description"), "d")
    short = R.top(part_bm25(spark, sf), k).select("query_id", "doc_id", F.col("score").alias("bm25"))
    wanted = T.with_analysis(asked(spark), F.col("q"), "q")
    return R.structured_scores(short.join(F.broadcast(wanted), "query_id").join(docs, "doc_id"))


@query()
def structured_scores(spark, sf):
    return structured_pairs(spark, sf).select("query_id", "doc_id", "exact_score", "attribute_score", "attribute_overlap", "category_match", "brand_match", "numeric_match", "strict_coverage")


@query()
def fuzzy_parts(spark, sf):
    docs = part_docs(spark, sf).select("doc_id", F.col("title").alias("text"), F.array_distinct(F.concat(F.array("title"), "title_terms")).alias("variants"))
    wanted = asked(spark).select("query_id", T.normalize(F.col("q")).alias("text")).withColumn("variants", F.array("text"))
    return R.top(R.fuzzy(wanted, docs, 20), 20)


FUSION = f"""{PASSAGES}, {bm25_sql(DOC_INDEX, {"description": 0.7}, "SELECT query_id, unnest(w) AS token FROM asked")},
long AS (SELECT query_id, doc_id, round(len(list_intersect(asked.w, list_distinct(f.w)))::DOUBLE / len(asked.w), 6) AS score FROM asked, fields f WHERE len(list_intersect(asked.w, list_distinct(f.w))) > 0),
ranked AS (SELECT *, 'bm25' AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 60 UNION ALL SELECT *, 'exact_structured', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM long QUALIFY rank <= 60),
fused AS (SELECT query_id, doc_id, round(least(sum(CASE channel WHEN 'bm25' THEN 1.2::DOUBLE ELSE 1.45::DOUBLE END / (60 + rank)) / (7.35::DOUBLE / 61), 1.0::DOUBLE), 4) AS score, count(*) AS n_channels, max(score) AS best FROM ranked GROUP BY 1, 2)"""


def _channels(spark, sf):
    found = R.met(passages(spark, sf), doc_postings(spark, sf))
    lexical = R.top(found.select("query_id", "doc_id", "score"), 60).withColumn("channel", F.lit("bm25"))
    coverage = R.top(found.select("query_id", "doc_id", F.round(F.col("got") / F.col("wanted"), 6).alias("score")), 60).withColumn("channel", F.lit("exact_structured"))
    return lexical.unionByName(coverage)


@query(W(FUSION) + "SELECT query_id, doc_id, score, n_channels, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_channels DESC, best DESC, doc_id))::INTEGER AS rank FROM fused QUALIFY rank <= 20")
def rrf(spark, sf):
    fused = R.fuse(_channels(spark, sf)).withColumn("rank", F.row_number().over(R.Window.partitionBy("query_id").orderBy(*R.fused_order())))
    return fused.where("rank <= 20").select("query_id", "doc_id", "score", "n_channels", "rank")


@query(W(FUSION) + "SELECT query_id, doc_id, score, best, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best DESC, doc_id DESC))::INTEGER AS rank FROM fused QUALIFY rank <= 20")
def rrf_best_first(spark, sf):
    fused = R.fuse(_channels(spark, sf)).withColumn("rank", F.row_number().over(R.Window.partitionBy("query_id").orderBy(*R.best_first_order())))
    return fused.where("rank <= 20").select("query_id", "doc_id", "score", "best", "rank")


VARIANTS = f"SELECT query_id * 100 + variant AS query_id, unnest(w) AS token FROM (SELECT query_id, variant, CASE WHEN variant = 0 THEN t ELSE [t[variant]] END AS w FROM (SELECT query_id, list_distinct({terms_sql(norm_sql('q'))}) AS t, unnest(range(0, 4)) AS variant FROM asked) WHERE variant <= len(t))"


@query(W(ASKED_SQL, bm25_sql(PART_INDEX, V.FIELD_WEIGHTS, VARIANTS)) + """, b AS (SELECT query_id // 100 AS query_id, doc_id, query_id % 100 AS variant, score FROM scored),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, variant) = 1)
SELECT query_id::INTEGER AS query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM o QUALIFY rank <= 20""")
def best_variants(spark, sf):
    """Each query as a whole and by each of its first three words; of a part the best of these counts."""
    words = asked(spark).select("query_id", T.terms(T.normalize(F.col("q"))).alias("t"))
    each = words.select("query_id", "t", F.explode(F.sequence(F.lit(0), F.least(F.size("t"), F.lit(3)))).alias("variant"))
    terms = each.select((F.col("query_id") * 100 + F.col("variant")).alias("query_id"), F.explode(F.when(F.col("variant") == 0, F.col("t")).otherwise(F.slice("t", F.greatest("variant", F.lit(1)), 1))).alias("token"))
    index = R.postings(part_docs(spark, sf), {f: f"{f}_terms" for f in FIELDS})
    hits = R.bm25(F.broadcast(terms), index, V.FIELD_WEIGHTS).select(F.floor(F.col("query_id") / 100).cast("int").alias("query_id"), "doc_id", (F.col("query_id") % 100).alias("variant"), "score")
    return best_of_variants(hits, ["query_id"], 20).select("query_id", "doc_id", "score", "rank")


@query()
def cover_density(spark, sf):
    """How near each other all terms of a benchmark text stand in the documents that hold them all."""
    docs = table(spark, sf, "documents").select("doc_id", T.terms(T.normalize(F.col("text")), distinct=False).alias("words"))
    return R.cover_density(passages(spark, sf), docs)


def cheap_hits(spark, sf, limit):
    """Ranked hits of the lexical, the lemma and the synonym channel over all parts."""
    docs = settled(part_docs(spark, sf).withColumns({f"{f}_lemmas": F.transform(f"{f}_terms", T.lemma) for f in FIELDS}))
    words = asked(spark).select("query_id", T.terms(T.normalize(F.col("q"))).alias("w"))
    lemmas = words.select("query_id", F.explode(T.lemmas(F.col("w"))).alias("token"))
    synonyms = words.join(F.broadcast(spark.createDataFrame(SYNONYMS, "term string, synonym string")), F.array_contains("w", F.col("term")) & ~F.array_contains("w", F.col("synonym"))).select("query_id", F.col("synonym").alias("token"))
    plain, by_lemma = R.postings(docs, {f: f"{f}_terms" for f in FIELDS}), R.postings(docs, {f: f"{f}_lemmas" for f in FIELDS})
    channels = {"bm25": (words.select("query_id", F.explode("w").alias("token")), plain, V.FIELD_WEIGHTS), "morphology": (lemmas, by_lemma, V.LEMMA_WEIGHTS), "synonym_bm25": (synonyms, plain, V.FIELD_WEIGHTS)}
    parts = [R.top(R.bm25(F.broadcast(terms), index, weights), limit).withColumn("channel", F.lit(name)) for name, (terms, index, weights) in channels.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Known synonyms: a fixed set.
SYNONYMS = [("red", "blue"), ("bolt", "gear"), ("steel", "small")]


@query()
def two_phase_search(spark, sf, limit=20):
    """Cheap channels choose parts by their fused ranks, structured and fuzzy ones score these, all ranks are fused. A query without a hit is tried by spelling over all parts."""
    pool, most = V.pool_size(limit), V.expanded_limit(limit)
    cheap = settled(cheap_hits(spark, sf, pool))  # what later steps use again is settled, so that no plan holds another many times
    short = settled(R.top(R.fuse(cheap).select("query_id", "doc_id", "score"), pool).select("query_id", "doc_id"))
    docs = settled(part_docs(spark, sf))
    analysed = docs.withColumns({"title_lemmas": T.lemmas(F.col("title_terms")), "category_lemmas": T.lemmas(F.col("category_terms"))}).withColumnRenamed("attributes_terms", "attribute_terms")
    analysed = T.with_analysis(analysed, F.concat_ws(" ", "title", "attributes", "category", "description"), "d")
    wanted = T.with_analysis(asked(spark), F.col("q"), "q")
    scored = settled(R.structured_scores(short.join(F.broadcast(wanted), "query_id").join(analysed.join(short.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")).select("query_id", "doc_id", "exact_score", "attribute_score"))
    parts = [cheap]
    for name, column in (("exact_structured", "exact_score"), ("attribute", "attribute_score")):
        parts.append(R.top(scored.where(F.col(column).isNotNull()).select("query_id", "doc_id", F.col(column).alias("score")), most).withColumn("channel", F.lit(name)))
    typed = asked(spark).select("query_id", T.normalize(F.col("q")).alias("text")).withColumn("variants", F.array("text"))
    there = docs.select("doc_id", F.col("title").alias("text"), F.concat_ws(" ", "title", "attributes", "category", "description").alias("whole"), F.array_distinct(F.concat(F.array("title"), "title_terms")).alias("variants"))
    without = typed.join(short, "query_id", "left_anti")
    fuzzy = R.fuzzy(typed, there, most, among=short).unionByName(R.fuzzy(without, there, most))
    parts.append(R.top(fuzzy.select("query_id", "doc_id", "score"), most).withColumn("channel", F.lit("fuzzy")))
    fused = R.fuse(reduce(lambda a, b: a.unionByName(b), parts)).withColumn("reasons", R.reasons(F.col("channel_scores")))
    ranked = fused.withColumn("rank", F.row_number().over(R.Window.partitionBy("query_id").orderBy(*R.fused_order()))).where(F.col("rank") <= limit)
    return ranked.join(B.items(spark, sf).select(F.col("item_id").alias("doc_id"), "title", "category"), "doc_id").select("query_id", "rank", "doc_id", "title", "category", "score", "n_channels", F.array_join("reasons", ",").alias("reasons"))


@query(W(DOC_WORDS, PASSAGES) + ", terms AS (SELECT query_id, unnest(w) AS token FROM asked), f AS (SELECT query_id, doc_id, count(*) AS got FROM terms JOIN (SELECT DISTINCT doc_id, token FROM words) USING (token) GROUP BY 1, 2), m AS (SELECT query_id, count(*) AS n FROM f JOIN (SELECT query_id, count(*) AS wanted FROM terms GROUP BY 1) USING (query_id) WHERE got = wanted GROUP BY 1) SELECT query_id, coalesce(n, 0) AS n FROM asked LEFT JOIN m USING (query_id) WHERE coalesce(n, 0) < 20")
def fallback_gate(spark, sf):
    wanted = passages(spark, sf)
    whole = R.met(wanted, doc_postings(spark, sf)).where("got = wanted")
    return R.short_of_hits(whole, wanted.select("query_id").distinct(), 60)


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 10""")
def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return R.nearest(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), vectors, 10, 0.2)
