"""Queries of query resolution, further channels and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vocabulary as V
from spindrift.operators import resolution as N
from spindrift.operators import retrieval as R
from spindrift.operators import telemetry as M
from spindrift.plans import bindings as B
from spindrift.plans import search as Q
from spindrift.plans.registry import query
from spindrift.session import table

W = B.with_sql


@query(W(B.ITEMS) + "SELECT item_id, title, category FROM items WHERE title ILIKE '%bolt%' OR description ILIKE '%brand#1%' ORDER BY title, item_id LIMIT 50")
def ilike_search(spark, sf):
    rows = B.items(spark, sf).where(F.col("title").ilike("%bolt%") | F.col("description").ilike("%brand#1%"))
    return rows.select("item_id", "title", "category").orderBy("title", "item_id").limit(50)


SYNONYM_SQL = "synonyms AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in Q.SYNONYMS) + ") t(term, synonym))"


@query(W(Q.ASKED_SQL, SYNONYM_SQL, Q.bm25_sql(Q.PART_INDEX, V.FIELD_WEIGHTS, f"SELECT query_id, synonym AS token FROM (SELECT query_id, w, unnest(w) AS term FROM (SELECT query_id, {Q.terms_sql(Q.norm_sql('q'))} AS w FROM asked)) JOIN synonyms USING (term) WHERE NOT list_contains(w, synonym)")) + "SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored QUALIFY rank <= 10")
def bm25_synonyms(spark, sf):
    words = Q.asked(spark).select("query_id", T.terms(T.normalize(F.col("q"))).alias("w"))
    table_ = spark.createDataFrame(Q.SYNONYMS, "term string, synonym string")
    wanted = words.select("query_id", "w", F.explode("w").alias("term")).join(F.broadcast(table_), "term").where(~F.array_contains("w", F.col("synonym"))).select("query_id", F.col("synonym").alias("token"))
    index = R.postings(Q.part_docs(spark, sf), {f: f"{f}_terms" for f in Q.FIELDS})
    return R.top(R.bm25(F.broadcast(wanted), index, V.FIELD_WEIGHTS), 10)


#: Russian queries, in other forms than the titles'.
RUSSIAN_ASKED = [(1, "красные болты"), (2, "синего болта 5 шт"), (3, "большие приборы 10мм"), (4, "для старых молотов"), (5, "горячий редуктор"), (6, "обручей")]


def text_map_sql(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def russian_terms_sql(x: str) -> str:
    """Terms of a Russian text: units spelled out, no stop words, no single letters."""
    full = f"list_transform({Q.words_sql(Q.norm_sql(f'replace({x}, chr(1105), chr(1077))'))}, lambda t: coalesce(({text_map_sql(V.UNIT_NAMES)})[t], t))"
    return f"list_filter({full}, lambda t: NOT list_contains({V.STOP_WORDS}, t) AND (regexp_matches(t, '^[0-9]+$') OR length(t) BETWEEN 2 AND {V.LONGEST_TOKEN}))"


def lemma_sql(t: str) -> str:
    """The first base form by the word's ending, or the word."""
    rules = " ".join(f"WHEN ends_with({t}, '{suffix}') AND length({t}) >= {len(suffix) + 3} THEN {t}[:length({t}) - {len(suffix)}] || '{base}'" for suffix, base in V.SUFFIXES)
    return f"CASE WHEN NOT regexp_matches({t}, '^[а-я]+$') THEN {t} WHEN ends_with({t}, 'и') AND length({t}) >= 5 THEN {t}[:length({t}) - 1] {rules} ELSE {t} END"


RUSSIAN_QUERIES = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in RUSSIAN_ASKED) + ") t(query_id, q))"
RUSSIAN_INDEX = B.RUSSIAN_SQL + f",\nfields AS (SELECT item_id AS doc_id, 'title' AS field, list_transform({russian_terms_sql('title')}, lambda t: {lemma_sql('t')}) AS w FROM russian)"
RUSSIAN_LEMMAS = f"SELECT query_id, unnest(list_filter(list_transform(list_filter(flatten(list_transform({russian_terms_sql('q')}, lambda t: string_split(t, ' '))), lambda t: NOT list_contains({V.STOP_WORDS}, t)), lambda t: {lemma_sql('t')}), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]+$'))) AS token FROM asked"


@query(W(RUSSIAN_QUERIES, Q.bm25_sql(RUSSIAN_INDEX, {"title": V.LEMMA_WEIGHTS["title"]}, RUSSIAN_LEMMAS)) + "SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored QUALIFY rank <= 10")
def bm25_lemmas(spark, sf):
    """Russian titles by base forms of their words: queries are in other forms."""
    docs = B.russian_items(spark, sf).select(F.col("item_id").alias("doc_id"), F.transform(T.terms(T.normalize(F.col("title")), distinct=False), T.lemma).alias("words"))
    asked = spark.createDataFrame(RUSSIAN_ASKED, "query_id int, q string")
    wanted = asked.select("query_id", F.explode(T.lemmas(T.terms(T.normalize(F.col("q"))))).alias("token"))
    return R.top(R.bm25(F.broadcast(wanted), R.postings(docs, {"title": "words"}), V.LEMMA_WEIGHTS), 10)


@query(W(B.RUSSIAN_SQL) + f"SELECT item_id, title, array_to_string({russian_terms_sql('title')}, '|') AS terms, array_to_string(list_transform({russian_terms_sql('title')}, lambda t: {lemma_sql('t')}), '|') AS lemmas FROM russian")
def russian_terms(spark, sf):
    items = B.russian_items(spark, sf).withColumn("t", T.terms(T.normalize(F.col("title")), distinct=False))
    return items.select("item_id", "title", F.array_join("t", "|").alias("terms"), F.array_join(F.transform("t", T.lemma), "|").alias("lemmas"))


#: Known misspellings, and what they stand for.
DICTIONARY = {"прибр": "прибор", "болд": "болт"}

#: Queries: a twentieth of the Russian titles, each second word without its third letter, some with a known misspelling.
TYPED_SQL = f"""{B.RUSSIAN_SQL}, vocab AS (SELECT token, count(DISTINCT item_id) AS freq FROM (SELECT item_id, unnest({Q.words_sql(Q.norm_sql("title"))}) AS token FROM russian) WHERE regexp_matches(token, '^[а-я]{{3,}}$') GROUP BY 1),
typed AS (SELECT item_id AS query_id, CASE WHEN item_id % 60 = 0 THEN w[1] || ' прибр' ELSE w[1] || ' ' || w[2][:2] || w[2][4:] END AS n FROM (SELECT item_id, string_split(title, ' ') AS w FROM russian WHERE item_id % 20 = 0)),
parts AS (SELECT query_id, unnest(string_split(n, ' ')) AS token, generate_subscripts(string_split(n, ' '), 1) AS place FROM typed),
open_words AS (SELECT * FROM parts WHERE regexp_matches(token, '^[а-я]{{4,}}$') AND token NOT IN (SELECT token FROM vocab))"""

RESOLVED_SQL = f"""by_word AS (SELECT query_id, array_to_string(list(coalesce(({text_map_sql(DICTIONARY)})[token], token) ORDER BY place), ' ') AS text FROM parts GROUP BY 1),
spelled AS (SELECT query_id, array_to_string(list(coalesce(corrected, p.token) ORDER BY place), ' ') AS text, min(score) AS score, count(corrected) AS n FROM parts p LEFT JOIN (SELECT * FROM sc WHERE score >= 0.64) c ON c.token = p.token GROUP BY 1),
nearest AS (SELECT token, candidate FROM (SELECT *, min(distance) OVER (PARTITION BY token) AS best_distance FROM o) WHERE distance - best_distance <= 1 QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, shared DESC, delta, freq DESC, candidate) = 1),
tried AS (SELECT p.query_id, array_to_string(list(coalesce(candidate, p.token) ORDER BY p.place), ' ') AS text, count(candidate) AS n FROM parts p LEFT JOIN open_words w ON w.query_id = p.query_id AND w.place = p.place LEFT JOIN nearest ON nearest.token = w.token WHERE p.query_id NOT IN (SELECT query_id FROM spelled WHERE n > 0) GROUP BY 1),
every AS (SELECT query_id, n AS text, 'original' AS source, 'high' AS confidence, 0 AS o FROM typed UNION ALL SELECT by_word.query_id, text, 'dictionary', 'high', 1 FROM by_word JOIN typed ON by_word.query_id = typed.query_id AND text <> n
  UNION ALL SELECT query_id, text, 'fuzzy', CASE WHEN score >= 0.82 THEN 'high' WHEN score >= 0.64 THEN 'medium' ELSE 'low' END, 3 FROM spelled WHERE n > 0 UNION ALL SELECT query_id, text, 'fallback', 'low', 4 FROM tried WHERE n > 0),
level AS (SELECT *, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS l FROM every),
chosen AS (SELECT * FROM level QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY l, o) = 1)"""


@query(W(TYPED_SQL, Q.pairs_sql("SELECT DISTINCT token FROM open_words", "SELECT token, freq FROM vocab", both=True), Q.CORRECTED, RESOLVED_SQL) + "SELECT query_id, text, source, confidence, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN confidence = 'high' AND source <> 'original' THEN o WHEN source = 'original' THEN 100 ELSE 1000 END, text) = 1 AS is_primary FROM chosen")
def query_resolution(spark, sf):
    words = F.split("title", " ")
    second = F.concat(F.substring(words[1], 1, 2), words[1].substr(F.lit(4), F.length(words[1])))
    typed = F.concat_ws(" ", words[0], F.when(F.col("item_id") % 60 == 0, "прибр").otherwise(second))
    asked = B.russian_items(spark, sf).where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), typed.alias("q"))
    titles = B.russian_items(spark, sf).select(F.explode(F.array_distinct(T.split_words(T.normalize(F.col("title"))))).alias("candidate"))
    vocabulary = titles.where("candidate RLIKE '^[а-я]{3,}$'").groupBy("candidate").agg(F.count("*").alias("freq"))
    return N.variants(asked, DICTIONARY, vocabulary)


@query(f"SELECT p_partkey AS item_id, array_to_string((CASE WHEN len(list_filter(a, lambda x: list_contains(b, x))) >= 2 THEN list_filter(a, lambda x: list_contains(b, x)) ELSE a END)[:3], ' ') AS query FROM (SELECT p_partkey, {Q.terms_sql(Q.norm_sql('p_name'))} AS a, {Q.terms_sql(Q.norm_sql(chr(39) + chr(39) + ' || p_type || ' + chr(39) + ' ' + chr(39) + ' || p_name'))} AS b FROM part)")
def query_synthesis(spark, sf):
    terms = lambda *c: T.terms(T.normalize(F.concat_ws(" ", *c)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), N.synthesized(terms("p_name"), terms("p_type", "p_name"), terms("p_type"), 3).alias("query"))


@query("""WITH h AS (SELECT 'history' AS grp, event_type AS label, row_number() OVER (ORDER BY max(ts) DESC, event_type) AS place, 0 AS rk FROM events WHERE user_id = 7 GROUP BY event_type QUALIFY place <= 3),
c AS (SELECT 'categories', p_type, row_number() OVER (ORDER BY p_type), 1 FROM (SELECT DISTINCT p_type FROM part) QUALIFY row_number() OVER (ORDER BY p_type) <= 3),
p AS (SELECT 'products', p_name, row_number() OVER (ORDER BY p_name), 2 FROM (SELECT DISTINCT p_name FROM part WHERE p_name LIKE '%bolt%') QUALIFY row_number() OVER (ORDER BY p_name) <= 5)
SELECT grp, label, place FROM (SELECT * FROM h UNION ALL SELECT * FROM c UNION ALL SELECT * FROM p) ORDER BY rk, place LIMIT 8""")
def suggestions(spark, sf):
    numbered = lambda df, *order: df.withColumn("place", F.row_number().over(R.Window.orderBy(*order)))  # noqa: E731  over at most a few rows
    first = lambda df, n, *order: numbered(df.orderBy(*order).limit(n), *order)
    history = table(spark, sf, "events").where("user_id = 7").groupBy(F.col("event_type").alias("label")).agg(F.max("ts").alias("last"))
    categories = table(spark, sf, "part").select(F.col("p_type").alias("label")).distinct()
    products = table(spark, sf, "part").where("p_name LIKE '%bolt%'").select(F.col("p_name").alias("label")).distinct()
    return N.suggestions([("history", first(history, 3, F.desc("last"), "label"), 3), ("categories", first(categories, 3, "label"), 3), ("products", first(products, 5, "label"), 5)], 8)


@query(W(B.SESSIONS) + ", f AS (SELECT user_id, session, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM sessions GROUP BY 1, 2) SELECT round((count(*) FILTER (WHERE NOT v))::DOUBLE / count(*), 4) AS without_views, round((count(*) FILTER (WHERE c AND NOT v))::DOUBLE / count(*) FILTER (WHERE c), 4) AS clicks_without_views, round((count(*) FILTER (WHERE p AND NOT c))::DOUBLE / count(*) FILTER (WHERE p), 4) AS purchases_without_clicks FROM f")
def quality_ratios(spark, sf):
    has = lambda k: F.bool_or(F.col("event_type") == k)
    flags = B.sessions(spark, sf).groupBy("user_id", "session").agg(has("view").alias("v"), has("click").alias("c"), has("purchase").alias("p"))
    return flags.agg(M.ratio(F.count_if(~F.col("v")), F.count("*")).alias("without_views"), M.ratio(F.count_if(F.col("c") & ~F.col("v")), F.count_if(F.col("c"))).alias("clicks_without_views"), M.ratio(F.count_if(F.col("p") & ~F.col("c")), F.count_if(F.col("p"))).alias("purchases_without_clicks"))


@query(W(B.SESSIONS) + "SELECT user_id, session, item_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM sessions GROUP BY 1, 2, 3")
def event_type_sets(spark, sf):
    return B.sessions(spark, sf).groupBy("user_id", "session", "item_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 50")
def collated_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy(F.collate("s_name", "RU"), "s_suppkey").limit(50)


@query()
def tfidf_ridge(spark, sf):
    """Prices from words of titles, by TF-IDF of one and two words and a ridge regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("label"), T.terms(T.normalize(F.concat_ws(" ", "p_name", "p_type")), distinct=False).alias("words"))
    steps = [NGram(n=2, inputCol="words", outputCol="pairs"), CountVectorizer(inputCol="words", outputCol="c1", vocabSize=30_000, minDF=2), CountVectorizer(inputCol="pairs", outputCol="c2", vocabSize=30_000, minDF=2), IDF(inputCol="c1", outputCol="t1"), IDF(inputCol="c2", outputCol="t2"), VectorAssembler(inputCols=["t1", "t2"], outputCol="features"), LinearRegression(regParam=1.0, elasticNetParam=0.0)]
    return Pipeline(stages=steps).fit(rows).transform(rows).select("p_partkey", F.round("prediction", 4).alias("prediction"))
