"""Host-level quality rules.

Each document gets counts and rule failures. Failures are added up by host (two levels: the counts of a task first), and each host's
rate of each rule is shrunk towards all hosts by a beta prior whose parameters come from the hosts themselves (method of moments). The
shrunk rates give host verdicts, and these go back to the documents:

- a host where a rule fails more often than `strict_rate` faces that rule's strict limit instead of the usual one;
- a host whose documents fail some rule at a rate above `reject_rate` is rejected as a whole.

Rules, as 100 * a > limit * b: repeat (words in repeated 3-word windows against words, 50, strict 25), symbols (symbols against words,
10, strict 5), lines (repeated lines against lines with words, 60, strict 40); short is fewer than 50 words, at any host.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import columns, documents, frames, settle, strings

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Name, numerator, denominator, limit and strict limit in percent.
RULES = [("repeat", "n_repeat_words", "n_words", 50, 25), ("symbols", "n_symbols", "n_words", 10, 5), ("lines", "n_dup_lines", "n_lines", 60, 40)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a text. n_lines: lines with a word."""
    words = text.encode("utf-8", "surrogatepass").split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split("\n") if x and x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with COUNTS, each under `prefix` and its name, as long. Null texts count as empty. No shuffle."""
    at = docs.columns.index(text_col)
    names = [prefix + c for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames(batches):
            got = list(zip(*map(text_counts, strings(batch.column(at))), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in got)], [*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` long" for n in names)])
    return docs.mapInArrow(run, schema)


def fails(prefix: str = "", strict: bool = False) -> dict[str, Column]:
    """Failure of each rule."""
    return {name: 100 * F.col(prefix + a) > (tight if strict else limit) * F.col(prefix + b) for name, a, b, limit, tight in RULES}


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * words)


def host_verdicts(counted: DataFrame, host: str, prefix: str = "", strict_rate: float = 0.3, reject_rate: float = 0.9) -> DataFrame:
    """Rows host, n_docs, and for each rule and for any (some rule, or short) the shrunk rate, strict_<rule>, and rejected.

    A null host is a host of its own. The prior of a rule has mean m, the rate over all documents, and the weight s = m (1 - m) / v - 1,
    v the hosts' variance of rates weighted by documents; s is kept within 1 and 1000, and is 1000 where v is 0.
    """
    marks = fails(prefix)
    some = base_failed(prefix)
    for f in marks.values():
        some = some | f
    marks["any"] = some
    hosts = settle(counted.select(F.col(host).alias("host"), *[f.cast("long").alias(k) for k, f in marks.items()]).groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(k).alias(k) for k in marks]))
    totals = hosts.agg(F.sum("n_docs").alias("n"), *[F.sum(k).alias(k) for k in marks])
    rates = {k: F.coalesce(F.try_divide(f"all_{k}", "all_n"), F.lit(0.0)) for k in marks}
    with_totals = hosts.join(F.broadcast(totals.select(*[F.col(c).alias(f"all_{c}") for c in totals.columns])))
    moments = with_totals.agg(F.first("all_n").alias("n"), *[F.first(m).alias(f"m_{k}") for k, m in rates.items()], *[F.sum(F.col("n_docs") * (F.col(k) / F.col("n_docs") - m) ** 2).alias(f"v_{k}") for k, m in rates.items()]).first()
    out = hosts
    for k in marks:
        m = moments[f"m_{k}"] or 0.0
        v = (moments[f"v_{k}"] or 0.0) / moments["n"] if moments["n"] else 0.0
        s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        out = out.withColumn(f"rate_{k}", (F.col(k) + m * s) / (F.col("n_docs") + s))
    return out.select("host", "n_docs", *[f"rate_{k}" for k in marks], *[(F.col(f"rate_{k}") > strict_rate).alias(f"strict_{k}") for k in marks if k != "any"], (F.col("rate_any") > reject_rate).alias("rejected"))


def judged(counted: DataFrame, host: str, verdicts: DataFrame, prefix: str = "", most_broadcast: int = 100_000) -> DataFrame:
    """`counted` with host_rejected, failed_rule (first that rejects the document, else null) and kept, under `prefix`.

    The verdicts are broadcast if there are at most `most_broadcast` hosts, which are counted first; more are joined by a shuffle, whose
    hot hosts Spark splits.
    """
    verdicts = settle(verdicts.select(F.col("host").alias("__host"), "rejected", *[f"strict_{r[0]}" for r in RULES]))
    if verdicts.count() <= most_broadcast:
        verdicts = F.broadcast(verdicts)
    joined = counted.join(verdicts, counted[f"`{host}`"].eqNullSafe(F.col("__host")), "left")
    usual, strict = fails(prefix), fails(prefix, strict=True)
    why = F.when(base_failed(prefix), "base")
    for k in usual:
        why = why.when(usual[k] | (F.col(f"strict_{k}") & strict[k]), k)
    why = why.when(F.col("rejected"), "host")
    done = joined.withColumns({f"{prefix}host_rejected": F.col("rejected"), f"{prefix}failed_rule": why})
    return done.withColumn(f"{prefix}kept", F.col(f"{prefix}failed_rule").isNull()).drop("__host", "rejected", *[f"strict_{r[0]}" for r in RULES])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows doc_id, host, COUNTS, base_failed, host_rejected, failed_rule and kept, one for each row of `docs`.

    Null and empty texts have no words, so base fails. Null ids and repeated rows are judged like others, null hosts as one host; an
    empty table gives an empty one. Other columns aren't read.
    """
    counted = settle(with_counts(columns(docs, doc_id=id_col, host=host_col, text=text_col)).drop("text"))
    return judged(counted, "host", host_verdicts(counted, "host")).withColumn("base_failed", base_failed())


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns. Texts are read twice, for the hosts' rates and for the verdicts."""
    mark = "__quality_"
    verdicts = host_verdicts(with_counts(columns(docs, host=host_col, text=text_col)).drop("text"), "host")
    return judged(with_counts(docs, text_col, mark), host_col, verdicts, mark).where(f"{mark}kept").select(*[f"`{c}`" for c in docs.columns])


def op2_host_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *[F.col(c).cast("long") for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]], "base_failed", "kept", "host", F.col("n_lines").cast("long"), "host_rejected", "failed_rule")


#: The same in DuckDB SQL.
OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT win.r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN again ON win.r = again.r AND win.g = again.g) GROUP BY r),
c AS (
  SELECT d.r, doc_id, host, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN rep ON d.r = rep.r),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_repeat_words > 50 * n_words AS repeat, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 60 * n_lines AS lines,
         100 * n_repeat_words > 25 * n_words AS repeat2, 100 * n_symbols > 5 * n_words AS symbols2, 100 * n_dup_lines > 40 * n_lines AS lines2
  FROM c),
long AS (
  SELECT host, u.k AS k, u.f::BIGINT AS f
  FROM (SELECT host, unnest([{'k': 'repeat', 'f': repeat}, {'k': 'symbols', 'f': symbols}, {'k': 'lines', 'f': lines},
                             {'k': 'any', 'f': base_failed OR repeat OR symbols OR lines}]) AS u FROM f)),
h AS (SELECT host, k, count(*) AS n, sum(f) AS x FROM long GROUP BY host, k),
m AS (SELECT k, sum(x)::DOUBLE / sum(n) AS m, sum(n) AS n FROM h GROUP BY k),
v AS (SELECT h.k, any_value(m.m) AS m, sum(h.n * pow(h.x::DOUBLE / h.n - m.m, 2)) / any_value(m.n) AS v FROM h JOIN m ON h.k = m.k GROUP BY h.k),
s AS (SELECT k, m, CASE WHEN v > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, m * (1 - m) / v - 1)) ELSE 1000.0::DOUBLE END AS s FROM v),
rate AS (SELECT host, h.k, (x + m * s) / (n + s) AS rate FROM h JOIN s ON h.k = s.k),
verdict AS (
  SELECT host, bool_or(k = 'repeat' AND rate > 0.3) AS strict_repeat, bool_or(k = 'symbols' AND rate > 0.3) AS strict_symbols,
         bool_or(k = 'lines' AND rate > 0.3) AS strict_lines, bool_or(k = 'any' AND rate > 0.9) AS rejected
  FROM rate GROUP BY host),
j AS (
  SELECT f.*, rejected, CASE WHEN base_failed THEN 'base' WHEN repeat OR (strict_repeat AND repeat2) THEN 'repeat'
         WHEN symbols OR (strict_symbols AND symbols2) THEN 'symbols' WHEN lines OR (strict_lines AND lines2) THEN 'lines'
         WHEN rejected THEN 'host' END AS failed_rule
  FROM f JOIN verdict ON f.host IS NOT DISTINCT FROM verdict.host)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, failed_rule IS NULL AS kept,
       host, n_lines::BIGINT AS n_lines, rejected AS host_rejected, failed_rule
FROM j
"""
