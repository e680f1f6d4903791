"""Licence scans by diagonal voting, in DataFrame functions only.

Texts and licence templates are words. All rolling runs of k words of every text are hashed and joined to the template positions with the
same hash. A hit at word p of the text and word t of the template votes for diagonal p - t; a copied notice leaves its votes on one
diagonal, and on neighbouring ones where words were put in or left out. Votes are added up by text, template and diagonal; neighbouring
diagonals are merged; and the stretch of words that they span is cut out of the text and compared with the template by edit distance.

A chain of neighbouring diagonals may be of any length, as where notices with the same words follow each other. It is cut at its densest
diagonals: one with most votes of those within half a template's length (the least diagonal of equals) makes a stretch with all of these,
so a stretch has at most the words of two templates, and none of a notice is cut off. The words on the densest diagonal alone, as many as the
template has, are compared as well, and the better of the two counts.

The templates are the constants below, so their side of the join is broadcast, and what later steps need of them is looked up in a literal.
Spans found are added up before they are joined back to the texts for the comparison: up to `most_broadcast` bytes are broadcast, more are
joined by a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.shared import broadcast_if_small, columns, documents, settle

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z in lower case; of a null, none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def run_hashes(words_: Column, k: int) -> Column:
    """XXH64 of each run of k words, by its start from 0; fewer words have none."""
    starts = F.when(F.size(words_) >= k, F.sequence(F.lit(0), F.size(words_) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words_, i + j) for j in range(k)]))


def split_templates(templates: list[tuple[str, str]]) -> list[list[str]]:
    """The words of each template, as `words` has them."""
    return [[w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w] for _, text in templates]


def template_table(spark, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """Rows template, t_pos, hash: one for each run of k words of each template."""
    rows = spark.createDataFrame(list(enumerate(split_templates(templates))), "template int, w array<string>")
    return rows.select("template", F.posexplode(run_hashes(F.col("w"), k)).alias("t_pos", "hash"))


def looked_up(values: list, template: Column) -> Column:
    """The template's value, by its number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), template + 1)


def phrase_starts(words_: Column, text: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand one after another. Texts without its first word are not searched."""
    parts = phrase.split(" ")
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words_, i + j) == p for j, p in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size(words_) - len(parts)), here)
    may = (F.size(words_) >= len(parts)) & F.translate(text, UPPER, LOWER).contains(parts[0])
    return F.when(may, found).otherwise(F.array().cast("array<int>"))


def spans(docs: DataFrame, templates: list[tuple[str, str]], k: int = 3, gap: int = 3, share: float = 0.6) -> DataFrame:
    """Rows doc_id, text_hash, template, start, length, diagonal: stretches of texts that hold a template's runs, and their densest diagonals.

    `docs` has doc_id, text_hash and w, the text's words. Diagonals of a text and template that differ by at most `gap` are one chain, which
    is cut at its densest diagonals; a stretch counts if at least `share` of the template's runs vote for it.
    """
    table = F.broadcast(template_table(docs.sparkSession, templates, k))
    runs = docs.select("doc_id", "text_hash", F.posexplode(run_hashes(F.col("w"), k)).alias("pos", "hash"))
    hits = runs.join(table, "hash")
    by = ["doc_id", "text_hash", "template"]
    votes = hits.groupBy(*by, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("voted"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    chained = votes.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = [len(w) for w in split_templates(templates)]
    most = max(sizes, default=0) // 2
    beside = Window.partitionBy(*by, "chain").orderBy("diagonal").rangeBetween(-most, most)
    half = looked_up([n // 2 for n in sizes], F.col("template"))
    around = F.filter(F.collect_list(F.struct(F.size("voted").alias("n"), (-F.col("diagonal")).alias("d"), "voted", "first", "last")).over(beside), lambda x: F.abs(x["d"] + F.col("diagonal")) <= half)
    dense = chained.withColumn("around", around).where(F.array_max(F.transform("around", lambda x: F.struct(x["n"], x["d"]))) == F.struct(F.size("voted"), -F.col("diagonal")))
    start, last = F.array_min(F.transform("around", lambda x: x["first"])), F.array_max(F.transform("around", lambda x: x["last"]))
    enough = F.size(F.array_distinct(F.flatten(F.transform("around", lambda x: x["voted"])))) >= F.lit(share) * looked_up([n - (k - 1) for n in sizes], F.col("template"))
    return dense.where(enough).select(*by, start.alias("start"), (last - start + k).alias("length"), "diagonal")


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, k: int = 3, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 32 << 20) -> DataFrame:
    """Rows doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (label, start, length, similarity), for each row.

    n_base counts all places of the phrases, first_word and last_word are the smallest and largest (null without one). Labels are distinct,
    sorted and comma-joined, empty without one. similarity is 1 - edit distance / longer length of the stretch's words and the template's,
    space-joined; a label counts from `least` on. score is 1 with a phrase, else the best similarity, else 0. Null and empty texts have no
    words. Rows that share an id and a text have equal results; null ids are kept. Other columns aren't read.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    text = F.coalesce("text", F.lit(""))
    own = columns(docs, doc_id=id_col, text=text_col).select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), words(F.col("text")).alias("w"))
    found = settle(spans(own, templates, k).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "template", "length", "diagonal"))).alias("spans")))
    found = broadcast_if_small(found, F.lit(32) + 16 * F.size("spans"), most_broadcast)
    joined = own.join(found, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "spans", "w")
    wholes = [" ".join(w) for w in split_templates(templates)]

    sizes = [len(w) for w in split_templates(templates)]

    def match(s: Column) -> Column:
        wanted = looked_up(wholes, s["template"])

        def compared(start: Column, length: Column) -> Column:
            there = F.array_join(F.slice("w", start + 1, length), " ")
            alike = 1 - F.levenshtein(there, wanted) / F.greatest(F.length(there), F.length(wanted))
            return F.struct(F.round(alike, 6).alias("similarity"), start.alias("start"), length.alias("length"))

        best = F.array_max(F.array(compared(s["start"], s["length"]), compared(F.greatest(s["diagonal"], F.lit(0)), looked_up(sizes, s["template"]))))
        return F.struct(looked_up([label for label, _ in templates], s["template"]).alias("label"), best["start"].alias("start"), best["length"].alias("length"), best["similarity"].alias("similarity"))

    matches = F.filter(F.transform("spans", match), lambda m: m["similarity"] >= least)
    starts = {label: phrase_starts(F.col("w"), F.col("text"), phrase) for phrase, label in phrases.items()}
    places = F.concat(*starts.values())
    labels = F.filter(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for label, s in starts.items()]), lambda x: x.isNotNull())
    out = joined.select("doc_id", F.size("w").cast("long").alias("n_words"), places.alias("places"), labels.alias("base"), F.coalesce(matches, F.array().cast("array<struct<label:string,start:int,length:int,similarity:double>>")).alias("matches"))
    n_base = F.size("places").cast("long")
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0))).alias("score"),
        "matches",
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("matches")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same in DuckDB SQL, joining on the words themselves instead of their hashes. Its edit distance counts bytes, so it agrees where matched stretches are ASCII.
OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (
  SELECT template, label, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (VALUES {", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))}) v(template, label, text)),
tg AS (SELECT template, i AS t_pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT template, w, unnest(range(0, len(w) - 2)) AS i FROM t)),
dg AS (SELECT r, i AS pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
votes AS (SELECT r, template, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS voted, min(pos) AS first, max(pos) AS last FROM dg JOIN tg USING (g) GROUP BY ALL),
cut AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS apart FROM votes),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS stretch FROM cut),
sizes AS (SELECT template, label, w, len(w) // 2 AS half FROM t),
around AS (
  SELECT a.r, a.template, a.diagonal, any_value(len(a.voted)) AS n, max(struct_pack(n := len(b.voted), d := -b.diagonal)) AS best,
         len(list_distinct(flatten(list(b.voted)))) AS voted, min(b.first) AS start, max(b.last) AS last
  FROM numbered a JOIN numbered b ON a.r = b.r AND a.template = b.template AND a.stretch = b.stretch JOIN sizes ON sizes.template = a.template
  WHERE abs(a.diagonal - b.diagonal) <= half GROUP BY a.r, a.template, a.diagonal),
merged AS (SELECT * FROM around WHERE best.n = n AND best.d = -diagonal),
spans AS (
  SELECT d.r, t.label, unnest([array_to_string(d.w[start + 1:last + 3], ' '), array_to_string(d.w[greatest(diagonal, 0) + 1:greatest(diagonal, 0) + len(t.w)], ' ')]) AS a, array_to_string(t.w, ' ') AS b
  FROM merged JOIN t USING (template) JOIN d USING (r) WHERE voted >= 0.6::DOUBLE * (len(t.w) - 2)),
alike AS (SELECT r, label, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS similarity FROM spans),
found AS (SELECT r, list(DISTINCT label) AS labels, max(similarity) AS best FROM alike WHERE similarity >= 0.7 GROUP BY r),
base AS (
  SELECT r, doc_id, len(w) AS n_words,
         {", ".join(f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: {' AND '.join(f'w[i + {j + 1}] = {_quoted(x)}' for j, x in enumerate(p.split()))}) AS p{n}" for n, p in enumerate(PHRASES))}
  FROM d),
named AS (
  SELECT *, {" || ".join(f"p{n}" for n in range(len(PHRASES)))} AS places,
         list_filter([{", ".join(f"CASE WHEN len(p{n}) > 0 THEN {_quoted(x)} END" for n, x in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS own FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(own || coalesce(labels, []))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM named LEFT JOIN found USING (r)
"""
