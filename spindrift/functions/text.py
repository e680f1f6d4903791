"""Text functions, Column to Column, of built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import vocabulary as V

EMPTY = "array<string>"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def mapped(column: Column, pairs: dict[str, str]) -> Column:
    """The mapped value, or the value itself."""
    return F.coalesce(F.try_element_at(literal_map(pairs), column), column)


def squash(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def normalize(column: Column) -> Column:
    """Lower case without ё, unit and size notations made one, separators between letters and other marks made blanks, set phrases replaced. Null is empty."""
    x = F.translate(F.lower(F.coalesce(column, F.lit(""))), "ё", "е")
    x = F.regexp_replace(x, r"(?U)\bг\s*/\s*м(?:2\b|²(?![\w²]))", "гм2")
    x = F.regexp_replace(x, r"(?U)(?<=\d)\s*[xх]\s*(?=\d)", "х")
    x = F.regexp_replace(x, r"(?<=[a-zа-яё])[-/](?=[a-zа-яё])", " ")
    x = F.regexp_replace(x, r"(?U)[^0-9a-zа-яё./\s-]+", " ")
    for pattern, phrase in V.PHRASES:
        x = F.regexp_replace(x, "(?U)" + pattern, phrase)
    return squash(x)


def is_digits(column: Column) -> Column:
    return column.rlike("^[0-9]+$")


def split_words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def tokens(normalized: Column) -> Column:
    """Words of a normalized text that aren't too long."""
    return F.filter(split_words(normalized), lambda x: (F.length(x) <= V.LONGEST_TOKEN) | is_digits(x))


def terms(normalized: Column, distinct: bool = True) -> Column:
    """Words with units spelled out, without stop words and single letters."""
    full = F.transform(split_words(normalized), lambda x: mapped(x, V.UNIT_NAMES))
    keep = F.filter(full, lambda x: ~x.isin(V.STOP_WORDS) & (is_digits(x) | (F.length(x).between(2, V.LONGEST_TOKEN))))
    return F.array_distinct(keep) if distinct else keep


def signature(normalized: Column) -> Column:
    return F.translate(normalized, V.SIGNATURE_FROM, V.SIGNATURE_TO)


def most_edits(sig: Column) -> Column:
    return F.when(F.length(sig) <= 4, 1).when(F.length(sig) <= 8, 2).otherwise(3)


def is_layout_mistake(token: Column) -> Column:
    """A Latin word of four letters or more with few vowels, or four consonants in a row."""
    vowels = F.length(F.regexp_replace(token, "[^aeiouy]", ""))
    return token.rlike("^[a-z]{4,}$") & ~token.isin(V.LATIN_KEPT) & ((vowels / F.length(token) < 0.25) | token.rlike("[^aeiouy]{4}"))


def fix_layout(normalized: Column) -> Column:
    """The text with words typed in the wrong layout retyped; null if nothing changes."""
    retyped = F.transform(split_words(normalized), lambda x: F.when(is_layout_mistake(x), F.translate(x, V.LATIN_KEYS, V.CYRILLIC_KEYS)).otherwise(x))
    fixed = normalize(F.array_join(retyped, " "))
    return F.when(fixed != normalized, fixed)


def _by_ending(term: Column, give) -> Column:
    """What `give` (stem, replacement) makes of a word by the first ending that leaves three letters; null without one. One flat case, so that plans stay small."""
    out = None
    for suffix, base in V.SUFFIXES:
        fits = term.endswith(suffix) & (F.length(term) >= len(suffix) + 3)
        made = give(term.substr(F.lit(1), F.length(term) - len(suffix)), base)
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _is_word(term: Column) -> Column:
    return term.rlike(f"^[а-я]{{1,{V.LONGEST_TOKEN}}}$")


def _ends_in_i(term: Column) -> Column:
    return term.endswith("и") & (F.length(term) >= 5)


def fallback_variants(term: Column) -> Column:
    """Stems and base forms of a Cyrillic word by its ending, in order: of a last и its stem (and the stem with а after some letters), then of the first ending the base and a stem of four letters."""
    none = F.array().cast(EMPTY)
    stem_i = term.substr(F.lit(1), F.length(term) - 1)
    from_i = F.when(_ends_in_i(term), F.when(F.substring(term, -2, 1).isin(list(V.ENDINGS_TO_A)), F.array(stem_i, F.concat(stem_i, F.lit("а")))).otherwise(F.array(stem_i))).otherwise(none)
    by_rule = _by_ending(term, lambda stem, base: F.when(F.length(stem) >= 4, F.array(F.concat(stem, F.lit(base)), stem)).otherwise(F.array(F.concat(stem, F.lit(base)))))
    found = F.array_distinct(F.concat(from_i, F.coalesce(by_rule, none)))
    return F.when(_is_word(term), F.filter(found, lambda x: x != term)).otherwise(none)


def lemma(term: Column) -> Column:
    """The first fallback variant of a word, or the word. Stands in for a morphological analyser."""
    by_rule = _by_ending(term, lambda stem, base: F.concat(stem, F.lit(base)))
    return F.when(~_is_word(term), term).when(_ends_in_i(term), term.substr(F.lit(1), F.length(term) - 1)).otherwise(F.coalesce(by_rule, term))


def lemmas(terms_: Column) -> Column:
    single = F.filter(F.flatten(F.transform(terms_, lambda t: F.split(t, " "))), lambda x: ~x.isin(V.STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(single, lemma), lambda x: (F.length(x) > 1) | is_digits(x)))


def expand(term: Column) -> Column:
    """A term, what it abbreviates and its base forms, each variant of several words followed by its words and theirs, in order of first sight."""
    table = F.create_map(*[x for k, v in V.EXPANSIONS.items() for x in (F.lit(k), literal_array(v))])
    of = lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast(EMPTY))
    single = lambda t: F.concat(F.array(t), of(t), fallback_variants(t))
    parts = lambda v: F.flatten(F.transform(terms(v), single))
    every = F.flatten(F.transform(single(term), lambda v: F.when(v.contains(" "), F.concat(F.array(v), parts(v))).otherwise(F.array(v))))
    return F.array_distinct(F.filter(every, lambda v: (F.length(v) >= 2) | is_digits(v)))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text, padded by two blanks before and one after; none of an empty text."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n))))).otherwise(F.array().cast(EMPTY))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def word_grams(text: Column) -> Column:
    """Distinct trigrams of each run of letters and digits, in lower case, padded by itself."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-zа-яё]+"), 0), lambda w: grams(w))))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that are equal."""
    most = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), most), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


# Structured analysis of a token array.


def is_number(token: Column) -> Column:
    return token.rlike(V.NUMBER_PATTERN) & token.rlike("[0-9]")


def unit_of(token: Column) -> Column:
    full = mapped(token, V.UNIT_NAMES)
    return F.when(full.isin(V.UNITS), full)


def quantities(tokens_: Column) -> Column:
    """Distinct (raw, value, unit): a number with its unit attached, or followed by it."""
    following = F.zip_with(tokens_, F.slice(F.concat(tokens_, F.array(F.lit(""))), F.lit(2), F.greatest(F.size(tokens_), F.lit(1))), lambda t, n: F.struct(t.alias("t"), n.alias("n")))

    def found(p: Column) -> Column:
        attached = unit_of(F.regexp_extract(p["t"], V.ATTACHED_PATTERN, 2))
        value = F.regexp_extract(p["t"], V.ATTACHED_PATTERN, 1)
        as_attached = F.struct(p["t"].alias("raw"), value.alias("value"), attached.alias("unit"))
        as_pair = F.struct(F.concat_ws(" ", p["t"], p["n"]).alias("raw"), p["t"].alias("value"), unit_of(p["n"]).alias("unit"))
        return F.when(attached.isNotNull(), as_attached).when(is_number(p["t"]) & unit_of(p["n"]).isNotNull(), as_pair)

    all_found = F.filter(F.transform(following, found), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<raw:string,value:string,unit:string>>")
    return F.aggregate(all_found, empty, lambda acc, x: F.when(F.exists(acc, lambda y: (y["value"] == x["value"]) & (y["unit"] == x["unit"])), acc).otherwise(F.concat(acc, F.array(x))))


def sizes(tokens_: Column) -> Column:
    return F.array_distinct(F.filter(tokens_, lambda x: x.isin(V.SIZES) | x.rlike(V.PAPER_PATTERN) | x.rlike(V.DIMENSION_PATTERN)))


def brands(tokens_: Column) -> Column:
    return F.array_distinct(F.filter(tokens_, lambda x: x.rlike(V.BRAND_PATTERN) & ~x.isin(V.GENERIC_LATIN + V.SIZES)))


def models(tokens_: Column) -> Column:
    return F.array_distinct(F.filter(tokens_, lambda x: x.rlike(V.MODEL_PATTERN) & ~x.rlike(V.PAPER_PATTERN)))


def codes(tokens_: Column) -> Column:
    return F.array_distinct(F.filter(tokens_, lambda x: x.rlike(V.CODE_PATTERN)))


def numbers(tokens_: Column) -> Column:
    return F.array_distinct(F.filter(tokens_, is_number))


def with_analysis(df: DataFrame, text: Column, out: str) -> DataFrame:
    """`df` with the analysis of a text. In steps, so that Spark works out each array once and not wherever it is used."""
    df = df.withColumn("__n", normalize(text))
    df = df.withColumns({"__tokens": tokens(F.col("__n")), "__terms": terms(F.col("__n"))})
    df = df.withColumns({"__lemmas": lemmas(F.col("__terms")), "__quantities": quantities(F.col("__tokens"))})
    return df.withColumn(out, analysis(*[F.col(f"__{c}") for c in ("n", "tokens", "terms", "lemmas", "quantities")])).drop("__n", "__tokens", "__terms", "__lemmas", "__quantities")


def analysis(n: Column, token: Column, term: Column, lemma_: Column, quantity: Column) -> Column:
    """The analysis of a text as one struct; its arrays keep the order of first sight."""
    amounts = F.transform(quantity, lambda q: F.concat_ws(" ", q["value"], q["unit"]))
    unit = F.array_distinct(F.concat(F.filter(F.transform(token, unit_of), lambda x: x.isNotNull()), F.transform(quantity, lambda q: q["unit"])))
    package = F.filter(term, lambda x: x.isin(V.PACKAGES))
    color = F.filter(lemma_, lambda x: x.isin(V.COLORS))
    material = F.filter(lemma_, lambda x: x.isin(V.MATERIALS))
    sources = F.filter(term, lambda x: x.isin(V.COLORS + V.MATERIALS) | lemma(x).isin(V.COLORS + V.MATERIALS))
    brand, model, code, size, number = brands(token), models(token), codes(token), sizes(token), numbers(token)
    structured = F.concat(number, unit, size, package, color, material, brand, model, code, amounts)
    hints = F.array_except(F.array_except(term, structured), sources)
    attribute = F.array_distinct(F.concat(brand, model, code, size, package, color, material, unit, amounts))
    strict = F.array_distinct(F.concat(brand, model, code, size, package, number, unit, amounts))
    every = F.array_distinct(F.concat(term, lemma_, brand, model, code, number, unit, size, package, color, material, hints, attribute))
    phrases = F.array_distinct(F.filter(F.array(n, F.array_join(hints, " ")), lambda x: x != ""))
    named = {"normalized": n, "tokens": token, "terms": term, "lemmas": lemma_, "brands": brand, "models": model, "codes": code, "numbers": number, "units": unit, "sizes": size, "packages": package, "colors": color, "materials": material, "hints": hints, "attributes": attribute, "strict": strict, "all_terms": every, "phrases": phrases, "quantities": quantity}
    hard = reduce(lambda a, b: a | b, [F.size(x) > 0 for x in (brand, model, code, size, quantity)]) | (F.size(number) >= 2)
    return F.struct(*[v.alias(k) for k, v in named.items()], hard.alias("is_hard"))


def clean(column: Column) -> Column:
    """Without NULs, no-break spaces as blanks, blanks squashed. Null is empty."""
    plain = F.translate(F.coalesce(column, F.lit("")), "\u00a0\u0000", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def attribute_entries(raw: Column) -> Column:
    """Ordered (key, value) of a `key:value;key:value` string.

    A part without a colon is named by the number of entries before it, plus one; parts without a key or a value are left out. Of a key that
    is there already, an equal value is left out, another gets the key with a number, which counts the key's other values.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), clean), lambda x: x != "")
    empty = F.struct(F.array().cast("array<struct<key:string,value:string>>").alias("entries"), F.array().cast("array<string>").alias("again"))

    def add(acc: Column, x: Column) -> Column:
        entries, again = acc["entries"], acc["again"]
        colon = F.instr(x, ":")
        number = F.concat(F.lit("Атрибут "), (F.size(entries) + 1).cast("string"))
        key = F.when(colon > 0, F.trim(F.substring_index(x, ":", 1))).otherwise(number)
        value = F.when(colon > 0, F.trim(x.substr(colon + 1, F.length(x)))).otherwise(x)
        held = F.exists(entries, lambda y: y["key"] == key)
        equal = F.exists(entries, lambda y: (y["key"] == key) & (y["value"] == value))
        named = F.concat(key, F.lit(" ("), (F.size(F.filter(again, lambda k: k == key)) + 2).cast("string"), F.lit(")"))
        name = F.when(held, named).otherwise(key)
        put = lambda: F.when(  # noqa: E731  a name that is taken gets the new value in its old place
            F.exists(entries, lambda y: y["key"] == name), F.transform(entries, lambda y: F.struct(y["key"].alias("key"), F.when(y["key"] == name, value).otherwise(y["value"]).alias("value")))
        ).otherwise(F.concat(entries, F.array(F.struct(name.alias("key"), value.alias("value")))))
        changed = F.struct(put().alias("entries"), F.when(held, F.concat(again, F.array(key))).otherwise(again).alias("again"))
        return F.when((key == "") | (value == "") | equal, acc).otherwise(changed)

    return F.aggregate(parts, empty, add, lambda acc: acc["entries"])


# Plain tokenizers of the catalogue, and of the ranker's features.


def catalog_tokens(column: Column) -> Column:
    """Distinct runs of Latin and Cyrillic letters without ё, and digits, of two characters or more, in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-zа-я0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def name_tokens(column: Column) -> Column:
    """Distinct catalogue tokens of three characters or more that aren't legal forms or other empty words of names."""
    return F.filter(catalog_tokens(column), lambda t: (F.length(t) > 2) & ~t.isin(V.NAME_STOP_WORDS))


def spelling_tokens(column: Column) -> Column:
    """Runs of letters, ё included, and digits, of three characters or more, that aren't numbers, in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[0-9a-zа-яё]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~is_digits(t))


def plain(column: Column) -> Column:
    """Lower case without ё, blanks squashed. Null is empty."""
    return squash(F.translate(F.lower(F.coalesce(column.cast("string"), F.lit(""))), "ё", "е"))


def plain_terms(plain_text: Column) -> Column:
    return F.regexp_extract_all(plain_text, F.lit("[0-9a-zа-яё]+"), 0)
