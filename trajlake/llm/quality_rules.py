"""Quality rules by distribution divergence, with DataFrame functions only.

A text passes if the histogram of its character classes and that of common words lie within a Jensen-Shannon distance
of its language's reference. The common words are those of all languages with a reference, so that prose in another
language than the one it is tagged with is told as well as text without such words. Both tests have a minimum length, under which they say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"

# Shares of character classes in running prose.
# Order: caseless or lower letters, upper letters, decimal digits, white space, sentence marks, symbols, all else.
CLASS_REFERENCE = {
    "en": [0.775, 0.025, 0.005, 0.165, 0.028, 0.0005, 0.0015],
    "de": [0.765, 0.055, 0.005, 0.145, 0.028, 0.0005, 0.0015],
    "fr": [0.775, 0.022, 0.005, 0.165, 0.031, 0.0005, 0.0015],
    "es": [0.778, 0.022, 0.005, 0.165, 0.028, 0.0005, 0.0015],
}
# Shares of the ten commonest words among all words of running prose.
WORD_REFERENCE = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.020, "is": 0.011, "that": 0.011, "for": 0.010, "it": 0.009},
    "de": {"der": 0.030, "die": 0.030, "und": 0.028, "in": 0.016, "den": 0.012, "von": 0.011, "zu": 0.010, "das": 0.010, "mit": 0.009, "ist": 0.009},
    "fr": {"de": 0.048, "la": 0.030, "le": 0.025, "et": 0.022, "les": 0.020, "des": 0.018, "en": 0.014, "un": 0.012, "du": 0.012, "que": 0.010},
    "es": {"de": 0.055, "la": 0.035, "que": 0.028, "el": 0.028, "en": 0.026, "y": 0.025, "a": 0.020, "los": 0.016, "se": 0.012, "del": 0.012},
}
COMMON = sorted({w for row in WORD_REFERENCE.values() for w in row})  # a bin for each of all languages' words; the last bin is for all else
LONGEST = max(map(len, COMMON))
WORD_SHARES = {k: [*(row.get(w, 0.0) for w in COMMON), 1 - sum(row.values())] for k, row in WORD_REFERENCE.items()}
# Word distances over which a text is rejected. Below that of a text without any common word, above that of prose.
MAX_WORD_DISTANCE = {"en": 0.32, "de": 0.292, "fr": 0.275, "es": 0.318}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between a histogram of counts and a reference distribution.

    Null if the histogram is empty.
    """
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    shares = let(total, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))
    divergence = F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda s, x: s + x) / 2
    return let(divergence, lambda d: F.when(d.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), d))))


def _by_lang(lang: Column, table: dict[str, list[float]], other: list[float] | None) -> Column:
    """The row of the table for a language; any other language, or null, has the row `other`."""
    numbers = lambda row: F.array(*[F.lit(float(x)) for x in row])
    made = F.when(F.lit(False), F.lit(None).cast("array<double>"))
    for name, row in table.items():
        made = made.when(lang == name, numbers(row))
    return made.otherwise(numbers(other)) if other else made


def repeated_words(words: Column, n: int = 3) -> Column:
    """Number of words inside n-word windows that the text has twice or more, the first of them included.

    Windows are compared by 64-bit hash. Texts without a repeat stop at a count of distinct hashes; the others sort
    (hash, place) pairs, so that the cost stays n log n however repetitive a text is.
    """
    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, hashes).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        return let(let(pairs, places), length)

    return let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def quality(text: Column, lang: Column, min_words: int = 50, max_repeat_percent: int = 50, max_class_distance: float = 0.20, max_word_distance: dict[str, float] = MAX_WORD_DISTANCE,
            min_chars: int = 200, min_list_words: int = 50) -> Column:
    """struct of the measures and verdicts of a text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long): words are maximal runs of characters other than
    ASCII white space, taken from the whole text; a null text has none. class_distance, word_distance: null where there is
    nothing to compare, no characters or no word list for the language. base_failed: fewer than min_words words, or over
    max_repeat_percent per cent of them in repeated windows. kept: the base holds and no distance is over its limit. The
    class test is silent under min_chars characters and the word test under min_list_words words or without a
    list; a silent test keeps the document.

    All is one expression whose parts are bound by let: however the planner moves it, a part is computed once.
    """
    common = F.array(*map(F.lit, COMMON))
    shares = _by_lang(lang, WORD_SHARES, None)
    limit = _by_lang(lang, {k: [v] for k, v in max_word_distance.items()}, None)

    def counts(x: Column) -> Column:
        t, w, rest = x["t"], x["w"], x["rest"]
        lines = let(F.filter(F.split(t, "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]")), lambda v: F.size(v) - F.size(F.array_distinct(v)))
        short = F.filter(w, lambda v: F.char_length(v) <= LONGEST)  # lower case never has fewer characters, so no common word is passed by
        hits = F.filter(F.transform(short, lambda v: F.array_position(x["common"], F.lower(v)).cast("int")), lambda r: r > 0)
        places = F.array(*[F.lit(k) for k in range(1, len(COMMON) + 1)])
        bins = let(hits, lambda r: F.array_append(F.transform(places, lambda k: (F.size(r) - F.size(F.array_remove(r, k))).cast("double")), (F.size(w) - F.size(r)).cast("double")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(rest, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"), F.char_length(t).cast("long").alias("chars"), F.char_length(rest).cast("long").alias("left"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("upper"), F.regexp_count(rest, F.lit(r"\p{Nd}")).cast("long").alias("digits"),
            F.regexp_count(rest, F.lit(r"""[.,;:!?'"()¿¡«»…-]""")).cast("long").alias("marks"), bins.alias("bins"))

    def distances(c: Column) -> Column:
        space = c["chars"] - c["word_chars"]
        classes = [c["chars"] - c["left"] - c["upper"], c["upper"], c["digits"], space, c["marks"], c["n_symbols"], c["left"] - c["digits"] - space - c["marks"] - c["n_symbols"]]
        by_class = js_distance(F.array(*[F.greatest(v, F.lit(0)).cast("double") for v in classes]), _by_lang(lang, CLASS_REFERENCE, [sum(x) / len(CLASS_REFERENCE) for x in zip(*CLASS_REFERENCE.values())]))
        by_word = F.when(lang.isin(*WORD_REFERENCE), js_distance(c["bins"], shares))
        return F.struct(c.alias("c"), by_class.alias("class_distance"), by_word.alias("word_distance"))

    def verdict(d: Column) -> Column:
        c = d["c"]
        failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
        far = ((c["chars"] >= min_chars) & F.coalesce(d["class_distance"] > max_class_distance, F.lit(False))) | ((c["n_words"] >= min_list_words) & F.coalesce(d["word_distance"] > F.get(limit, F.lit(0)), F.lit(False)))
        return F.struct(*[c[k].alias(k) for k in MEASURES], d["class_distance"].alias("class_distance"), d["word_distance"].alias("word_distance"), failed.alias("base_failed"), (~failed & ~far).alias("kept"))

    whole = let(F.coalesce(text, F.lit("")), lambda t: F.struct(t.alias("t"), F.array_remove(F.split(t, SPACE + "+"), "").alias("w"), F.regexp_replace(t, r"\p{L}+", "").alias("rest"), common.alias("common")))
    return let(let(let(whole, counts), distances), verdict)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """docs with the fields of quality(); columns of docs with these names are replaced."""
    fields = [*MEASURES, "class_distance", "word_distance", "base_failed", "kept"]
    name = "_" + max([*docs.columns, "quality"], key=len)  # longer than any name of docs
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in fields]
    return docs.select(*kept, quality(F.col(text), F.col(lang), **limits).alias(name)).select(*kept, f"`{name}`.*")


def op5_quality_divergence(spark, sf_dir):
    """doc_id, the base measures, base_failed, kept and both distances (six places) of every document.

    A null or empty text has no words and fails; repeated rows and rows without an id are judged alike.
    """
    from trajlake.llm.common import table

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def oracle_sql(max_class_distance: float = 0.20, max_word_distance: dict[str, float] = MAX_WORD_DISTANCE, min_chars: int = 200, min_list_words: int = 50) -> str:
    """DuckDB SQL for op5_quality_divergence over the table documents."""
    numbers = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
    mean = [sum(x) / len(CLASS_REFERENCE) for x in zip(*CLASS_REFERENCE.values())]
    classes = "CASE lang " + " ".join(f"WHEN '{k}' THEN {numbers(v)}" for k, v in CLASS_REFERENCE.items()) + f" ELSE {numbers(mean)} END"
    shares = "CASE lang " + " ".join(f"WHEN '{k}' THEN {numbers(v)}" for k, v in WORD_SHARES.items()) + " END"
    limit = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in max_word_distance.items()) + " END"
    common, bins = "[" + ", ".join(f"'{w}'" for w in COMMON) + "]", ", ".join(map(str, [*range(1, len(COMMON) + 1), 0]))

    def distance(counts: str, reference: str) -> str:
        part = "CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform({counts}, lambda c: c / list_sum({counts})), {reference}), lambda z: {part})) / 2)) END"

    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS x FROM documents),
a AS (SELECT k, doc_id, lang, x, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w, regexp_replace(x, '\\p{{L}}+', '', 'g') AS r,
  list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT k, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
d AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY k),
m AS (SELECT a.k, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(r) - length(regexp_replace(r, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(x) AS chars, length(r) AS rest, length(x) - length(regexp_replace(x, '\\p{{Lu}}', '', 'g')) AS upper,
  length(r) - length(regexp_replace(r, '\\p{{Nd}}', '', 'g')) AS digits, length(r) - length(regexp_replace(r, '[.,;:!?''"()¿¡«»…-]', '', 'g')) AS marks, w FROM a LEFT JOIN c USING (k)),
h AS (SELECT *, [chars - rest - upper, upper, digits, chars - word_chars, marks, n_symbols, rest - digits - (chars - word_chars) - marks - n_symbols]::DOUBLE[] AS ch, {common} AS cw FROM m),
i AS (SELECT * EXCLUDE (ch), list_transform(ch, lambda v: greatest(v, 0)) AS ch, list_transform(w, lambda v: coalesce(list_position(cw, lower(v)), 0)) AS ranks FROM h),
j AS (SELECT *, list_transform([{bins}], lambda q: len(list_filter(ranks, lambda v: v = q)))::DOUBLE[] AS wh, {classes} AS cr, {shares} AS sr FROM i),
e AS (SELECT *, {distance('ch', 'cr')} AS class_distance, CASE WHEN sr IS NOT NULL THEN {distance('wh', 'sr')} END AS word_distance, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(chars >= {min_chars} AND class_distance > {max_class_distance}, false) AND NOT coalesce(n_words >= {min_list_words} AND word_distance > {limit}, false) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM e
"""
