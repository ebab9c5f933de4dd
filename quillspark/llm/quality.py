"""Quality rules: distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of common words are compared with references of
languages by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A document of
at least MIN_WORDS words is rejected if no reference is near in both. A document with fewer words has
histograms too noisy to judge and passes; so does one whose lang is set to a language without a
reference. Where lang is null and no reference's words are near, the language may be another one: then
the character classes alone decide, and where a fifth of all characters that are no blanks are letters outside
ASCII, the text is in another script or in a language that none of the references is like, so it passes. Case is
folded, so that text in capitals is judged like any other. A base rule rejects documents of few words or of repeated ones.

The limits: a histogram of n draws is about sqrt(bins / (8 n ln 2)) away from the one that it is drawn
from, which for MIN_WORDS words and 15 bins is 0.16, and for their 600 characters and 7 bins 0.05.
References differ from a text's own language model by about as much as two kinds of text do, 0.15. So
ordinary text stays under the sums, 0.31 and 0.2 (0.21 with rounding up), while text without a
language's common words is at 0.35 and more.

Defined cases: null text counts as empty: no words, base_failed. Null lang: as above. Ties of the nearest
reference go to the first in the order of CHARACTERS. Repeated rows are judged each, null doc_id stays.
Very long texts are counted whole. An empty table gives an empty result. Extra columns are ignored
(rules) or kept whatever their names (filter_documents).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 100
MOST_CHAR, MOST_WORD = 0.21, 0.31
LEAST_BASE_WORDS = 50

SPACE = r"[\x20\x09-\x0D]+"
CLASSES = ("vowel", "consonant", "non_ascii", "digit", "space", "symbol", "other")

# Shares of character classes (in the order of CLASSES) in ordinary text, in percent.
CHARACTERS = {
    "en": (31.3, 47.7, 0.1, 0.7, 17.0, 0.1, 3.1),
    "de": (30.5, 48.5, 2.0, 0.6, 15.0, 0.1, 3.3),
    "fr": (36.4, 39.6, 4.0, 0.6, 16.0, 0.1, 3.3),
    "es": (37.9, 39.6, 3.0, 0.5, 16.0, 0.1, 2.9),
    "it": (39.4, 41.1, 0.8, 0.6, 15.0, 0.1, 3.0),
    "pt": (37.9, 39.1, 3.4, 0.6, 16.0, 0.1, 2.9),
    "nl": (32.9, 48.1, 0.1, 0.6, 15.2, 0.1, 3.0),
    "sv": (28.9, 48.1, 4.3, 0.6, 15.0, 0.1, 3.0),
}
# Shares of the commonest words of each language, in percent of all words.
WORDS = {
    "en": {"the": 6.0, "of": 3.3, "and": 2.7, "to": 2.5, "a": 2.1, "in": 1.9, "is": 1.0, "that": 1.0, "for": 0.9, "it": 0.9, "was": 0.8, "with": 0.7, "on": 0.7, "as": 0.6},
    "de": {"der": 4.5, "die": 4.0, "und": 2.8, "in": 2.0, "den": 1.5, "von": 1.2, "das": 1.1, "zu": 1.1, "mit": 0.9, "sich": 0.8, "auf": 0.8, "des": 0.8, "ist": 0.8, "nicht": 0.7},
    "fr": {"de": 5.5, "la": 3.3, "le": 2.6, "et": 2.2, "les": 2.0, "des": 1.6, "en": 1.4, "un": 1.1, "du": 1.1, "une": 0.9, "que": 0.9, "est": 0.9, "pour": 0.8, "qui": 0.7},
    "es": {"de": 6.0, "la": 3.6, "que": 2.8, "el": 2.6, "en": 2.4, "y": 2.2, "los": 1.5, "las": 1.0, "se": 1.0, "del": 1.0, "con": 0.9, "un": 0.9, "por": 0.8, "no": 0.8},
    "it": {"di": 3.4, "e": 2.6, "la": 1.9, "il": 1.8, "che": 1.8, "in": 1.6, "a": 1.5, "un": 1.3, "del": 1.1, "per": 1.1, "una": 1.0, "è": 1.0, "con": 0.9, "non": 0.9},
    "pt": {"de": 5.0, "a": 3.2, "o": 3.0, "que": 2.6, "e": 2.6, "do": 1.9, "da": 1.8, "em": 1.3, "um": 1.2, "para": 1.1, "com": 1.0, "os": 0.9, "uma": 0.9, "no": 0.9},
    "nl": {"de": 5.2, "van": 2.8, "het": 2.6, "een": 2.5, "en": 2.2, "in": 2.0, "is": 1.2, "dat": 1.1, "op": 1.0, "te": 1.0, "met": 0.8, "voor": 0.8, "die": 0.8, "niet": 0.7},
    "sv": {"och": 3.1, "i": 2.8, "att": 2.4, "en": 1.8, "som": 1.7, "är": 1.5, "av": 1.4, "för": 1.3, "på": 1.3, "det": 1.3, "med": 1.2, "den": 1.0, "till": 1.0, "har": 0.8},
}
COMMON = sorted({w for words in WORDS.values() for w in words})
_CODE = {w: chr(ord("0") + k) for k, w in enumerate(COMMON)}  # one ASCII character for each common word


def references() -> dict[str, tuple[list[float], dict[str, float]]]:
    """For each language: shares of the character classes, and of its common words (the rest is other words)."""
    return {lang: ([x / sum(c) for x in c], {w: p / 100 for w, p in WORDS[lang].items()}) for lang, c in CHARACTERS.items()}


def jensen_shannon(shares: Column, reference: list[float]) -> Column:
    """Distance of an array of shares from a reference; one lambda, so that many references stay small in code."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*[F.lit(float(q)) for q in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def _left(text: Column, not_these: str) -> Column:
    return F.length(F.regexp_replace(text, not_these, ""))


def judged(docs: DataFrame) -> DataFrame:
    """docs with the columns of rules, each prefixed by _q_. The chain of withColumns keeps each array in a
    column of its own, since a lambda evaluates what it refers to once for each element."""
    c = lambda name: F.col(f"_q_{name}")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    df = docs.withColumn("_q_text", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("_q_w", F.array_remove(F.split(c("text"), SPACE), ""))
    df = df.withColumn("_q_n_words", F.size(c("w")).cast("long")).withColumn("_q_word_chars", F.length(F.array_join(c("w"), "")).cast("long"))
    df = df.withColumn("_q_n_symbols", _left(c("text"), r"[^#*$%&|<>]+").cast("long"))
    df = df.withColumn("_q_lines", F.filter(F.split(c("text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_q_n_dup_lines", (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"))

    # Hashes of the 3-word windows; documents that repeat one have them sorted with their places.
    windows = F.slice(F.transform(c("w"), lambda w, i: F.xxhash64(w, F.get(c("w"), i + 1), F.get(c("w"), i + 2))), F.lit(1), F.greatest(c("n_words").cast("int") - 2, F.lit(0)))
    df = df.withColumn("_q_h", windows)
    placed = F.sort_array(F.transform(c("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_s", F.when(F.size(F.array_distinct(c("h"))) < F.size(c("h")), placed))
    twice = F.transform(c("s"), lambda x, i: F.when((x["h"] == F.get(c("s"), i - 1)["h"]) | (x["h"] == F.get(c("s"), i + 1)["h"]), x["i"]))
    df = df.withColumn("_q_p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform(c("p"), lambda v, i: F.least(F.lit(3), F.coalesce(F.get(c("p"), i + 1) - v, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumn("_q_base_failed", (c("n_words") < LEAST_BASE_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words")))

    # Character classes and common words.
    # Two passes over the text, in long runs; the other classes are counted in the short remainders.
    df = df.withColumn("_q_letters", F.regexp_replace(c("text"), "[^A-Za-z]+", "")).withColumn("_q_rest", F.regexp_replace(c("text"), "[A-Za-z]+", ""))
    df = df.withColumn("_q_vowel", _left(c("letters"), "[^AEIOUYaeiouy]+")).withColumn("_q_consonant", F.length(c("letters")) - c("vowel"))
    df = df.withColumn("_q_beyond", F.regexp_replace(c("rest"), r"[\x00-\x7F]+", "")).withColumn("_q_non_ascii", F.length(c("beyond")))
    df = df.withColumn("_q_digit", _left(c("rest"), "[^0-9]+")).withColumn("_q_other_letters", _left(c("beyond"), r"[^\p{L}\p{M}]+"))
    df = df.withColumn("_q_chars", F.length(c("text"))).withColumn("_q_space", c("chars") - c("word_chars")).withColumn("_q_symbol", c("n_symbols"))
    df = df.withColumn("_q_other", c("chars") - reduce(lambda a, b: a + b, [c(k) for k in CLASSES[:-1]]))
    codes = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    df = df.withColumn("_q_low", F.split(F.lower(F.array_join(c("w"), " ")), " "))
    df = df.withColumn("_q_found", F.filter(c("low"), lambda w: w.isin(COMMON)))
    df = df.withColumn("_q_codes", F.array_join(F.transform(c("found"), lambda w: F.element_at(codes, w)), ""))
    df = df.withColumn("_q_common", F.array(*[F.length("_q_codes") - F.length(F.replace(c("codes"), F.lit(_CODE[w]), F.lit(""))) for w in COMMON]))
    df = df.withColumn("_q_p_chars", F.array(*[c(k) / F.greatest(c("chars"), F.lit(1)) for k in CLASSES]))
    df = df.withColumn("_q_p_words", F.transform(c("common"), lambda n: n / F.greatest(c("n_words"), F.lit(1))))
    for name, (chars, words) in references().items():
        mine = F.array(*[F.get(c("p_words"), F.lit(COMMON.index(w))) for w in words])
        df = df.withColumn(f"_q_mine_{name}", mine)
        rest = F.greatest(F.lit(1.0) - F.aggregate(c(f"mine_{name}"), F.lit(0.0), lambda x, y: x + y), F.lit(0.0))
        df = df.withColumn(f"_q_char_{name}", jensen_shannon(c("p_chars"), chars))
        df = df.withColumn(f"_q_word_{name}", jensen_shannon(F.array_append(c(f"mine_{name}"), rest), [*words.values(), 1 - sum(words.values())]))
    names = list(CHARACTERS)
    # The nearest reference: how far either distance is from its limit, at most.
    chars_off, words_off = [c(f"char_{k}") / MOST_CHAR for k in names], [c(f"word_{k}") / MOST_WORD for k in names]
    worst = [F.greatest(a, b) for a, b in zip(chars_off, words_off)]
    df = df.withColumn("_q_excess", F.least(*worst))
    nearest = reduce(lambda rest, kw: F.when(kw[1] == c("excess"), F.lit(kw[0])).otherwise(rest), list(zip(names, worst))[::-1], F.lit(names[0]))
    df = df.withColumn("_q_nearest", nearest)
    foreign = lang.isNull() & (F.least(*words_off) > 1) & ((F.least(*chars_off) <= 1) | (5 * c("other_letters") >= c("word_chars")))
    passed = (c("n_words") < MIN_WORDS) | (c("excess") <= 1) | F.coalesce(~lang.isin(names), F.lit(False)) | foreign
    # The row number keeps filters above the chain of columns: pushed below, they would repeat each
    # column's expression wherever the next one refers to it.
    return df.withColumn("_q_kept", ~c("base_failed") & passed).withColumn("_q_row", F.monotonically_increasing_id())


RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "excess")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules say of every row of docs; excess over 1: too far from every reference."""
    df = judged(docs.select("doc_id", "text", *[x for x in ("lang",) if x in docs.columns]))
    column = lambda k: F.round("_q_excess", 6) if k == "excess" else F.col(f"_q_{k}")
    out = [F.when(F.col("_q_row") >= 0, column(k)).alias(k) for k in RULE_COLUMNS]
    return df.select("doc_id", *out)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_in")  # so that no name can clash
    read = docs.select(row, "text", *[x for x in ("lang",) if x in docs.columns])
    return judged(read).where("_q_kept AND _q_row >= 0").select("_q_in.*")


def rules_sql() -> str:
    """The same as DuckDB SQL."""
    left = lambda rx: f"length(regexp_replace(t, '{rx}', '', 'g'))"
    count = lambda w: f"len(list_filter(w, lambda x: lower(x) = '{w}'))"

    def distance(shares: list[str], reference: list[float]) -> str:
        terms = []
        for p, q in zip(shares, reference):
            terms.append(f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}::DOUBLE) / 2)) ELSE 0 END + {q!r}::DOUBLE * log2({q!r}::DOUBLE / (({p} + {q!r}::DOUBLE) / 2))")
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"

    worst, rests = [], []
    for name, (chars, words) in references().items():
        of_words = distance([f"c{COMMON.index(w)}" for w in words] + [f"rest_{name}"], [*words.values(), 1 - sum(words.values())])
        rests.append(f"greatest(1.0 - ({' + '.join(f'c{COMMON.index(w)}' for w in words)}), 0.0) AS rest_{name}")
        worst += [f"{distance([f'p_{k}' for k in CLASSES], chars)} / {MOST_CHAR} AS char_{name}", f"{of_words} / {MOST_WORD} AS word_{name}"]
    names = list(CHARACTERS)
    least = lambda kind: "least(" + ", ".join(f"{kind}_{k}" for k in names) + ")"
    known = ", ".join(f"'{k}'" for k in names)
    nearest = "CASE " + " ".join(f"WHEN worst_{k} = excess THEN '{k}'" for k in names) + f" ELSE '{names[0]}' END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) r(k) GROUP BY rid),
base AS (SELECT w.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {left('[^#*$%&|<>]')} AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  {left('[^AEIOUYaeiouy]')} AS vowel, {left('[^B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]')} AS consonant, {left('[[:ascii:]]|[^\\p{L}\\p{M}]')} AS other_letters, {left('[[:ascii:]]')} AS non_ascii, {left('[^0-9]')} AS digit
  FROM w LEFT JOIN covered c ON c.rid = w.rid),
more AS (SELECT *, length(t) - word_chars AS space, n_symbols AS symbol FROM base),
most AS (SELECT *, length(t) - vowel - consonant - non_ascii - digit - space - symbol AS other,
  n_words < {LEAST_BASE_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM more),
p AS (SELECT *, {', '.join(f'{k} / greatest(length(t), 1)::DOUBLE AS p_{k}' for k in CLASSES)},
  {', '.join(f'{count(w)} / greatest(n_words, 1)::DOUBLE AS c{k}' for k, w in enumerate(COMMON))} FROM most),
r AS (SELECT *, {', '.join(rests)} FROM p),
d AS (SELECT *, {', '.join(worst)} FROM r),
g2 AS (SELECT *, {', '.join(f'greatest(char_{k}, word_{k}) AS worst_{k}' for k in names)} FROM d),
e AS (SELECT *, {least('worst')} AS excess FROM g2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_WORDS} OR excess <= 1 OR coalesce(lang NOT IN ({known}), false) OR lang IS NULL AND {least('word')} > 1 AND ({least('char')} <= 1 OR 5 * other_letters >= word_chars)) AS kept,
  {nearest} AS nearest, round(excess, 6) AS excess
FROM e"""
