"""Quality rules, line first: lines that break a rule are removed, then documents that lose too much go.

Line rules (a line has at least one word; others are left alone):
symbols      more than one of ``#*$%&|<>`` for ten words
navigation   three or more of ``| > » › • ·``, or nothing but a menu word
boilerplate  a stock phrase (cookies, rights reserved, scripts, subscriptions)
punctuation  fewer than four words and none of ``.!?…:;,"')»”`` at the end

A document is rejected if its failed lines hold more than ``max_lost`` of its word characters,
or if it fails the base rules (fewer than 50 words, or over half of its words in three-word
windows that occur twice or more).

Defined results: null text has no words, so it fails the base rules; so do empty texts.
Repeated rows and null ids each keep their row. All measures use the whole text. Columns
other than the id and the text are ignored by ``measure`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, table, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40

SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"
NAVIGATION_MARKS = "[|>»›•·]"
MENU = r"(?i)^[^a-z]*(home|menu|search|login|log in|sign in|sign up|next|previous|back to top|share|contact us|about us)[^a-z]*$"
#: Stock phrases, in lower case.
PHRASES = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "subscribe to our", "click here", "read more", "sign up for", "follow us on", "lorem ipsum",
)
BOILERPLATE = f"(?i)({'|'.join(PHRASES)})"
HAS_WORD = r"[^\x20\x09-\x0D]"
FOUR_WORDS = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){3}[^\x20\x09-\x0D]"
#: Bits of a window's place where hash and place share a number.
PLACE_BITS = 24
CLOSED = r"[.!?…:;,\x22')»”][\x20\x09-\x0D]*$"


def line_fails(line: Column, marks: Column, phrases: Column) -> Column:
    """True for a line that a rule removes.

    ``marks``, ``phrases``: whether the whole text holds any sign of the symbol or navigation rules, any
    stock phrase; where it does not, no line can, and the dear patterns are not tried. Of the words only
    the first four are looked for where their number does not matter.
    """
    words = F.regexp_count(line, F.lit(WORD))
    signs = (10 * F.regexp_count(line, F.lit(SYMBOLS)) > words) | (F.regexp_count(line, F.lit(NAVIGATION_MARKS)) >= 3)
    few = ~line.rlike(FOUR_WORDS) & ~line.rlike(CLOSED)
    return line.rlike(HAS_WORD) & ((marks & signs) | (phrases & line.rlike(BOILERPLATE)) | few | line.rlike(MENU))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(3)]


def _covered(starts: Column) -> Column:
    """Words in the three-word windows that begin at ``starts`` (ascending), each word once."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _by_words(words: Column) -> Column:
    """Ascending starts of windows that occur twice, by sorting the windows' words themselves."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("t"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["t"] == x["t"]) | (F.get(s, i + 1)["t"] == x["t"]))
    return let(F.sort_array(windows), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))


def _by_hash(words: Column, hashes: Column) -> Column:
    """Ascending starts of windows that occur twice: one sort of numbers that hold a hash and a place.

    Neighbours of one hash are held against their words; if any two differ, hashes have met by chance,
    and the windows are sorted by their words instead.
    """
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))))
    place = lambda p: p.bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("int")
    same = lambda p, q: F.shiftright(p, PLACE_BITS) == F.shiftright(q, PLACE_BITS)

    def of(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))

        def confirmed(t: Column) -> Column:
            text = lambda p: F.concat_ws(" ", *_window(words, place(p)))
            chance = F.exists(F.sequence(F.lit(1), F.size(t) - 1), lambda i: same(F.get(t, i - 1), F.get(t, i)) & (text(F.get(t, i - 1)) != text(F.get(t, i))))
            return F.when(F.size(t) == 0, F.array().cast("array<int>")).when(chance, _by_words(words)).otherwise(F.sort_array(F.transform(t, place)))

        return let(twice, confirmed)

    return let(packed, of)


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more; ``words`` is a bound array.

    Windows whose hashes all differ need nothing more. Others are sorted, so that equal ones are
    neighbours: n log n, whole text. Texts of over 2^24 words are sorted by their words.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*_window(words, i)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(_by_hash(words, h))))
    return F.when(n < 4, 0).when(n < 2**PLACE_BITS, some).otherwise(_covered(_by_words(words)))


def _judged(text: Column, cleaned: bool) -> Column:
    """Struct of all measures of ``text``; with ``cleaned`` also the text without its failed lines."""
    plain = F.coalesce(text, F.lit(""))
    lowered = F.lower(plain)
    phrases = F.lit(False)
    for p in PHRASES:
        phrases = phrases | F.contains(lowered, F.lit(p))
    once = F.struct(F.regexp_count(plain, F.lit(SYMBOLS)).alias("n_symbols"), plain.rlike(NAVIGATION_MARKS).alias("navigation"), phrases.alias("phrases"))
    bare = lambda lines: F.length(F.regexp_replace(F.array_join(lines, ""), SPACE_CLASS + "+", ""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column, seen: Column) -> Column:
        fails = lambda x: line_fails(x, (seen["n_symbols"] > 0) | seen["navigation"], seen["phrases"])
        of = lambda judged, failed: F.transform(F.filter(judged, lambda j: j["fails"] == failed), lambda j: j["x"])

        def lost(judged: Column) -> Column:
            none = ~F.exists(judged, lambda j: j["fails"])
            worded = F.filter(lines, lambda x: x.rlike(HAS_WORD))
            left = [F.when(none, text).otherwise(F.array_join(of(judged, False), "\n")).alias("text")]
            return F.struct(
                let(worded, lambda s: F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines"),
                F.when(none, 0).otherwise(bare(of(judged, True))).alias("lost_chars"),
                *(left if cleaned else []),
            )

        return let(F.transform(lines, lambda x: F.struct(x.alias("x"), fails(x).alias("fails"))), lost)

    split = let(once, lambda seen: F.struct(seen["n_symbols"].alias("n_symbols"), let(F.split(plain, "\n", -1), lambda lines: of_lines(lines, seen)).alias("l")))
    return let(F.struct(let(words_of(text), of_words).alias("w"), split.alias("s")), _verdicts)


def _verdicts(m: Column) -> Column:
    n, chars, repeats, lost = m["w"]["n_words"], m["w"]["word_chars"], m["w"]["n_repeat_words"], m["s"]["l"]["lost_chars"]
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    return F.struct(m.alias("m"), failed.alias("base_failed"), (100 * lost.cast("long")).alias("lost_100"), chars.alias("chars"))


def _kept(j: Column, max_lost: int) -> Column:
    return ~j["base_failed"] & (j["lost_100"] <= max_lost * j["chars"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per document: measures, base_failed, kept and lost_chars."""
    j = F.col("__j")
    m = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(_judged(F.col(text_col), False))).alias("__j"))
    names = ("m.w.n_words", "m.w.word_chars", "m.s.n_symbols", "m.s.l.n_dup_lines", "m.w.n_repeat_words")
    return m.select(
        "doc_id", *(F.col(f"__j.{c}").cast("long").alias(c.split(".")[-1]) for c in names),
        j["base_failed"].alias("base_failed"), _kept(j, max_lost).alias("kept"), F.col("__j.m.s.l.lost_chars").cast("long").alias("lost_chars"),
    )


def clean(docs: DataFrame, text_col: str = "text", max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """Kept documents with their failed lines removed; every other column is passed through.

    A generator gives a row or none for each document, so that no rule is evaluated twice: a filter
    would be pushed below the measures and repeat them. The base rules judge the text as it came.
    """
    row = F.filter(F.array(_judged(F.col(text_col), True)), lambda j: _kept(j, max_lost))
    return docs.select("*", F.explode(row).alias("__j")).withColumn(text_col, F.col("__j.m.s.l.text")).drop("__j")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rn, doc_id, text, regexp_extract_all(text, {_sql(WORD)}) AS ws FROM d),
win AS (
  SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, t) AS n FROM win) WHERE n > 1),
cover AS (SELECT rn, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY rn),
ln AS (SELECT rn, unnest(string_split(text, chr(10))) AS x FROM d),
lw AS (SELECT rn, x, len(regexp_extract_all(x, {_sql(WORD)})) AS k FROM ln WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
lf AS (
  SELECT rn, x,
    10 * len(regexp_extract_all(x, {_sql(SYMBOLS)})) > k
    OR len(regexp_extract_all(x, {_sql(NAVIGATION_MARKS)})) >= 3
    OR regexp_matches(x, {_sql(MENU)}) OR regexp_matches(x, {_sql(BOILERPLATE)})
    OR (k < 4 AND NOT regexp_matches(x, {_sql(CLOSED)})) AS bad
  FROM lw),
lines AS (
  SELECT rn, count(*) - count(DISTINCT x) AS dup,
    coalesce(sum(CASE WHEN bad THEN length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) END), 0) AS lost
  FROM lf GROUP BY rn),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, {_sql(SYMBOLS)}))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN lines USING (rn) LEFT JOIN cover USING (rn))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
  AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM m
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": ORACLE}
