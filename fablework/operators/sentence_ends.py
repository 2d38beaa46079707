"""Sentence ends by what the corpus shows of its words, without a list of abbreviations (after Kiss and Strunk, 2006).

A full stop before white space may end a sentence or an abbreviation. Two aggregations over all words tell which:

1. By word: how often it stands with and without a full stop, and how it is written inside sentences. A word that is
   nearly always stopped, short, or stopped within is an **abbreviation**: a log-likelihood ratio, scaled by the word's length.
2. By pair around a stop: words that follow the stops of other words more often than chance are **starters**; an
   abbreviation, number or initial with a word that follows it more often than chance is a **collocation**.

What is learned is four tables, of which only words and pairs beyond the thresholds are kept. A stop then ends no sentence

* between the words of a collocation;
* after an abbreviation, unless a word written large follows that is a starter or otherwise only written small;
* after an initial, unless a word written large follows that is also written small; after a number before a small letter.

``!`` and ``?`` always end one. Words are cut at white space; the marks around them do not count. Null and empty texts have no
sentence; a blank one is left out, as by ``segments.sentence_rows``. The white space inside a sentence stays as it was.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Least scores of an abbreviation, a collocation and a starter, as published.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "##"


class Ends(NamedTuple):
    """Written tables: abbreviations(word), starters(word), collocations(word, next), small(word, inside): how words are written."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    small: DataFrame


def _bare(token: Column) -> Column:
    """The token without the marks around it; a full stop at its end stays."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$|(?<=[^\p{L}\p{N}.])\.+$", "")


def word(token: Column) -> Column:
    """What is counted: small letters, no stop at the end, one word for all numbers; empty if no letter or digit is left."""
    bare = F.regexp_replace(F.lower(_bare(token)), r"\.+$", "")
    return F.when(bare.rlike(r"^[\p{N}.,]*\p{N}$"), NUMBER).otherwise(bare)


def stopped(token: Column) -> Column:
    return _bare(token).endswith(".")


def _log_likelihood(n_first: Column, n_second: Column, n_both: Column, n: Column) -> Column:
    """Dunning's ratio: whether the second is likelier after the first than elsewhere."""
    # 0 ln 0 is 0
    term = lambda k, m, p: F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.ln(1 - p)).otherwise(0.0)
    rest, others = F.greatest(n_second - n_both, F.lit(0)), F.greatest(n - n_first, F.lit(1))
    p, p1, p2 = n_second / n, n_both / n_first, F.least(rest / others, F.lit(1.0))
    return -2 * (term(n_both, n_first, p) + term(rest, others, p) - term(n_both, n_first, p1) - term(rest, others, p2))


def abbreviation_score(word: Column, stops: Column, plain: Column, share: Column) -> Column:
    """Of a word seen ``stops`` times with a stop and ``plain`` times without, where ``share`` of all words have one."""
    inner = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = F.length(word) - inner
    chance = stops * F.ln(share) + F.when(plain > 0, plain * F.ln(1 - share)).otherwise(0.0)
    found = 2 * (stops * F.ln(F.lit(0.99)) + plain * F.ln(F.lit(0.01)) - chance)
    return found * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -plain)


def _pairs(segments: DataFrame, column: str) -> DataFrame:
    """(token, before, after): each token with its neighbours in its segment, empty at the ends."""
    tokens = F.filter(F.split(column, r"\s+"), lambda t: t != "")
    each = segments.where(F.col(column).rlike(r"\S")).select(tokens.alias("t"))  # texts are not split once more for this
    shifted = F.concat(F.array(F.lit("")), F.slice("t", 1, F.size("t") - 1))
    following = F.concat(F.slice("t", 2, F.size("t")), F.array(F.lit("")))
    return each.select(F.explode(F.arrays_zip(F.col("t").alias("token"), shifted.alias("before"), following.alias("after"))).alias("x")).select("x.*")


def _words(pairs: DataFrame) -> DataFrame:
    """(word, n, stops, small, inside): how often each word is there, with a stop, not written large, and large inside a sentence.

    ``inside`` is false for the first word of a segment or after a mark that may end a sentence. Equal tokens are counted
    before anything is made of them, so patterns run once for each different token.
    """
    marked = F.col("before").rlike(r"[.!?:]")  # most have none: one pass over few letters
    inside = (F.col("before") != "") & ~F.when(marked, F.col("before").rlike(r"[.!?:]\P{L}*$")).otherwise(False)
    told = pairs.groupBy("token").agg(F.count("*").alias("n"), F.sum(inside.cast("long")).alias("inside"))
    large = _bare(F.col("token")).rlike(r"^\p{Lu}")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    # with the number in it, the condition stays behind the counting
    rows = told.select(F.when(F.col("n") > 0, word(F.col("token"))).alias("word"), stopped(F.col("token")).alias("stop"), large.alias("large"), "n", "inside").where("word <> ''")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), of(F.col("stop")).alias("stops"), of(~F.col("large")).alias("small"),
                                    F.sum(F.when(F.col("large"), F.col("inside")).otherwise(0)).alias("inside"))


def _around(pairs: DataFrame) -> DataFrame:
    """(word, next, both): how often a stopped word is followed by another; only tokens with a stop are read, equal ones once."""
    told = pairs.where(F.contains("token", F.lit(".")) & (F.col("after") != "")).groupBy("token", "after").agg(F.count("*").alias("n"))
    counted = lambda c: F.when(F.col("n") > 0, c)  # noqa: E731  as above
    rows = told.where(counted(stopped(F.col("token")))).select(counted(word(F.col("token"))).alias("word"), counted(word(F.col("after"))).alias("next"), "n")
    return rows.where("word <> '' AND next <> ''").groupBy("word", "next").agg(F.sum("n").alias("both"))


def learn(segments: DataFrame, column: str = "text") -> Ends:
    """The tables of all texts in ``column``. Only words and pairs are shuffled, counted before; two numbers come to the driver."""
    words = cut(_words(_pairs(segments, column)))
    all_, stops = words.agg(F.sum("n"), F.sum("stops")).first()
    all_, stops = all_ or 0, stops or 0
    share, n = F.lit(stops / max(all_, 1)), F.lit(float(all_))
    score = abbreviation_score(F.col("word"), F.col("stops"), F.col("n") - F.col("stops"), share)
    lettered = F.col("word").rlike(r"\p{L}") & (F.length("word") > 1)
    abbreviations = cut(words.where((F.col("stops") > 0) & (F.lit(stops) < F.lit(all_)) & lettered).where(score >= ABBREVIATION).select("word"))

    around = cut(_around(_pairs(segments, column)).join(abbreviations.withColumn("short", F.lit(True)), "word", "left").na.fill(False, ["short"]))
    unsure = F.col("short") | (F.length("word") == 1) | (F.col("word") == NUMBER)
    total = words.select(F.col("word").alias("next"), F.col("n").alias("n_next"))
    broken = around.where(~unsure).agg(F.sum("both")).first()[0] or 0
    after = around.where(~unsure).groupBy("next").agg(F.sum("both").alias("both")).join(total, "next")
    likely = (F.col("both") * n > F.col("n_next") * F.lit(broken))
    starters = after.where(likely & (_log_likelihood(F.lit(broken), F.col("n_next"), F.col("both"), n) >= STARTER))
    starters = cut(starters.where(F.col("next") != NUMBER).select(F.col("next").alias("word")))
    met = around.where(unsure & (F.col("both") > 1)).join(words.select("word", F.col("n").alias("n_word")), "word").join(total, "next")
    likely = F.col("both") * n > F.col("n_next") * F.col("n_word")
    met = met.where(likely & (_log_likelihood(F.col("n_word"), F.col("n_next"), F.col("both"), n) >= COLLOCATION))
    collocations = met.join(starters.withColumnRenamed("word", "next"), "next", "left_anti").select("word", "next")
    return Ends(abbreviations, starters, cut(collocations), cut(words.where("small > 0").select("word", "inside")))


def sentence_rows(segments: DataFrame, keys: list[str], ends: Ends, column: str = "text") -> DataFrame:
    """(keys, sentence, text): the sentences of each segment, numbered from 0. Rows with equal keys stay apart."""
    pieces, gaps = F.split(column, r"(?<=[.!?])\s+", -1), F.regexp_extract_all(column, F.lit(r"(?<=[.!?])(\s+)"), 1)
    # pieces are numbered by rows that are written, so that a task that is run again gives the same numbers
    rows = cut(segments.select(*keys, pieces.alias("p"), F.concat(gaps, F.array(F.lit(""))).alias("g")).where("p IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()))
    rows = rows.select(*keys, "__row", F.size("p").alias("__of"), F.posexplode(F.arrays_zip("p", "g", F.concat(F.slice("p", 2, F.size("p")), F.array(F.lit(""))).alias("then"))).alias("__pos", "x"))
    last, then = F.regexp_extract("x.p", r"(?<!\S)(\S++)\s*+$", 1), F.regexp_extract("x.then", r"^\s*(\S+)", 1)
    rows = rows.select(*keys, "__row", "__pos", F.col("x.p").alias("__p"), F.col("x.g").alias("__g"), word(last).alias("__w"), word(then).alias("__n"),
                       last.rlike(r"\.$").alias("__stop"), _bare(then).rlike(r"^\p{Lu}").alias("__large"), _bare(then).rlike(r"^\p{Ll}").alias("__low"))
    flag = lambda d, on, name: d.select(*(F.col(a).alias(b) for a, b in on.items()), F.lit(True).alias(name))
    rows = rows.join(flag(ends.abbreviations, {"word": "__w"}, "__short"), "__w", "left")
    rows = rows.join(flag(ends.collocations, {"word": "__w", "next": "__n"}, "__tied"), ["__w", "__n"], "left")
    rows = rows.join(flag(ends.starters, {"word": "__n"}, "__starter"), "__n", "left")
    rows = rows.join(ends.small.select(F.col("word").alias("__n"), F.col("inside").alias("__inside")), "__n", "left")
    fresh = F.col("__large") & (F.col("__starter").isNotNull() | (F.coalesce("__inside", F.lit(1)) == 0))
    goes_on = (F.when(F.col("__tied"), True).when(F.col("__short"), ~fresh)
               .when(F.col("__w").rlike(r"^\p{L}$"), F.col("__low") | F.col("__inside").isNull())
               .when(F.col("__w") == NUMBER, F.col("__low")).otherwise(False))
    rows = rows.withColumn("__ends", ~(F.col("__stop") & (F.col("__n") != "") & goes_on))
    before = Window.partitionBy("__row").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sentence", F.coalesce(F.sum(F.col("__ends").cast("int")).over(before), F.lit(0)))
    unit = F.struct("__pos", "__p", F.when(F.col("__ends"), "").otherwise(F.col("__g")).alias("__g"))
    made = rows.groupBy(*keys, "__row", "sentence").agg(F.sort_array(F.collect_list(unit)).alias("__s"))
    text = F.array_join(F.transform("__s", lambda x: F.concat(x["__p"], x["__g"])), "")
    return made.select(*keys, F.col("sentence").cast("int").alias("sentence"), text.alias("text")).where("trim(text) <> ''")
