"""Title joins and summary scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_title


def title_join(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join on the normalised key of both sides; other columns get a suffix."""
    side = lambda d, s: d.select(normalize_title(F.col(key)).alias(key), *(F.col(c).alias(c + s) for c in d.columns if c != key))
    return side(left, suffixes[0]).join(side(right, suffixes[1]), key)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: the row of its table as bits of one number, a 0 where it rises."""
    places = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _token_sorted(x: str | None) -> str:
    return " ".join(sorted((x or "").split()))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 times the normalised common subsequence of the texts with their tokens sorted."""
    def one(x: str, y: str) -> float:
        x, y = _token_sorted(x), _token_sorted(y)
        return 200.0 * _common(x, y) / (len(x) + len(y)) if x or y else 100.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _characters(a: pd.Series) -> pd.Series:
    """Each character of the token-sorted text with its number among its equals; one blank for an empty text."""
    def one(x: str) -> list[str]:
        seen, out = {}, []
        for c in _token_sorted(x):
            seen[c] = seen.get(c, 0) + 1
            out.append(f"{c}{seen[c]}")
        return out or [""]

    return pd.Series([one(x) for x in a])


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common word subsequence."""
    def one(x: str, y: str) -> float:
        x, y = (x or "").lower().split(), (y or "").lower().split()
        n = _common(x, y) if x and y else 0
        return 2.0 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _may_reach(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs (l, r) that can have a ``token_sort_ratio`` of ``threshold`` (over 0), and some more.

    A pair that has it needs lengths m and n with n >= m * least, and m * least characters in common at
    least, where least = threshold / (200 - threshold). So both have one of the same numbered characters among
    their m - ceil(m * least) + 1 rarest: that and the other's length are what is joined on.
    """
    least = threshold / (200.0 - threshold)
    side = lambda d, n: d.select(F.col(n), _characters(n).alias("cs")).withColumn("m", F.size("cs"))
    left, right = side(left, "l"), side(right, "r")
    count = left.select(F.explode("cs").alias("c")).union(right.select(F.explode("cs").alias("c"))).groupBy("c").agg(F.count("*").alias("n"))

    def rarest(d: DataFrame, n: str) -> DataFrame:
        all_ = d.select(n, "m", F.explode("cs").alias("c")).join(count, "c").groupBy(n, "m").agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("cs"))
        some = (F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1).cast("int")
        return all_.select(n, "m", F.explode(F.slice("cs", F.lit(1), some)).alias("x")).select(n, "m", F.col("x.c").alias("c"))

    lengths = F.broadcast(right.select(F.col("m").alias("of")).distinct())
    fits = (F.col("of") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("of") * least - 1e-9)
    asked = rarest(left, "l").join(lengths, fits).select("l", "c", F.col("of").alias("m"))
    return asked.join(rarest(right, "r"), ["c", "m"]).select("l", "r").distinct()


_sorted_tokens = F.pandas_udf(lambda a: a.map(_token_sorted), T.StringType())


def _segment_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """As ``_may_reach``, for thresholds over 2/3 of 100: what is compared are pairs with a common piece at nearly the same place.

    Of lengths m and n, the score is reached by texts at most (m + n) * (1 - threshold / 100) insertions and deletions apart.
    A right text is cut into one piece more than the most that any partner may have, so one piece is left whole. It is
    moved by no more places than there are pieces before it, and its distance from the end by no more than there are
    pieces after it: else those on the other side have fewer edits than pieces, and one of them is whole as well.
    """
    least, spare = threshold / (200.0 - threshold), 1 - threshold / 100.0
    size = lambda d, n, m: d.select(F.col(n), _sorted_tokens(n).alias("t")).withColumn(m, F.length("t"))
    left, right = size(left, "l", "n"), size(right, "r", "m")
    longest = F.floor(F.col("m") / least + 1e-9)
    pieces = (F.floor((F.col("m") + longest) * spare + 1e-9) + 1).cast("int").alias("k")
    start = lambda i: F.floor(i * F.col("m") / F.col("k")).cast("int")
    numbers = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")
    length = start(F.col("i") + 1) - start(F.col("i"))
    cut_up = right.select("r", "t", "m", pieces).select("*", numbers).select("r", "m", "i", F.substr("t", start(F.col("i")) + 1, length).alias("piece"))

    lengths = F.broadcast(right.select("m").distinct())  # as many rows as the longest title has characters, at the most
    fits = (F.col("m") >= F.col("n") * least - 1e-9) & (F.col("n") >= F.col("m") * least - 1e-9)
    asked = left.join(lengths, fits).select("*", pieces).select("*", numbers)
    more, after = F.col("n") - F.col("m"), F.col("k") - 1 - F.col("i")
    first = F.greatest(start(F.col("i")) + F.greatest(-F.col("i"), more - after), F.lit(0))
    last = F.least(start(F.col("i")) + F.least(F.col("i"), more + after), F.col("n") - length)
    asked = asked.withColumns({"first": first, "last": last, "long": length}).where("first <= last")
    some = F.array_distinct(F.transform(F.sequence("first", "last"), lambda p: F.substr("t", p + 1, F.col("long"))))
    return asked.select("l", "m", "i", F.explode(some).alias("piece")).join(cut_up, ["m", "i", "piece"]).select("l", "r").distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, key: str, threshold: float = 90.0, scorer=token_sort_ratio) -> DataFrame:
    """For each left row its best right row with a score of at least ``threshold``; ties to the smaller key.

    No pair is lost: left out are only those that cannot reach the threshold, and none with another scorer, of which
    no bound is known. Null keys match nothing.
    """
    l, r = (d.select(F.col(key).alias(n)).where(F.col(n).isNotNull()).distinct() for d, n in ((left, "l"), (right, "r")))
    bounded = scorer is token_sort_ratio and 0 < threshold <= 100
    some = _segment_pairs if threshold >= 85 else _may_reach  # below, pieces are single characters or pairs of them
    pairs = some(l, r, threshold) if bounded else l.crossJoin(r)
    scored = pairs.withColumn("score", scorer("l", "r")).where(F.col("score") >= threshold)
    best = Window.partitionBy("l").orderBy(F.desc("score"), "r")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def fuzzy_merge(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str], threshold: float = 90.0) -> DataFrame:
    """Rows of both sides whose titles match by ``fuzzy_join``: left and right columns with suffixes, and ``score``."""
    side = lambda d, s: d.select(*(F.col(c).alias(c + s) for c in d.columns))
    found = fuzzy_join(left, right, key, threshold)
    a, b = side(left, suffixes[0]), side(right, suffixes[1])
    return a.join(found, a[key + suffixes[0]] == found["l"]).join(b, b[key + suffixes[1]] == found["r"]).drop("l", "r")


def ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram, count) of the lower-cased word n-grams."""
    w = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda x: x != "")
    grams = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))
    return df.select(key, w.alias("w")).select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def rouge_n(pairs: DataFrame, key: str, made: str, gold: str, n: int) -> DataFrame:
    """(key, overlap, made, gold, f1) by multiset overlap of n-grams."""
    a, b = ngrams(pairs, key, made, n).withColumnRenamed("n", "a"), ngrams(pairs, key, gold, n).withColumnRenamed("n", "b")
    both = a.join(b, [key, "gram"], "full").groupBy(key).agg(
        F.coalesce(F.sum(F.least("a", "b").cast("long") * F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("overlap"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_made"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_gold"))
    return both.withColumn("f1", F.when(F.col("n_made") + F.col("n_gold") > 0, 2.0 * F.col("overlap") / (F.col("n_made") + F.col("n_gold"))).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def greedy_match(made: Column, gold: Column) -> Column:
    """Precision, recall and F1 of two arrays of token vectors: each token's best cosine on the other side, averaged.

    Null where either side is empty or null.
    """
    best = lambda x, others: F.array_max(F.transform(others, lambda y: cosine(x, y)))
    mean = lambda a, b: F.aggregate(F.transform(a, lambda x: best(x, b)), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    p, r = mean(made, gold), mean(gold, made)
    f1 = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.when((F.size(made) > 0) & (F.size(gold) > 0), F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1")))


@F.pandas_udf(T.DoubleType())
def rouge_lsum(made: pd.Series, gold: pd.Series) -> pd.Series:
    """F1 of the union of longest common subsequences: each gold line with every made line; lines part sentences.

    A word counts as often at most as it stands in both texts.
    """
    from collections import Counter

    def places(x: list[str], y: list[str]) -> set[int]:
        """Places in ``x`` of one longest common subsequence."""
        rows = [[0] * (len(y) + 1)]
        for a in x:
            row = [0]
            for j, b in enumerate(y):
                row.append(rows[-1][j] + 1 if a == b else max(rows[-1][j + 1], row[-1]))
            rows.append(row)
        i, j, out = len(x), len(y), set()
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                out.add(i)
            elif rows[i - 1][j] >= rows[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    def one(m: str, g: str) -> float:
        m, g = ([line.lower().split() for line in (t or "").split("\n") if line.strip()] for t in (m, g))
        left, other = Counter(w for s in g for w in s), Counter(w for s in m for w in s)
        sizes, hits = left.total() + other.total(), 0
        for s in g:
            for i in sorted(set().union(*(places(s, x) for x in m))) if m else ():
                if left[s[i]] > 0 and other[s[i]] > 0:
                    hits, left[s[i]], other[s[i]] = hits + 1, left[s[i]] - 1, other[s[i]] - 1
        return 2.0 * hits / sizes if hits else 0.0

    return pd.Series([one(m, g) for m, g in zip(made, gold, strict=True)])


def basic_scores(pairs: DataFrame, key: str, made: str, gold: str) -> DataFrame:
    """(key, rouge1, rouge2, rouge_l, rouge_lsum) of one summary and its gold text a key."""
    out = pairs.select(key, rouge_l(made, gold).alias("rouge_l"), rouge_lsum(made, gold).alias("rouge_lsum"))
    for n in (1, 2):
        found = rouge_n(pairs, key, made, gold, n).select(key, F.col("f1").alias(f"rouge{n}"))  # texts without n-grams have no row
        out = out.join(found, key, "left").na.fill(0.0, [f"rouge{n}"])
    return out.select(key, "rouge1", "rouge2", "rouge_l", "rouge_lsum")
