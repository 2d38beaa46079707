"""Filter interaction audit: what each filter removes, in every order of the filters.

The filters A to D look at a text alone, E at identical texts. Identical texts are found by refining a
partition of the documents: first by length in code points, then by the hash of one block of the text after
the other; blocks grow by ``GROWTH``, so a text has few. After each split the classes of one document are
dropped. The full texts of the classes that are left are compared: of equal ones all but those with the
smallest id fail E. Classes whose texts differ in spite of equal hashes are joined by their texts.

A document then is a mask of failed filters. Masks are counted by part and label; every order is evaluated on
the counts alone. The documents that fail E are counted as corrections to the masks without E, so that
no join runs over all documents.

One pass over the texts writes a short row a document; a second reads texts of surviving classes only. Their
class and text are aggregated before they are shuffled, so equal copies meet as one row a task.

Defined results: null text is empty, so null and empty texts are identical. A null id is neither smaller nor
larger than any: it neither fails E nor makes others fail. Rows that repeat an id and a text don't fail by each
other. Null source is the part '', with the sources that are ''. A document is of quality or toxic if a label
row of its id says so. An empty table has no parts, so no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let, materialise, small, table, words_of

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"
#: Code points of a text's first block, and how many times larger each next one is.
BLOCK = 256
GROWTH = 16


def fails_alone(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D; ``text`` is not null."""
    bit = lambda cond, i: F.when(cond, 1 << i).otherwise(0)
    words = lambda n, distinct: bit(n < MIN_WORDS, 0) + bit(100 * distinct < MIN_DISTINCT_PERCENT * n, 1)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    by_words = let(words_of(text), lambda w: words(F.size(w), F.size(F.array_distinct(w))))
    return by_words + bit(100 * upper > MAX_UPPER_PERCENT * F.length(text), 2) + bit(text.rlike(SYMBOLS), 3)


def _start(number: int) -> int:
    """Code points before block ``number``."""
    return BLOCK * (GROWTH**number - 1) // (GROWTH - 1)


def block_hash(text: Column, number: int) -> Column:
    """Hash of the code points of block ``number``, from 0; blocks beyond the text hash alike."""
    return F.xxhash64(F.substring(text, _start(number) + 1, BLOCK * GROWTH**number))


def _blocks(longest: int) -> int:
    """Blocks that hold a text of ``longest`` code points."""
    n = 0
    while _start(n) < longest:
        n += 1
    return n


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with good and toxic (0 or 1) by id."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return docs.join(known, "id", "left").fillna(0, ["good", "toxic"])


def _without_singles(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose ``key`` another row has, too."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return materialise(rows.join(small(many), key, "left_semi"), name)


def _class(length: Column, hashes: Column, blocks: int) -> Column:
    """The class of a text after ``blocks`` splits by its blocks' hashes."""
    key = length.cast("long")
    for i in range(blocks):
        key = F.xxhash64(key, F.get(hashes, F.lit(i)))
    return key


def duplicates(rows: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail E, by what else they fail.

    ``rows`` has a short row for each document (id, length, hashes and those columns), ``texts`` all texts with
    id, part, length and hashes. Refines by length, then by each block's hash on what is left; compares
    the surviving texts at last.
    """
    columns = ["part", "mask", "good", "toxic"]
    left = _without_singles(rows.withColumn("class", F.col("length").cast("long")), "class", "length")
    blocks = _blocks(left.agg(F.max("length")).first()[0] or 0)
    for i in range(blocks):
        split = left.withColumn("class", F.xxhash64("class", F.get("hashes", F.lit(i))))
        finer = _without_singles(split, "class", f"block{i}")
        discard(left)
        left = finer
    classes = small(left.select("class").distinct())
    texts = texts.withColumn("class", _class(F.col("length"), F.col("hashes"), blocks))
    members = texts.select("class", "text", "id").join(classes, "class", "left_semi")
    same = materialise(members.groupBy("class", "text").agg(F.min("id").alias("least")), "same")
    several = materialise(same.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least")), "classes")
    out = left.join(small(several.where("texts = 1").select("class", "least")), "class").where("id > least").select(columns)
    mixed = several.where("texts > 1").select("class")
    if not mixed.isEmpty():  # hashes have met by chance: rows of these classes are told apart by their texts
        met = texts.join(small(mixed), "class", "left_semi").join(same.drop("class"), "text").where("id > least")
        found = _labelled(met.select("id", "part", fails_alone(F.col("text")).alias("mask")), labels)
        out = out.unionByName(found.select(columns))
    out = materialise(out.groupBy(*columns).agg(F.count("*").alias("n")), "again")
    discard(left, same, several)
    return out


def _masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by what they fail."""
    d = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("length", F.length("text"))
    blocks = _blocks(d.agg(F.max("length")).first()[0] or 0)
    hashes = [F.when(F.col("length") > _start(i), block_hash(F.col("text"), i)).otherwise(0) for i in range(blocks)]
    texts = d.withColumn("hashes", F.array(*hashes).cast("array<bigint>"))
    rows = materialise(_labelled(texts.select("id", "part", "length", "hashes", fails_alone(F.col("text")).alias("mask")), labels), "rows")
    keys = ["part", "mask", "good", "toxic"]
    e = 1 << FILTERS.index("E")
    again = duplicates(rows, texts, labels)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = counts.unionByName(again.withColumn("n", -F.col("n"))).unionByName(again.withColumn("mask", F.col("mask") + e))
    counts = materialise(counts.groupBy(*keys).agg(F.sum("n").alias("n")), "masks")
    discard(rows, again)
    return counts


def _orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, own, before): bits of a step's filter and of those before it."""
    every = ",".join("".join(p) for p in permutations(FILTERS))
    steps = spark.range(1).select(F.explode(F.split(F.lit(every), ",")).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    bit = lambda c: F.power(F.lit(2), F.instr(F.lit(FILTERS), c) - 1).cast("int")
    letters = F.split(F.col("filter_order"), "")
    earlier = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, c: a + bit(c))
    return steps.select("filter_order", "step", bit(letter).alias("own"), earlier.alias("before"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included."""
    spark = docs.sparkSession
    masks = _masks(docs, labels)
    bits = [1 << i for i in range(len(FILTERS))]
    states = ",".join(f"struct({own} AS own, {before} AS before)" for own in bits for before in range(1 << len(FILTERS)) if not before & own)
    at = masks.selectExpr("*", f"inline(array({states}))")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    # in 120 / k of the orders a filter comes before the others of the k that a document fails
    first = F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))
    counts = at.groupBy("part", "own", "before").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~gone & fails & (F.col("good") == 1)).alias("good_lost"), total(~gone & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.round(first).cast("long") * F.col("n"))), F.lit(0)).cast("long").alias("shapley"),
    )
    out = counts.join(F.broadcast(_orders(spark)), ["own", "before"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{
    'A': len(w) < {MIN_WORDS}, 'B': 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > {MAX_UPPER_PERCENT} * length(text),
    'D': regexp_matches(text, '{SYMBOLS}'), 'E': coalesce(doc_id > least, false)}} AS x
  FROM d LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, good, toxic, count(*) AS n,
    (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END)
    || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails
  FROM f GROUP BY ALL),
c(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM c a, c b, c c, c d, c e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS own,
    length(translate(fails, before, '')) < length(fails) AS gone
  FROM m, s),
t AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (own AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": ORACLE}
