"""Chat formatting after collapsing cumulative snapshots.

A conversation is its list of turns (role, text) in the order of turn number (nulls last), then
of the turn's digest. A logged conversation whose list is a proper prefix of a longer one is a
snapshot of it; rolling prefix hashes find those by an anti-join. Of conversations with equal
lists the smallest id stays. What remains is rendered.

The rolling hash is a sum of per-position digests, so it is a running total and can be put
together from blocks: neither numbering nor hashing needs a whole conversation in one task.
Each position adds two 60-bit parts of SHA-256(position, role, text), kept as two decimal
lanes that are summed without wrapping.

Defined results: exact repeats of a row (same conversation, turn, role, text) count once. A null
role or text is rendered as empty and differs from an empty one for the hash. Null conversation
ids form one conversation. Long conversations are rendered in parts of ``part_turns`` turns
(part 0, 1, ...), which bounds every row; most have only part 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

PART_TURNS = 256
BLOCK_TURNS = 256


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")


def _running(df: DataFrame, block: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running totals per conversation (columns of ``sums``), put together from blocks.

    Within (conversation, block) by a window; the blocks' totals, far fewer rows, by a second
    window; joined back on (conversation, block). Blocks ascend with ``order``.
    """
    inner = Window.partitionBy("conv_id", block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({k: F.sum(v).over(inner) for k, v in sums.items()})
    totals = df.groupBy("conv_id", block).agg(*(F.max(k).alias(k) for k in sums))
    before = Window.partitionBy("conv_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("__c"), F.col(block).alias("__b"), *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    # only conversations with several blocks have offsets to add
    totals = totals.where(" or ".join(f"__{k} > 0" for k in sums))
    met = df.join(totals, df.conv_id.eqNullSafe(totals["__c"]) & (df[block] == totals["__b"]), "left")
    return met.withColumns({k: F.col(k) + F.coalesce(F.col(f"__{k}"), F.lit(0)) for k in sums}).drop("__c", "__b", *(f"__{k}" for k in sums))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """Distinct turns with position (from 1) and the hash of the prefix that ends there (``h1``, ``h2``)."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    body = F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("r"), "role"), F.lit("")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))
    turns = turns.withColumn("digest", F.sha2(body, 256))
    # repeats go before any text is moved by position
    turns = turns.groupBy("conv_id", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    turns = turns.withColumn("__order", F.coalesce(F.col("turn"), F.lit(2**62)))
    turns = turns.withColumn("__block", F.floor(F.col("__order") / BLOCK_TURNS))
    turns = _running(turns, "__block", ["__order", "digest"], {"pos": F.lit(1).cast("long")})
    place = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest"), 256)
    turns = turns.withColumn("__place", place).withColumn("__block", F.floor((F.col("pos") - 1) / BLOCK_TURNS))
    turns = _running(turns, "__block", ["pos"], {"h1": _lane(F.col("__place"), 1), "h2": _lane(F.col("__place"), 16)})
    return turns.select("conv_id", "pos", "role", "text", "h1", "h2")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that are no proper prefix of another; one per equal list."""
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    whole = whole.select("conv_id", F.col("end.pos").alias("n_turns"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2"))
    lists = whole.groupBy("n_turns", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")
    )
    # prefixes that are not a conversation's end; the same prefix of many conversations collapses before the shuffle
    inner = prefixes.join(
        whole.select(F.col("conv_id").alias("__c"), F.col("n_turns")), prefixes.conv_id.eqNullSafe(F.col("__c")) & (F.col("pos") < F.col("n_turns"))
    ).select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    kept = lists.join(inner, ["n_turns", "h1", "h2"], "left_anti")
    return kept.select("conv_id", "n_turns", "n_copies")


def render(prefixes: DataFrame, kept: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per kept conversation and part: ``<|role|>`` line, text line, for each turn in order."""
    k = kept.select(F.col("conv_id").alias("__c"), "n_turns", "n_copies")
    turns = prefixes.join(k, prefixes.conv_id.eqNullSafe(F.col("__c"))).drop("__c")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    turns = turns.withColumn("part", F.floor((F.col("pos") - 1) / part_turns)).withColumn("line", F.struct("pos", line.alias("s")))
    parts = turns.groupBy("conv_id", "part").agg(
        F.any_value("n_turns").alias("n_turns"), F.any_value("n_copies").alias("n_copies"), F.sort_array(F.collect_list("line")).alias("lines")
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["s"]), "").alias("text"))


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    prefixes = materialise(prefix_hashes(conversations), "prefixes")
    return render(prefixes, maximal(prefixes), part_turns)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST,
    sha256(concat_ws(chr(1), coalesce('r' || role, ''), coalesce('t' || text, '')))) AS pos FROM t),
c AS (
  SELECT conv_id, max(pos) AS n, list(sha256(concat_ws(chr(1), coalesce('r' || role, ''), coalesce('t' || text, ''))) ORDER BY pos) AS l
  FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, sha256(l::VARCHAR) AS f, l FROM c),
p AS (SELECT DISTINCT k, sha256(l[1:k]::VARCHAR) AS f FROM h, unnest(range(1, n)) AS u(k)),
kept AS (
  SELECT min(conv_id) AS conv_id, n, count(*) AS copies FROM h
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = h.n AND p.f = h.f) GROUP BY n, f)
SELECT o.conv_id, ((pos - 1) // {PART_TURNS})::BIGINT AS part, n::BIGINT AS n_turns, copies::BIGINT AS n_copies,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS text
FROM o JOIN kept ON o.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY ALL
"""

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": ORACLE}
