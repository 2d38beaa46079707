"""Paragraph segments and size-bounded chunks; ``segments(doc_id, pos, text, ...)`` carry an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank lines with their position."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "text"))
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def prefix_percent(segments: DataFrame, keys: list[str], order: list[str], text_col: str = "text", name: str = "percent") -> DataFrame:
    """Characters of earlier segments as a percentage of the group's (at least 1)."""
    size = F.length(text_col)
    earlier = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn(name, earlier * 100 / F.greatest(F.sum(size).over(Window.partitionBy(*keys)), F.lit(1)))


def between_markers(segments: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Segments from the start marker (cut before it) to the end marker, inclusive (cut after it); an absent end cuts nothing."""
    up_to = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = segments.withColumn("__on", F.max(F.contains("text", F.lit(start)).cast("int")).over(up_to)).where("__on = 1")
    s = s.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
    s = s.withColumn("text", F.when(F.col("__first"), F.trim(F.substr("text", F.instr("text", F.lit(start))))).otherwise(F.col("text")))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__hit", F.contains("text", F.lit(end))).withColumn("__done", F.coalesce(F.max(F.col("__hit").cast("int")).over(before), F.lit(0))).where("__done = 0")
    cut = F.trim(F.substr("text", F.lit(1), F.instr("text", F.lit(end)) + len(end) - 1))
    return s.withColumn("text", F.when(F.col("__hit"), cut).otherwise(F.col("text"))).drop("__on", "__first", "__hit", "__done")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_rows(segments: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, sentence, text): the sentences of each segment, numbered from 0; blank ones are left out."""
    rows = segments.select(*keys, F.posexplode(sentences(F.col(text_col))).alias("sentence", "text"))
    return rows.where("trim(text) <> ''")


def allowed(segments: DataFrame, heads: list[str], column: str = "head") -> DataFrame:
    """Segments whose head is one of ``heads`` (trimmed, blank ones left out); none given allows all."""
    names = [h.strip() for h in heads if h.strip()]
    return segments.where(F.trim(column).isin(names)) if names else segments


def percents(segments: DataFrame, story: list[str], chapter: list[str], order: list[str]) -> DataFrame:
    """Adds ``story_percent`` and ``chapter_percent``: characters of earlier segments of the story, of the chapter."""
    out = prefix_percent(segments, story, order, name="story_percent")
    return prefix_percent(out, chapter, order, name="chapter_percent")


def paragraph_count(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(F.count("*").alias("paragraphs"))


def pack(segments: DataFrame, keys: list[str], limit: int = 1500, order: str = "pos", first: list[str] = (), last: list[str] = (), block: int = folds.BLOCK) -> DataFrame:
    """Greedy packing of ordered segments into chunks of at most ``limit`` characters, joined by newlines.

    A segment longer than the limit is packed by sentences, joined by single spaces, into chunks of its
    own; a sentence longer than the limit stands alone. A limit of 0 or less packs everything into one
    chunk. Of the columns ``first`` a chunk has the values of its first segment, of ``last`` those of its
    last; a column may be in both if it is renamed by the caller. Segments without text are left out; those with
    equal keys and order are taken by a hash of their text.

    A book may be of any length: no row, task or group holds more than a block of its segments (``folds``),
    but for a limit of 0 or less, where the one chunk does.
    """
    extra = list(dict.fromkeys([c for c in (*first, *last) if c != order]))
    seg = segments.where("text IS NOT NULL").select(*keys, order, "text", *(c for c in extra if c not in keys))
    values = lambda x, names: [x[c].alias(c) for c in names if c not in keys]
    if limit <= 0:
        at = F.sort_array(F.collect_list(F.struct(order, "text", *(c for c in extra if c not in keys))))
        whole = seg.groupBy(*keys).agg(at.alias("__s"))
        ends = F.get("__s", F.lit(0)), F.element_at("__s", -1)
        text = F.array_join(F.transform("__s", lambda x: x["text"]), "\n").alias("text")
        return whole.select(*keys, F.lit(0).alias("chunk"), text, *values(ends[0], first), *values(ends[1], [c for c in last if c not in first]))

    long = F.transform(sentences(F.col("text")), lambda t, i: F.struct(t.alias("__text"), F.lit(" ").alias("__sep"), (i == 0).alias("__fresh"), i.alias("__sub")))
    short = F.array(F.struct(F.col("text").alias("__text"), F.lit("\n").alias("__sep"), F.lit(False).alias("__fresh"), F.lit(0).alias("__sub")))
    seg = seg.withColumns({"__tie": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    units = seg.select("*", F.inline(F.when(F.length("text") > limit, long).otherwise(short))).drop("text")
    units = folds.numbered(units, [*keys, order, "__tie", "__row", "__sub"])
    key = lambda seed: F.xxhash64(F.lit(seed), *keys)
    sizes = units.select("pos", F.length("__text").alias("size"), F.col("__sep").alias("sep"), F.col("__fresh").alias("fresh"), key(0).alias("key_a"), key(1).alias("key_b"))
    starts = folds.beginnings(sizes, limit, block)

    size = folds.block_size(limit, block)
    marks = starts.select("block", F.col("start").alias("pos"), F.struct("start", "number", "own").alias("__mark"))
    rows = folds.near(units, limit + 2, size).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("block").orderBy("pos", F.col("__mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.last("__mark", ignorenulls=True).over(upto)).where("__mark IS NULL AND __in.own")
    unit = F.struct("pos", "__text", "__sep", *dict.fromkeys([*keys, order, *extra]))
    chunks = rows.groupBy("block", "__in.start", "__in.number").agg(F.sort_array(F.collect_list(unit)).alias("__s"))
    head, tail = F.get("__s", F.lit(0)), F.element_at("__s", -1)
    text = F.array_join(F.transform("__s", lambda x: x["__text"]), "\n")
    text = F.when(head["__sep"] == " ", F.array_join(F.transform("__s", lambda x: x["__text"]), " ")).otherwise(text)
    own = [head[c].alias(c) for c in keys]
    return chunks.select(*own, F.col("number").cast("int").alias("chunk"), text.alias("text"), *values(head, first), *values(tail, [c for c in last if c not in first]))


def oversize(chunks: DataFrame, limit: int = 1500) -> DataFrame:
    """Chunks beyond the limit: single sentences that are longer."""
    return chunks.where(F.length("text") > limit)


def oversize_sentences(segments: DataFrame, keys: list[str], limit: int = 1500) -> DataFrame:
    """(keys, text): what ``oversize`` finds among the chunks of ``pack`` for a limit above 0, without packing.

    A chunk is longer than the limit only if it is one sentence, of a segment that is longer, and each such sentence is a
    chunk of its own. So every segment tells its own, and nothing is ordered, numbered or shuffled.
    """
    long = segments.where(F.length("text") > limit)
    return oversize(long.select(*keys, F.explode(sentences(F.col("text"))).alias("text")), limit)
