"""Substring dedup: words of passages that stand earlier in the corpus are removed, the first occurrence stays.

A window is ``WINDOW`` consecutive words. Passes over the texts:

1. Each part of the input counts its windows in a count-min sketch: ``ROWS`` cells a window, each by another
   hash. A part's sketch is sparse, the cells that it has met, once or more often, as gaps in blocks of 2^16
   cells. The sketches merge by adding up the counts of a block; of the merged one only a bit a cell is kept,
   whether it counts two or more. Sketches overestimate: a window that stands twice has two in all of its cells.
2. Windows with a bit missing stand once and are done with. Only the others, estimated repeated, are grouped
   exactly, by two 64-bit hashes of their words: the first document of each owns it. Another pass counts how
   many such windows each document has, and hashes its words as they are.
3. Documents that own all of their windows and repeat none inside are done. Only the texts of the others are
   shuffled, to meet the windows they own: they lose the words of their other windows that were estimated
   repeated. Windows that turn out to stand once are owned by their document, so nothing is lost by the estimate.

The sketch has some four cells a window, at most 2^``MAX_BITS`` a row, so that its bits (128 MB at the most) can
be broadcast. With more windows more are estimated repeated, up to all of them; they then cost the shuffle of
one short row each, and none is lost.

Document order is doc_id, null ids last; rows that share an id, or have none, are ordered by a hash of their
text. Rows that are equal in id and text are one document: each gets the same result.

Defined results: null and empty texts have no words and nothing is removed; texts of fewer words than a window
lose nothing. Whole texts count, of any length. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, small, table
from .word_tokens import parts

WINDOW = 20
ROWS = 2
MAX_BITS = 29
#: Cells of a block of the sketch, and windows in a sketch before it is handed on.
BLOCK = 1 << 16
SKETCH_WINDOWS = 4_000_000
#: Characters of texts that are hashed at once.
CHARS_AT_ONCE = 2_000_000
SPACE = " \t\n\x0b\x0c\r"
#: Odd constants of the mixing steps: fractions of the golden ratio and of square roots of primes.
MIX = [int(0x9E3779B97F4A7C15), int(0xBB67AE8584CAA73B), int(0x3C6EF372FE94F82B), int(0xA54FF53A5F1D36F1)]


class Words:
    """Words of some texts: offsets of each text's words, the distinct words and the number of each."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.utf8_trim(pc.fill_null(texts, ""), SPACE)
        lists = pc.split_pattern_regex(texts, f"[{SPACE}]+")
        empty = np.asarray(pc.equal(texts, ""))
        values, at = lists.values, np.asarray(lists.offsets)
        if empty.any():  # an empty text splits into one empty word
            values = values.filter(pc.not_equal(values, ""))
            at = at - np.concatenate([[0], np.cumsum(empty)])
        self.values, self.at = values, at.astype(np.int64)
        coded = values.dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist())
        numbers = np.asarray(coded.indices)
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.lanes = [pairs[:, lane][numbers] for lane in range(2)]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, other hash) of the windows that lie in one text."""
        n = len(self.lanes[0])
        if n < size:
            return (np.empty(0, np.int64), *(np.empty(0, np.uint64) for _ in range(2)))
        left = np.repeat(self.at[1:], np.diff(self.at)) - np.arange(n)  # words from here to the text's end
        first = np.flatnonzero(left >= size)
        return (first, *(_rolled(lane, size, i)[first] for i, lane in enumerate(self.lanes)))


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of two hashes in order."""
    x = a * np.uint64(MIX[seed]) + (b ^ (b >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX[seed + 2])
    x ^= x >> np.uint64(29)
    return x


def _rolled(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every stretch of ``size`` words, put together from stretches of powers of two."""
    done, length, power, width = None, 0, words, 1
    while True:
        if size & width:
            if done is None:
                done = power
            else:  # the longer stretch after the shorter one
                n = len(words) - length - width + 1
                done = _mixed(done[:n], power[length : length + n], seed)
            length += width
        if length == size:
            return done
        power, width = _mixed(power[:-width], power[width:], seed), 2 * width


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each window in each row of the sketch."""
    return [((x * np.uint64(MIX[i + 1])) >> np.uint64(64 - bits)).astype(np.uint32) for i, x in enumerate([a, b][:ROWS])]


def _gaps(cells: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ascending cells as gaps within their blocks, 255 for each 255 of a gap; and the bytes of each cell."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype(np.int64)
    gaps[starts] = cells[starts] & np.uint32(BLOCK - 1)
    sizes = gaps // 255 + 1
    out = np.full(int(sizes.sum()), 255, np.uint8)
    out[np.cumsum(sizes) - 1] = gaps % 255
    return out, sizes


def _from_gaps(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(raw, dtype=np.int64)[raw < 255]


def _sketch(cells: list[list[np.ndarray]], bits: int) -> pa.RecordBatch:
    """(block, cells): of each block that is met the cells met once, then those met more often twice."""
    blocks, kept = [], []
    for row, some in enumerate(cells):
        every = np.sort(np.concatenate(some))
        fresh = np.concatenate([[True], every[1:] != every[:-1]])
        again = np.concatenate([[False], ~fresh[1:] & fresh[:-1]])  # the second of equal ones; further ones add nothing
        every = every[fresh | again]
        starts = np.flatnonzero(np.concatenate([[True], (every[1:] >> 16) != (every[:-1] >> 16)]))
        raw, sizes = _gaps(every, starts)
        ends = np.add.reduceat(sizes, starts).cumsum()
        blocks += ((every[starts] >> 16).astype(np.int64) + (row << (bits - 16))).tolist()
        kept += [raw[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(kept, pa.binary())], ["block", "cells"])


def repeated_cells(docs: DataFrame, window: int, bits: int) -> bytes:
    """The merged sketch's bits, row by row: whether a cell counts two or more. Of 2^bits cells a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(ROWS)], 0
        for batch in batches:
            for some in parts(batch, CHARS_AT_ONCE):
                _, a, b = Words(some.column("text")).windows(window)
                for row, cells in zip(held, _cells(a, b, bits), strict=True):
                    row.append(cells)
                n += len(a)
                if n >= SKETCH_WINDOWS:
                    yield _sketch(held, bits)
                    held, n = [[] for _ in range(ROWS)], 0
        if n:
            yield _sketch(held, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the rows of each block, which come one after the other, and no further than two."""
        block, sums = None, np.zeros(BLOCK, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(sums > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for b, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                if b != block:
                    if block is not None and (sums > 1).any():
                        yield done()
                    block, sums = b, np.zeros(BLOCK, np.uint8)
                met = _from_gaps(np.frombuffer(cells.as_buffer(), np.uint8))
                twice = met[1:][met[1:] == met[:-1]]
                sums[met] = np.minimum(sums[met] + 1, 2)
                sums[twice] = 2
        if block is not None and (sums > 1).any():
            yield done()

    sketches = docs.select("text").mapInArrow(count, "block long, cells binary").repartition("block").sortWithinPartitions("block")
    merged = materialise(sketches.mapInArrow(merge, "block long, bits binary"), "sketch")
    size = BLOCK // 8
    out = bytearray(ROWS << (bits - 3))
    for r in merged.toLocalIterator():  # ROWS * 2^(bits - 3) bytes at the most, 128 MB
        out[r["block"] * size : (r["block"] + 1) * size] = r["bits"]
    discard(merged)
    return bytes(out)


def _estimated(data: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which windows have two or more in all of their cells."""
    out = np.ones(len(a), bool)
    for row, cells in enumerate(_cells(a, b, bits)):
        at = (row << (bits - 3)) + (cells >> np.uint32(3)).astype(np.int64)
        out &= (data[at] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def _joined(words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    values, at = words.values, words.at
    if keep is not None:
        values, at = values.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[at]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), " ").cast(pa.binary()).to_pylist()


def _sha(texts: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())


class Repeats:
    """The windows of some texts that are estimated repeated: number of the text, first word, two hashes."""

    def __init__(self, words: Words, window: int, data: np.ndarray, bits: int) -> None:
        at, a, b = words.windows(window)
        met = np.flatnonzero(_estimated(data, a, b, bits))
        self.at, self.a, self.b = at[met], a[met], b[met]
        self.text = np.searchsorted(words.at, self.at, "right") - 1
        # of equal windows of a text the first
        order = np.lexsort((self.at, self.b, self.a, self.text))
        fresh = np.ones(len(order), bool)
        for x in (self.text, self.a, self.b):
            fresh[1:] &= x[order][1:] == x[order][:-1]
        fresh[1:] = ~fresh[1:]
        self.first = np.sort(order[fresh])


def _counted(docs: DataFrame, window: int, bits: int, sketch) -> DataFrame:
    """A row a document: its words, their hash, and how many windows are estimated repeated, how many of these differ."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            for some in parts(batch, CHARS_AT_ONCE):
                words = Words(some.column("text"))
                met = Repeats(words, window, data, bits)
                n = lambda of: pa.array(np.bincount(of, minlength=some.num_rows).astype(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("tie"), pa.array(np.diff(words.at)), _sha(_joined(words)), n(met.text), n(met.text[met.first])],
                    ["id", "tie", "n_words", "kept_sha256", "windows", "different"])

    return docs.mapInArrow(count, "id long, tie long, n_words long, kept_sha256 string, windows long, different long")


def _windows(docs: DataFrame, window: int, bits: int, sketch) -> DataFrame:
    """(a, b, id, tie): the different windows of each document that are estimated repeated."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            for some in parts(batch, CHARS_AT_ONCE):
                met = Repeats(Words(some.column("text")), window, data, bits)
                of = pa.array(met.text[met.first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met.a[met.first].view(np.int64)), pa.array(met.b[met.first].view(np.int64)), some.column("id").take(of), some.column("tie").take(of)],
                    ["a", "b", "id", "tie"])

    return docs.mapInArrow(list_, "a long, b long, id long, tie long")


def _cleaned(docs: DataFrame, window: int, bits: int, sketch) -> DataFrame:
    """``docs`` (id, text, own) without the words of windows that are estimated repeated and not their own."""
    pair = np.dtype([("a", "<i8"), ("b", "<i8")])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            for some in parts(batch, CHARS_AT_ONCE):
                words = Words(some.column("text"))
                met = Repeats(words, window, data, bits)
                own = some.column("own")
                owned = pc.list_flatten(own)
                ours = np.empty(len(owned), pair)
                ours["a"], ours["b"] = np.asarray(owned.field("a")), np.asarray(owned.field("b"))
                ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(own), 0)))])
                theirs = np.empty(len(met.first), pair)
                theirs["a"], theirs["b"] = met.a[met.first].view(np.int64), met.b[met.first].view(np.int64)
                spans = np.searchsorted(met.text[met.first], np.arange(some.num_rows + 1))
                stay = [np.isin(theirs[i:j], ours[k:m]) for i, j, k, m in zip(spans[:-1], spans[1:], ends[:-1], ends[1:], strict=True)]
                lost = np.ones(len(met.at), bool)
                lost[met.first] = ~np.concatenate([np.empty(0, bool), *stay])
                edges = np.zeros(int(words.at[-1]) + 1, np.int32)
                np.add.at(edges, met.at[lost], 1)
                np.add.at(edges, met.at[lost] + window, -1)  # a window lies in one text
                keep = np.cumsum(edges)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[words.at]
                texts = _joined(words, keep)
                n_words = np.diff(words.at)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), pa.array(n_words), pa.array(n_words - np.diff(kept)), _sha(texts), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, where words were removed, kept_text.

    ``kept_text`` is null for documents that keep all of their words.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_bits, max(16, int(size * 4 / 6).bit_length()))  # four cells for a word of six bytes
    sketch = spark.sparkContext.broadcast(repeated_cells(d, window, bits))
    counted = materialise(_counted(d, window, bits, sketch), "counted")
    # where each id names one document, it is all that the order needs: a number, which is aggregated by hash
    plain = counted.where("id IS NULL").isEmpty() and counted.groupBy("id").agg(F.count_distinct("tie").alias("n")).where("n > 1").isEmpty()
    place = F.min("id") if plain else F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie"))
    first = _windows(d, window, bits, sketch).groupBy("a", "b").agg(place.alias("first"))
    key = F.col("first") if plain else F.col("first.id")
    first = first.select("a", "b", key.alias("id"), F.lit(0).cast("long").alias("tie") if plain else F.col("first.tie").alias("tie"))
    own = materialise(first.groupBy("id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("own")), "own")  # of a document's windows at most
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (F.lit(True) if plain else x["tie"] == y["tie"])
    sizes = own.select("id", "tie", F.size("own").alias("n"))
    met = counted.alias("c").join(sizes.alias("s"), same(counted, sizes), "left").select("c.*", F.coalesce("s.n", F.lit(0)).alias("owned"))
    met = materialise(met.withColumn("loses", F.col("windows") > F.col("owned")), "verdicts")
    losers = met.where("loses").select("id", "tie").distinct()
    few = small(losers)
    texts = d.join(few, d["id"].eqNullSafe(few["id"]) & (d["tie"] == few["tie"]), "left_semi")
    texts = texts.join(own, same(texts, own), "left").select(texts["id"], texts["text"], own["own"])
    done = met.where("NOT loses").select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    discard(counted)
    return done.unionByName(_cleaned(texts, window, bits, sketch))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rn, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
first AS (SELECT t, min(rn * 10000000000 + i) AS k FROM win GROUP BY t HAVING count(*) > 1),
lost AS (SELECT DISTINCT rn, i + j AS p FROM win JOIN first USING (t), range({WINDOW}) AS r(j) WHERE rn * 10000000000 + i > k),
gone AS (SELECT rn, list(p) AS ps FROM lost GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(ps, []))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rn)
"""

QUERIES = {"op12_substring_dedup": op12_substring_dedup}
ORACLES = {"op12_substring_dedup": ORACLE}
