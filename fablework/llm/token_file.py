"""Token-id files: one concatenated id array, document boundaries in Elias-Fano code.

A file is a run of blocks in ascending document order, each closed by a newline:

magic ``FWT1``, part u32, sequence u32, ids of the part before the block u64, documents u32, of
them without an id u32, smallest doc_id i64, ids u64, bytes an id u8, bytes of the two sequences
u32 u32; then the Elias-Fano code of the documents' ends (relative to the block), that of the
doc_ids (less the smallest), and the ids themselves, 2 or 4 bytes each, little-endian.

Parts are Spark partitions, split by range of doc_id; their totals give every block its place in
the whole array, so no table of 64-bit offsets is kept. Files are written by Spark's committer as
raw records and read as whole binary files of bounded size, so any file system of Spark will do.
A document's bounds are selected from the code by its number in the block, as the reader does.

Defined results: null text is empty; every document gets the end id. Documents with a null doc_id
come last. Equal doc_ids follow each other in the order of their texts' hashes. Other columns are
ignored. No documents: no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import elias_fano
from .common import materialise, shared_dir, small, table
from .word_tokens import parts, word_ids

HEAD = struct.Struct("<4sIIQIIqQBII")
MAGIC = b"FWT1"
BLOCK_IDS = 1 << 20
BLOCKS_A_FILE = 8
END_ID = 2


def pack(part: int, seq: int, before: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One block; ``doc_ids`` ascending, nulls last; ``ids``: each document's bytes."""
    import numpy as np

    ends = np.cumsum([len(x) // width for x in ids])
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    a, b = elias_fano.encode(ends), elias_fano.encode(np.array([d - least for d in known], np.uint64))
    return HEAD.pack(MAGIC, part, seq, before, len(doc_ids), len(doc_ids) - len(known), least, int(ends[-1]), width, len(a), len(b)) + a + b + b"".join(ids)


def blocks(data: bytes) -> Iterator[dict]:
    """Blocks of a file: part, seq, before, doc_ids (None for null), ends, ids (an array)."""
    import numpy as np

    at, view = 0, memoryview(data)
    while at < len(data):
        magic, part, seq, before, n, nulls, least, total, width, a, b = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at += HEAD.size
        ends, known = elias_fano.EliasFano(view[at : at + a]), elias_fano.EliasFano(view[at + a : at + a + b])
        at += a + b
        ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", total, at)
        at += total * width + 1
        yield {"part": part, "seq": seq, "before": before, "ends": ends, "ids": ids,
               "doc_ids": [int(x) + least for x in known.select_all()] + [None] * nulls}


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2) -> None:
    """Encode whole texts and write them in ascending doc_id order below ``path``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words, part = word_ids(tokenizer, "<u2" if width == 2 else "<u4"), TaskContext.get().partitionId()
        end = np.array([end_id], words.dtype).tobytes()
        seq, before, held, rows, names = 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(part, seq, before, names, rows, width)], pa.binary())], ["block"])

        for batch in batches:
            for some in parts(batch, 2_000_000):
                texts = [t or "" for t in some.column("text").to_pylist()]
                for name, ids in zip(some.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                    if rows and held + len(ids) > BLOCK_IDS * width:
                        yield flush()
                        seq, before, held, rows, names = seq + 1, before + held // width, 0, [], []
                    names.append(name)
                    rows.append(ids + end)
                    held += len(ids) + len(end)
        if rows:
            yield flush()

    out = d.mapInArrow(encode, "block binary").select(F.col("block").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", BLOCKS_A_FILE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``path``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for content in batch.column("content"):
                for b in blocks(content.as_py()):
                    spans = np.array([b["ends"].span(i) for i in range(b["ends"].n)], np.int64).reshape(-1, 2)
                    ids = b["ids"].astype("<u4")
                    crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in spans.tolist()]
                    starts, sizes = spans[:, 0], spans[:, 1] - spans[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(spans), b["part"])), pa.array(b["doc_ids"], pa.int64()), pa.array(starts + b["before"]), pa.array(sizes), pa.array(crc, pa.int64())],
                        ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialise(files.mapInArrow(decode, "part long, doc_id long, at long, n_tokens long, ids_crc32 long"), "rows")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("part").alias("p")).agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    totals = totals.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a partition
    met = rows.join(small(totals), rows.part == F.col("p"))
    return met.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/ids"
    write(docs, path, tokenizer, **options)
    return read(docs.sparkSession, path)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_token_file": op2_token_file}
ORACLES: dict[str, str] = {}
