"""Toxicity by a counterfactually regularised classifier.

Logistic regression on the presence of words and word beginnings. In every sentence of the labelled
texts that mentions an identity group, the terms of a kind are swapped for those of every other group
of that kind in turn; the loss adds the mean squared change of the sentence's logit, so that a mention
by itself moves no score. As a swap changes identity features only, equal changes are counted before
they leave the executors. The vocabulary is what the labelled rows separate: features with a
chi-square of at least ``MIN_CHI2`` in at least ``MIN_DOCS`` of them, and all identity terms.

The model is fitted on at most ``MAX_TRAIN`` labelled documents, those with the least hash of their
id (a documented bound; scoring covers all documents and whole texts). Training is full-batch and
deterministic. Of rows that repeat a labelled id the one whose text has the least hash is learned from.

Defined results: null and empty texts get the score of a text without known words. A null doc_id
counts as the empty text for the fold. Of repeated labels the highest counts; null labels are no
labels. Without labels of both kinds every score is the smoothed share of toxic labels. Repeated
rows each get their score. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

MAX_TRAIN = 12_000
MIN_CHI2 = 10.8
MIN_DOCS = 5
BEGINNINGS = (4, 5)
PENALTY = 1.0
L2 = 0.3
STEPS = 300
FOLDS = 5

#: Identity terms, a row for each kind of group and language.
IDENTITY = [
    "women men girls boys ladies gentlemen",
    "woman man girl boy lady gentleman",
    "female male feminine masculine transgender nonbinary",
    "gay straight lesbian bisexual heterosexual queer",
    "muslim christian jewish hindu buddhist atheist catholic sikh",
    "muslims christians jews hindus buddhists atheists catholics sikhs",
    "black white asian latino african european arab indigenous",
    "immigrants natives refugees citizens foreigners locals",
    "disabled able blind deaf autistic",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs athées",
    "noirs blancs arabes asiatiques",
    "frauen männer mädchen jungen",
    "muslime christen juden atheisten",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos ateos",
]
ROWS = [row.split() for row in IDENTITY]
#: Of each term its rows, as a term may stand in several.
KINDS: dict[str, list[int]] = {}
for _i, _row in enumerate(ROWS):
    for _w in _row:
        KINDS.setdefault(_w, []).append(_i)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of words (marked by a hyphen)."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "-" for w in words if len(w) >= n)
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counterfactuals(words: set[str]) -> list[set[str]]:
    """A sentence's words with the terms of each kind it mentions turned to every other group of that kind."""
    out = []
    for kind in sorted({k for w in words & KINDS.keys() for k in KINDS[w]}):
        row = ROWS[kind]
        said = [i for i, w in enumerate(row) if w in words]
        for turn in range(1, len(row)):
            out.append((words - set(row)) | {row[(i + turn) % len(row)] for i in said})
    return [o for o in out if o != words]


def changes(text: str | None) -> list[str]:
    """Features that a swap takes from and adds to a sentence, one entry a swap: ``lost lost|new new``."""
    out = []
    for sentence in SENTENCE.split((text or "").lower()):
        words = set(WORD.findall(sentence))
        if words & KINDS.keys():
            own = features(words)
            for other in map(features, counterfactuals(words)):
                out.append(f"{' '.join(sorted(own - other))}|{' '.join(sorted(other - own))}")
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, n: int, swaps: list[tuple[list[int], list[int], int]], penalty: float = PENALTY, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias): logistic loss + l2 + penalty * mean squared logit change of ``swaps`` (features lost, new, count)."""
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    # the change of the logit is w . (x - x'), as signed entries
    d_where = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps]).astype(np.int64)
    d_what = np.array([f for a, b, _ in swaps for f in (*a, *b)], np.int64)
    d_sign = np.array([s for a, b, _ in swaps for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    share = np.array([k for *_, k in swaps], float)
    share /= max(1.0, share.sum())
    w, bias = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(where, w[what], len(rows)) + bias
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(what, miss[where], n) / len(y) + l2 * w / len(y)
        if len(swaps):
            change = share * np.bincount(d_where, d_sign * w[d_what], len(swaps))
            g += 2 * penalty * np.bincount(d_what, d_sign * change[d_where], n)
        gb = miss.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - 0.9 * t / steps)
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias) from ``labels`` (doc_id, toxic) of ``docs``; the caller leaves out the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    # bounded: MAX_TRAIN ids
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    texts = texts.join(F.broadcast(materialise(known, "labels")), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("y").alias("y"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = pa.array([sorted(features(words_of(t))) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), own, pa.array(list(map(changes, texts)), pa.list_(pa.string()))], ["y", "own", "swaps"])

    said = texts.select(F.col("y").cast("int").alias("y"), F.col("t.text").alias("text"))
    said = materialise(said.mapInArrow(extract, "y int, own array<string>, swaps array<string>"), "features")
    n = said.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    total, pos = n["n"], n["pos"]
    if not 0 < pos < total:
        return {}, float(np.log((pos + 1) / (total - pos + 1)))
    seen = said.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("k")).where(F.col("k") >= MIN_DOCS)
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    chi2 = total * (a * (total - pos - k + a) - (k - a) * (pos - a)) ** 2 / (k * (total - k) * pos * (total - pos))
    best = seen.where(k < total).withColumn("c", chi2).where(F.col("c") >= MIN_CHI2).select("f")
    names = sorted({r["f"] for r in best.collect()} | features(set(KINDS)))  # of MAX_TRAIN texts at most
    index = {f: i for i, f in enumerate(names)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[index[f] for f in row if f in index] for row in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(own, pa.list_(pa.int32()))], ["y", "own"])

    # MAX_TRAIN short rows of feature numbers; sorted, so that sums do not depend on how rows arrive
    got = sorted(said.select("y", "own").mapInArrow(number, "y int, own array<int>").collect())
    # counted changes of identity features: few of many sentences
    swaps = said.select(F.explode("swaps").alias("s")).groupBy("s").count().orderBy("s").collect()
    turned = [([index[f] for f in lost.split()], [index[f] for f in new.split()], r["count"]) for r in swaps for lost, new in [r["s"].split("|")]]
    w, bias = fit([np.array(r["own"], np.int64) for r in got], np.array([r["y"] for r in got], float), len(names), turned, penalty)
    discard(said)
    return {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, float(bias)


def score(docs: DataFrame, weights: dict[str, float], bias: float, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (a column of that name is replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cuts = weights.keys(), [(n, {f[:-1] for f in weights if f.endswith("-") and len(f) == n + 1}) for n in BEGINNINGS]
        for batch in batches:
            out = []
            for t in batch.column(text_col):
                words = words_of(t.as_py())
                hits = words & known
                for n, starts in cuts:
                    hits |= {c + "-" for c in {w[:n] for w in words if len(w) >= n} & starts}
                z = bias + sum(weights[f] for f in sorted(hits))
                out.append(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))
            names = [c for c in batch.schema.names if c != "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.float64())], [*names, "score"])

    docs = docs.drop("score")
    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def fold(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text) with ``score``; learned from the labels outside the held-out fold."""
    weights, bias = train(docs, labels.select("doc_id", "toxic").where(fold() != 0))
    return score(docs, weights, bias)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
