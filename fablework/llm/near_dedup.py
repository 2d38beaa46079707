"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct word shingles. Its signature has 66 b-bit (16-bit) minima. Two
signatures within Hamming distance 21 (in symbols) agree, by pigeonhole, on one of 11 chunks of 6
symbols with at most one error; enumerating the allowed error (each symbol of a chunk left out in
turn) gives 66 keys a document, and any such pair shares a key. A pair of similarity 0.8 shares none
with probability 8e-6, one of 0.85 with 2e-7; every candidate is confirmed on the full sets.

Equal sets collapse first, so exact copies never meet in pairs. Large groups of near copies are not
expanded either: only links that join components matter. In rounds, while that joins many, each
document proposes up to three partners, random members of its buckets; what is
then left in different components of a bucket is compared exactly, each document outside the bucket's
main component with the members of other components, in tiles of signatures, and only close pairs
leave a tile, each at its first shared key. Candidates whose signatures differ in over 30 of 66 symbols (probability
1e-6 at similarity 0.8) are not compared on sets. Links give components by label propagation.

Defined results: documents without words have an empty set, link with nothing and are their own
component. Fewer words than a shingle: the whole sequence is the one shingle. A null doc_id counts as
larger than any other: it links as others do, under a surrogate above all ids; a component of null ids
alone is null and not kept. Rows that repeat a doc_id are one document with several sets, and so of one
component. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, small, table
from .word_tokens import parts

SYMBOLS, CHUNK = 66, 6
CHUNKS = SYMBOLS // CHUNK
MAX_DISTANCE = 30
PERCENT = 80
PROPOSALS = 3
MAX_ROUNDS = 12
TILE = 2048
CELLS = 65_536
BYTES_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 1024


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLY, ADD = _odd(1, SYMBOLS).astype(np.uint32), _odd(4, SYMBOLS).astype(np.uint32)
PLACE, SEAM = _odd(2, 64), _odd(3, 2)
KEY_MULTIPLY, KEY_ADD = _odd(5, SYMBOLS), _odd(6, SYMBOLS)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its ``k``-word shingles; letters and white space of ASCII count.

    Words are split and numbered by Arrow, and each distinct one is hashed once.
    """
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = words.flatten().dictionary_encode()
    listed = coded.dictionary.cast(pa.large_binary()).to_pylist()
    numbers = np.asarray(coded.indices)
    said = np.array([len(w) > 0 for w in listed], bool)[numbers] if listed else np.zeros(0, bool)  # no empty word at either end
    h = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))[numbers[said]]
    ends = np.cumsum(np.asarray(pc.list_value_length(words)), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(said)])[ends]
    total = _joined(h, k)
    out = []
    for i, j in pairwise([0, *ends.tolist()]):
        if i == j:
            out.append(np.zeros(0, np.uint64))
        else:
            out.append(np.unique(_mix(total[i : j - k + 1] if j - i >= k else _joined(h[i:j], j - i))))
    return out


def _joined(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive words."""
    n = max(0, len(h) - k + 1)
    total = np.full(n, k, np.uint64) * SEAM[0]
    for i in range(min(k, len(h))):
        total += _mix(h[i : i + n] ^ PLACE[i % 64]) * PLACE[(i + 1) % 64]
    return total


def signature(s: np.ndarray) -> np.ndarray:
    """16-bit symbols of the minima of ``SYMBOLS`` multiplicative hashes of 32 bits, which processors do many at once."""
    low, x = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), ROWS_AT_ONCE):
        low = np.minimum(low, (x[i : i + ROWS_AT_ONCE, None] * MULTIPLY + ADD).min(0))
    return (_mix(low.astype(np.uint64)) >> np.uint64(48)).astype("<u2")


def keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) 64-bit keys: each chunk with each one of its symbols left out."""
    parts = _mix(signatures.astype(np.uint64) * KEY_MULTIPLY + KEY_ADD) * KEY_MULTIPLY
    chunk = parts.reshape(len(signatures), CHUNKS, CHUNK).sum(2, dtype=np.uint64)
    return _mix(np.repeat(chunk, CHUNK, axis=1) - parts + KEY_ADD)


def _sign(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in parts(batch, BYTES_AT_ONCE):
                sets = shingles(part.column("text"), k)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                cols = [part.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, slot, rep): ``slot`` is the chunk times ``CHUNK`` plus the place left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
                rep = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), SYMBOLS)
                slot = np.tile(np.arange(SYMBOLS, dtype=np.int16), len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(keys(sig).ravel().view(np.int64)), pa.array(slot), pa.array(rep)], ["key", "slot", "rep"])

    return reps.mapInArrow(run, "key long, slot short, rep long")


def _across(x: np.ndarray, y: np.ndarray, slot: int) -> np.ndarray:
    """[i, j]: rows of signatures that are close and whose first shared key is the one in ``slot``.

    The first shared key: of the first chunk with at most one error, the place of that error (0 without one).
    """
    wrong = x[:, None, :] != y[None, :, :]
    close = wrong.sum(2) <= MAX_DISTANCE
    errors = wrong.reshape(*close.shape, CHUNKS, CHUNK)
    many = errors.sum(3)
    first = (many <= 1).argmax(2)
    at = np.take_along_axis(errors.argmax(3), first[:, :, None], 2)[:, :, 0]
    return close & (first * CHUNK + at == slot)


def _between(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Close pairs (a, b) of different components in split buckets, each pair once.

    ``rows``: (key, slot, rep, label). Documents outside a bucket's main component (side 0) meet
    all of the bucket (side 1) in tiles: both sides are dealt over parts of about ``TILE`` rows, and each
    part of one meets each of the other under a salt of its own, so a hot bucket is many tasks' work. A
    task holds side 0 and streams side 1 by. What leaves it is close by signature and similar enough
    on 16 bits of each shingle's hash, which loses no pair; that leaves few pairs for the full sets.
    """
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = rows.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
    main = sizes.select("key", F.col("m.label").alias("main"), tiles(F.col("n") - F.col("m.count")).alias("tiles"), tiles(F.col("n")).alias("strips"))
    # written first: an aggregate in the join's own stage would keep a hot key from being split
    main = materialise(main, "main")
    rows = materialise(rows.join(main, "key").join(sigs.join(sets.select("rep", "t"), "rep"), "rep"), "signed_rows")

    def side(of: DataFrame, number: int, own: str, other: str) -> DataFrame:
        """Rows dealt over their side's tiles by hash, a copy for every tile of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
        dealt = of.select("*", F.pmod(F.xxhash64("rep"), own).cast("int").alias(f"{own}_at"), every)
        salt = F.col("tiles_at").cast("long") * F.col("strips") + F.col("strips_at")
        return dealt.select("key", salt.alias("salt"), F.lit(number).alias("side"), "slot", "rep", "label", "main", "sig", "t")

    left, right = side(rows.where("label <> main"), 0, "tiles", "strips"), side(rows, 1, "strips", "tiles")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []  # side 0 of the current tile: [reps, labels, signatures, short sets]
        seen = np.zeros(1 << 16, bool)

        def similar(p: np.ndarray, q: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
            """Which pairs (p ascending) may reach the similarity; ``seen`` holds the set of one p at a time."""
            ok, last = np.zeros(len(p), bool), -1
            for n, (i, j) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                if i != last:
                    seen[:] = False
                    x = np.frombuffer(one[i], "<u2")
                    seen[x], last = True, i
                y = np.frombuffer(two[j], "<u2")
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = int(np.count_nonzero(seen[y]))
                    ok[n] = 100 * both >= percent * (len(x) + len(y) - both)
            return ok

        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                key, salt, side, slot, rep, label, main = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "side", "slot", "rep", "label", "main"))
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
                short = batch.column("t").to_numpy(zero_copy_only=False)
                new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])) + 1
                for i, j in zip([0, *new.tolist()], [*new.tolist(), len(key)], strict=True):
                    if (key[i], salt[i]) != group:
                        group, held = (key[i], salt[i]), []
                    if side[i] == 0:
                        held.append((rep[i:j], label[i:j], sig[i:j], short[i:j]))
                        continue
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    for r, l, x, t in held:
                        step = max(1, CELLS // (j - i))
                        for k in range(0, len(r), step):
                            ok = (l[k : k + step, None] != label[None, i:j]) & ((label[i:j] == main[i:j])[None, :] | (r[k : k + step, None] < rep[None, i:j]))
                            if ok.any():
                                p, q = np.nonzero(ok & _across(x[k : k + step], sig[i:j], int(slot[i])))
                                near = similar(p, q, t[k : k + step], short[i:j])
                                p, q = p[near], q[near]
                                if len(p):
                                    one, two = r[k : k + step][p], rep[i:j][q]
                                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures are within ``MAX_DISTANCE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= MAX_DISTANCE))

    one, two = (reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, k: int, nameless: DataFrame | None = None) -> DataFrame:
    """(rep, n, s, t): full sets of the documents ``ids`` (rep): sorted 64-bit hashes, and their low 16 bits.

    ``nameless``: (digest, rep) of the sets that only documents without an id have; those are found by digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, BYTES_AT_ONCE):
                sets = shingles(part.column("text"), k)
                cols = [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.astype("<u2").tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "n", "s", "t"])

    def by_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in run(batches):
            digest = pa.array([xxhash.xxh3_128_digest(x.as_py()) for x in batch.column("s")], pa.binary())
            yield pa.RecordBatch.from_arrays([digest, *batch.columns[1:]], ["digest", "n", "s", "t"])

    made = docs.join(small(ids.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(run, "rep long, n long, s binary, t binary")
    if nameless is not None:
        asked = small(nameless.join(ids, "rep", "left_semi"))
        found = docs.where("doc_id is null").mapInArrow(by_digest, "digest binary, n long, s binary, t binary")
        made = made.union(found.join(asked, "digest").select("rep", "n", "s", "t"))
    # rows that repeat a document count once
    return materialise(made.groupBy("rep", F.xxhash64("s").alias("h")).agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("t").alias("t")).drop("h"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets.

    First on 16 bits of each hash, which can only find too much in common, so it loses no pair and
    moves a quarter of the bytes; then on the full hashes.
    """

    def joined(pairs: DataFrame, column: str) -> DataFrame:
        one, two = (sets.select(F.col("rep").alias(c), F.col(column).alias(v)) for c, v in (("a", "x"), ("b", "y")))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, bool)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u2"), np.frombuffer(y.as_py(), "<u2")
                seen[y] = True
                both = int(np.count_nonzero(seen[x]))
                seen[y] = False
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = joined(pairs, "t").mapInArrow(may_be, "a long, b long").distinct()
    return joined(left, "s").mapInArrow(are, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b): the smallest node that can be reached. Min-label steps with pointer jumps."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    kept = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        labels = kept.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = step.join(up, "label").select("node", "was", F.least("label", "above").alias("label"))
        old, kept = kept, materialise(step, "labels")
        discard(old)
        if kept.where("was <> label").isEmpty():
            discard(both)
            return kept.select("node", "label")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (rep, label) with the labels that ``links`` between reps join merged."""
    of = labels.select(F.col("rep").alias("r"), "label")
    joined = links.join(of.select(F.col("r").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("r").alias("b"), F.col("label").alias("lb")), "b")
    merged = components(joined.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    new = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
    return materialise(new.select("rep", F.coalesce("new", "label").alias("label")), "reps")


def _of_one_document(labels: DataFrame, signed: DataFrame, reps: DataFrame, several: DataFrame) -> DataFrame:
    """``labels`` with the reps linked that share a document of ``several`` (doc_id)."""
    shared = signed.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest")
    pairs = shared.join(shared.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    pairs = materialise(pairs.distinct(), "pairs")
    new = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(labels, "rep", "left_anti")
    return _relabel(labels.union(new.select("rep", F.col("rep").alias("label"))), pairs)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(_sign(docs, k), "signed")
    above = max(2**62, (signed.agg(F.max("doc_id")).first()[0] or 0) + 1)
    reps = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = materialise(reps.withColumn("rep", F.coalesce("rep", F.lit(above) + F.monotonically_increasing_id())), "reps")
    nameless = reps.where(F.col("rep") >= above).select("digest", "rep")
    # each row becomes 66, so the few files of short rows are dealt out first
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keys(reps.select("rep", "sig").repartition(parts, "rep"))
    # keys of several documents; written first, so that the semi-join can split a hot key's rows
    shared = materialise(keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key"), "shared")
    buckets = materialise(keyed.join(shared, "key", "left_semi"), "buckets")
    discard(shared)
    labels = materialise(buckets.select("rep", F.col("rep").alias("label")).distinct(), "labels")
    sigs = reps.select("rep", "sig")
    sets = _sets(docs, labels.select("rep"), k, None if nameless.isEmpty() else nameless)

    def mixed() -> DataFrame:
        """Rows of the buckets that hold several components, with labels."""
        rows = buckets.join(labels, "rep")
        split = materialise(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "split")
        out = materialise(rows.join(split, "key", "left_semi"), "rows")
        discard(split)
        return out

    def links(close: DataFrame) -> DataFrame:
        pairs = materialise(close, "close")
        out = materialise(_confirm(pairs, sets, percent), "links")
        discard(pairs)
        return out

    for r in range(MAX_ROUNDS):
        rows = mixed()
        rank = [F.struct(F.xxhash64(F.lit(PROPOSALS * r + i), "key", "rep").alias("h"), F.col("rep").alias("to"), F.col("label").alias("to_label")) for i in range(PROPOSALS)]
        heads = materialise(rows.groupBy("key").agg(*(F.min(x).alias(f"head{i}") for i, x in enumerate(rank))), "heads")
        other = [F.min(F.when(F.col(f"head{i}.to_label") != F.col("label"), F.col(f"head{i}"))).alias(f"head{i}") for i in range(PROPOSALS)]
        asked = rows.join(heads, "key").groupBy("rep").agg(*other).select("rep", F.explode(F.array(*(f"head{i}.to" for i in range(PROPOSALS)))).alias("to")).where("to is not null")
        new = links(_close(asked.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct(), sigs))
        labels = _relabel(labels, new)
        # go on while it pays; what is left is compared exactly below
        enough = 50 * new.count() < rows.select("rep").distinct().count()
        discard(rows, heads, new)
        if enough:
            break

    rows = mixed()
    labels = _relabel(labels, links(_between(rows, sigs, sets, percent)))
    discard(rows, buckets, sets)

    # documents with several sets, the empty one among them
    many = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("digest").alias("n"), F.count("*").alias("of"))
    several = materialise(many.where("lo <> hi or (n > 0 and n < of)").select("doc_id"), "several")
    repeated = not several.isEmpty()
    if repeated:
        labels = _of_one_document(labels, signed, reps, several)

    found = reps.join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    found = found.withColumn("component", F.when(F.col("component") < above, F.col("component")))
    out = signed.drop("sig").join(found, "digest", "left")
    component = F.coalesce("component", "doc_id")
    if repeated:
        whole = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("of_document"))
        out, component = out.join(whole, "doc_id", "left"), F.coalesce("component", "of_document", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
