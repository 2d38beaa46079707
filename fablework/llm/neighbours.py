"""Nearest neighbours by a block matrix product.

Vectors are packed into blocks, which are dealt to a fixed number of parts; queries are dealt to groups that a task can
hold. Every group meets every part: a task takes its group, then the part's blocks one after the other, each sent to it
once. So nothing is broadcast, and queries are sent as often as there are parts, not blocks. In a tile, vectors
are rounded to int8 with a scale each; the tile's int8 products give every distance within the two
rounding errors. Pairs whose lower bound does not exceed the tenth best upper bound (or the tenth
best distance found before) are recomputed in double precision on the original vectors. A task keeps
bounded heaps; what the parts found is ranked by a window at the end. The result is exact.

Defined results: vectors that are null, empty, all zero or hold a null, NaN or infinity take no part,
nor do rows without an id. Vectors of another length are no candidates. A query's own row is left
out, a repeat of that row is not. Ties go to the smaller id. Fewer candidates than ``k`` give fewer
rows; no queries give none. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialise, table

K = 10
EVERY = 100
CANDIDATES_A_BLOCK = 8192
QUERIES_A_BLOCK = 256
PAIRS_AT_ONCE = 50_000
#: Components of a group of queries, which a task holds, and at most of a block.
HELD = 2**20
#: Parts of the candidates for each core.
PARTS = 4


def _blocks(kind: str):
    """Rows packed into blocks of one length of vectors: queries (side 0) and all rows (side 1), numbered on from the task's number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        made = [0, 0]

        def block(side: int, g: pd.DataFrame) -> tuple:
            made[side] += 1
            return side, g.dim.iloc[0], (g.uid.iloc[0] >> 33) + made[side], len(g), g.uid.to_numpy("<i8").tobytes(), g.id.to_numpy("<i8").tobytes(), np.stack(g.vec.to_list()).astype(kind).tobytes()

        def packed(dim: int, rest: bool) -> Iterator[tuple]:
            rows, size = pd.concat(held.pop(dim)), max(1, min(CANDIDATES_A_BLOCK, HELD // dim))
            whole = len(rows) if rest else len(rows) // size * size
            for i in range(0, whole, size):
                some = rows.iloc[i : i + size]
                yield block(1, some)
                asked = some[some.asked]
                for j in range(0, len(asked), QUERIES_A_BLOCK):
                    yield block(0, asked.iloc[j : j + QUERIES_A_BLOCK])
            if whole < len(rows):
                held[dim] = [rows.iloc[whole:]]

        def frame_of(dims: list[int], rest: bool) -> pd.DataFrame:
            return pd.DataFrame([b for dim in dims for b in packed(dim, rest)], columns=["side", "dim", "seq", "n", "uids", "ids", "vecs"])

        for frame in frames:
            for dim, g in frame.groupby("dim"):
                held.setdefault(dim, []).append(g)
                if sum(map(len, held[dim])) >= min(CANDIDATES_A_BLOCK, HELD // dim):
                    yield frame_of([dim], False)
            if sum(dim * len(g) for dim, gs in held.items() for g in gs) > 4 * HELD:
                yield frame_of(list(held), True)
        yield frame_of(list(held), True)

    return run


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale of each, norm of the rounded row, rounding error)."""
    scale = np.abs(x).max(1) / 127
    whole = np.rint(x / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.sqrt((back * back).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows; components are added in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - y[:, j]) ** 2
    return np.sqrt(total)


def tile(qu: np.ndarray, qx: np.ndarray, q: tuple, cu: np.ndarray, cid: np.ndarray, cx: np.ndarray, c: tuple, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, distance) of all pairs that may be among a query's ``k`` nearest.

    ``q`` and ``c``: both sides ``_rounded``. ``reach``: the distance of each query's k-th best so far, or infinity.
    """
    (a, sa, na, ea), (b, sb, nb, eb) = q, c
    with np.errstate(all="ignore"):
        kind = np.float32 if qx.shape[1] <= 1000 else np.float64  # sums of int8 products are exact in it
        dots = a.astype(kind) @ b.astype(kind).T
        near = (na * na)[:, None] + (nb * nb)[None, :] - 2 * (sa[:, None] * sb[None, :]) * dots
        near = np.sqrt(np.maximum(near, 0))
        error = (ea + 1e-6 * na)[:, None] + (eb + 1e-6 * nb)[None, :]
        own = qu[:, None] == cu[None, :]
        upper = np.where(own, np.inf, near + error)
        if upper.shape[1] > k:
            reach = np.fmin(reach, np.partition(upper, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero(~(near - error > reach[:, None]) & ~own)
        dist = np.concatenate([exact(qx[rows[i : i + PAIRS_AT_ONCE]], cx[cols[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(rows), PAIRS_AT_ONCE)] or [np.zeros(0)])
    order = np.lexsort((cid[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return rows[keep], cols[keep], dist[keep]


def _search(k: int, kind: str):
    """Over rows in the order of their cell, queries first: each query's ``k`` nearest of the cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["q_uid", "query_id", "vec_id", "score"]
        cell, asked, queries, heaps = None, [], None, []  # a heap of (-distance, -id) for each query

        def found() -> pd.DataFrame:
            return pd.DataFrame([(u, i, -e[1], -e[0]) for u, i, h in zip(*queries[:2], heaps, strict=True) for e in h] if queries else [], columns=columns)

        for frame in frames:
            for r in frame.itertuples(index=False):
                if (key := (r.dim, r.group, r.part)) != cell:
                    yield found()
                    cell, asked, queries, heaps = key, [], None, []
                block = np.frombuffer(r.uids, "<i8"), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vecs, kind).reshape(-1, r.dim).astype(float)
                if r.side == 0:
                    asked.append(block)
                    continue
                if not asked:
                    continue
                if queries is None:
                    uids, ids, qx = (np.concatenate(x) for x in zip(*asked, strict=True))
                    with np.errstate(all="ignore"):
                        queries = uids, ids, qx, _rounded(qx)
                    heaps = [[] for _ in uids]
                uids, _, qx, q = queries
                cu, cid, cx = block
                with np.errstate(all="ignore"):
                    c = _rounded(cx)
                for i in range(0, len(uids), QUERIES_A_BLOCK):
                    at = slice(i, i + QUERIES_A_BLOCK)
                    reach = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps[at]])
                    rows, cols, dist = tile(uids[at], qx[at], tuple(x[at] for x in q), cu, cid, cx, c, reach, k)
                    for row, v, d in zip(rows.tolist(), cid[cols].tolist(), dist.tolist(), strict=True):
                        if len(h := heaps[i + row]) < k:
                            heapq.heappush(h, (-d, -v))
                        elif (-d, -v) > h[0]:
                            heapq.heapreplace(h, (-d, -v))
        yield found()

    return run


def usable(vec: Column) -> Column:
    big = F.lit(float("inf"))
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows to each row for which ``is_query`` (a condition on ``id``) holds."""
    single = isinstance(vectors.select(vec_col).schema[0].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & usable(F.col("vec")))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.size("vec").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asked"), "vec")
    blocks = materialise(rows.mapInPandas(_blocks(kind), "side int, dim int, seq long, n long, uids binary, ids binary, vecs binary"), "blocks")
    counted = blocks.agg(F.count_if(F.col("side") == 1).alias("n"), F.sum(F.when(F.col("side") == 0, F.col("n") * F.col("dim"))).alias("q")).first()
    groups = max(1, -(-(counted["q"] or 0) // HELD))
    parts = max(1, min(counted["n"], PARTS * vectors.sparkSession.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda n: F.pmod("seq", F.lit(n)).cast("int")
    queries = blocks.where("side = 0").select("*", number(groups).alias("group"), every(parts).alias("part"))
    candidates = blocks.where("side = 1").select("*", every(groups).alias("group"), number(parts).alias("part"))
    cells = queries.unionByName(candidates).repartition(parts * groups, "dim", "group", "part").sortWithinPartitions("dim", "group", "part", "side")
    found = cells.mapInPandas(_search(k, kind), "q_uid long, query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("q_uid").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.rn <> c.rn AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op3_neighbours": op3_neighbours}
ORACLES = {"op3_neighbours": ORACLE}
