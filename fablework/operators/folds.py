"""Greedy folds over ordered sequences of any length: where each stretch of a sequence begins.

Units with a size are put into stretches one after the other; a stretch ends before the unit that would make
it longer than a limit, or before one that has to begin anew. Where the stretch from a unit ends depends on
that unit alone, so each unit points to the one that would begin the next stretch. The stretches of a
sequence are the path along these pointers from its first unit.

No task walks a whole path. All sequences stand one after the other and are cut into blocks of ``BLOCK`` units.
A block notes, for every unit that a stretch from the block before could leave as the first beginning, where the
path leaves the block; groups of ``FAN`` blocks do so for their first block's, and so on to the whole: an
associative scan. On the way back each group learns its entry and hands its blocks theirs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, discard

BLOCK = 65_536
FAN = 64


def numbered(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df``, written, with the dense number of each row in ``order``, from 0.

    Rows are dealt out by ranges of the order and numbered in each; a range begins with the rows of those before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before")))  # a row a partition
    met = rows.withColumn("__part", part).join(offsets, "__part")
    out = met.withColumn(name, F.col("__before") + F.col("__id") - F.shiftleft(F.col("__part"), 33)).drop("__part", "__before", "__id")
    out._folder = rows._folder
    return out


def near(units: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """``units`` with ``block``: their own, and for the first ``reach`` units of a block also the one before."""
    own, place = F.floor(F.col("pos") / block), F.col("pos") % block
    return units.withColumn("block", F.explode(F.array_compact(F.array(own, F.when((place < reach) & (own > 0), own - 1)))))


def _paths(goes: np.ndarray, exits: np.ndarray, anew: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follows all paths along ``goes`` until they leave ``len(goes)`` places, doubling their steps each round.

    ``exits`` says where a step that leaves leads to; a path has that of its last step. It counts its beginnings
    since the last at which a sequence begins (``anew``).
    """
    n, goes, exits, anew, count = len(goes), goes.copy(), exits.copy(), anew.copy(), count.copy()
    while len(at := np.flatnonzero(goes < n)):
        to = goes[at]
        goes[at], exits[at], anew[at], count[at] = goes[to], exits[to], anew[at] | anew[to], np.where(anew[to], count[to], count[at] + count[to])
    return exits, anew, count


def _block(frame: pd.DataFrame, limit: int, block: int) -> pd.DataFrame:
    """One row for a block: its pointers, where sequences begin, and the path from each possible entry."""
    frame = frame.sort_values("pos")
    number = int(frame["block"].iloc[0])
    base, pos = number * block, frame["pos"].to_numpy()
    first = int(np.searchsorted(pos, base))  # the unit before the block, if there is one, is only compared with
    size, sep, a, b = (frame[c].to_numpy() for c in ("size", "sep", "key_a", "key_b"))
    anew = np.ones(len(pos), bool)
    anew[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    breaks = anew | frame["fresh"].to_numpy(bool)
    breaks[1:] |= sep[1:] != sep[:-1]
    size, anew, breaks, pos = size[first:], anew[first:], breaks[first:], pos[first:]
    n, own = len(pos), int(np.searchsorted(pos, base + block))
    ends = np.concatenate([[0], np.cumsum(size.astype(np.int64) + 1)])
    fits = np.searchsorted(ends, ends[:-1] + limit + 1, "right") - 1
    at = np.where(breaks, np.arange(n), n)
    broken = np.minimum.accumulate(np.concatenate([at, [n]])[::-1])[::-1][1:]  # the next break after each unit
    goes = np.minimum(np.maximum(fits, np.arange(n) + 1), broken)[:own]
    # a stretch that began before has at least one character of its own
    entries = np.flatnonzero(ends[:own] <= limit + 1)
    stop = np.flatnonzero(breaks[:own])
    entries = entries[: np.searchsorted(entries, stop[0], "right")] if len(stop) else entries
    if number == 0:
        entries = entries[:1]
    out, reset, count = _paths(goes, goes, anew[:own], np.where(anew[:own], 0, 1))
    return pd.DataFrame({
        "block": [number], "goes": [goes.astype(np.int32)], "anew": [np.flatnonzero(anew[:own]).astype(np.int32)], "entries": [entries + base],
        "exits": [out[entries] + base], "resets": [reset[entries]], "counts": [count[entries]],
    })


_PATHS = "entries array<long>, exits array<long>, resets array<boolean>, counts array<long>"


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a group of blocks: the path from each entry of the first block to beyond the last."""
    frame = frame.sort_values("block")
    entries, exits, reset, count = (np.concatenate(frame[c].to_list()) for c in ("entries", "exits", "resets", "counts"))
    # an exit is an entry of the next block; those of the last block lie beyond all entries
    exits, reset, count = _paths(np.searchsorted(entries, exits), exits, reset.astype(bool), count)
    head = len(frame["entries"].iloc[0])
    return pd.DataFrame({"block": [int(frame["up"].iloc[0])], "entries": [entries[:head]], "exits": [exits[:head]], "resets": [reset[:head]], "counts": [count[:head]]})


def _handed_down(frame: pd.DataFrame) -> pd.DataFrame:
    """(block, entry, number) of the blocks of a group, whose own entry and last number are in ``entry`` and ``number``."""
    frame = frame.sort_values("block")
    entry, number = int(frame["entry"].iloc[0]), int(frame["number"].iloc[0])
    rows = []
    for block, entries, exits, resets, counts in frame[["block", "entries", "exits", "resets", "counts"]].itertuples(index=False):
        rows.append((block, entry, number))
        i = int(np.searchsorted(entries, entry))
        if i < len(entries):  # else the last stretch takes all units of the last block
            entry, number = int(exits[i]), int(counts[i]) + (0 if resets[i] else number)
    return pd.DataFrame(rows, columns=["block", "entry", "number"])


def block_size(limit: int, block: int = BLOCK) -> int:
    """Units of a block: so many that a stretch lies in two blocks at the most."""
    return max(block, 2 * (limit + 2))


def beginnings(units: DataFrame, limit: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(block, start, number, own): where stretches begin, numbered from 0 in their sequence; a written table.

    ``units`` (pos, size, sep, fresh, key_a, key_b): ``size`` and one for a separator count towards ``limit``, a unit
    begins anew after another ``sep``, if it is ``fresh`` or if the keys change. ``block`` is the block of the
    start; the first start beyond a block is given for it, too, with ``own`` false.
    """
    if limit <= 0:
        raise ValueError("the limit has to be positive")
    block = block_size(limit, block)
    last = units.agg(F.max("pos")).first()[0]
    rows = near(units, limit + 2, block)
    before = units.where((F.col("pos") % block == block - 1) & (F.col("pos") < F.lit(last))).withColumn("block", F.floor(F.col("pos") / block) + 1)
    made = rows.unionByName(before).groupBy("block").applyInPandas(lambda f: _block(f, limit, block), f"block long, goes array<int>, anew array<int>, {_PATHS}")
    levels, blocks = [cut(made)], (last or 0) // block + 1
    grouped = lambda level: level.select("block", "entries", "exits", "resets", "counts").withColumn("up", F.floor(F.col("block") / fan))
    while blocks > 1:
        levels.append(cut(grouped(levels[-1]).groupBy("up").applyInPandas(_joined, f"block long, {_PATHS}")))
        blocks = (blocks - 1) // fan + 1
    known = levels[-1].select("block", F.lit(0).cast("long").alias("entry"), F.lit(-1).cast("long").alias("number"))
    for level in levels[-2::-1]:
        met = grouped(level).join(known.withColumnRenamed("block", "up"), "up")
        known = met.groupBy("up").applyInPandas(_handed_down, "block long, entry long, number long")

    def walked(frames):
        for frame in frames:
            for number, goes, anew, entry, latest in frame[["block", "goes", "anew", "entry", "number"]].itertuples(index=False):
                base, at, begins, starts, numbers = number * block, entry - number * block, set(anew.tolist()), [], []
                while at < len(goes):
                    latest = 0 if at in begins else latest + 1
                    starts.append(at + base)
                    numbers.append(latest)
                    at = int(goes[at])
                yield pd.DataFrame({"block": number, "start": [*starts, at + base], "number": [*numbers, -1], "own": [True] * len(starts) + [False]})

    walks = levels[0].select("block", "goes", "anew").join(known, "block")
    out = cut(walks.mapInPandas(walked, "block long, start long, number long, own boolean"))
    discard(*levels)
    return out
