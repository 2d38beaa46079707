"""The status tracker as a stream: each key's task keeps its last status between batches, in the order of arrival.

Reports that lack a field or name an unknown task or status have code 400, those of unknown keys 404. Accepted ones
(200) go to the state of their key and task: the last status and when it was reported. A report that ends a
task whose last status is a start has the seconds since. A report that comes again, by its id, changes
nothing and leaves no row. Late reports count when they arrive, and by their own times; the watermark is one of
arrival, so only what the source hands on out of order by more than ``delay`` is dropped.

State that nothing has been reported to for ``keep`` is dropped by a timer of event time; a task that had started
and not ended by then leaves a row with the status ``expired`` and no id.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tracking import REPORTED, checked

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRED = "expired"
#: Groups that the keys are dealt to; a group's state is read and written at once.
GROUPS = 1024
#: Ids of reports that a key has in its group's value; of more, each value of the map has so many on average at most.
HELD = 1024
#: Stands for no time of a report, so that the column stays one of longs.
MISSING = -(2**63)
#: Rows of a frame that is handed back.
ROWS = 10_000


def _bits(n: int) -> int:
    """``n`` ids of a key are held in 2 ** bits parts."""
    return (max(n - 1, 0) // HELD).bit_length()


def _part(report: int, bits: int) -> int:
    """The part of an id, by the first bits of a product that spreads the ids."""
    return (report * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)


class _Seen:
    """The ids of a key's reports: up to HELD in the group's value, of more only those parts are read that are asked for."""

    def __init__(self, key: tuple, n: int, ids: bytes, states) -> None:
        self.n, self.states, self.owner, self.bits, self.changed = n, states, pickle.dumps(key), _bits(n), set()
        self.parts = {} if self.bits else {0: set(array("q", ids))}

    def _read(self, part: int) -> set[int]:
        if part not in self.parts:
            held = self.states.getValue((self.owner, part))
            self.parts[part] = set(array("q", bytes(held[0]))) if held else set()
        return self.parts[part]

    def add(self, report: int) -> bool:
        """Whether the id is new."""
        part = _part(report, self.bits) if self.bits else 0
        ids = self._read(part)
        if report in ids:
            return False
        ids.add(report)
        self.changed.add(part)
        self.n += 1
        return True

    def write(self) -> bytes:
        """What belongs into the group's value; the rest goes to the map, dealt anew if there are more parts than before."""
        bits = _bits(self.n)
        if not bits:
            return array("q", self.parts[0]).tobytes()
        if bits > self.bits:
            dealt: list[set[int]] = [set() for _ in range(2**bits)]
            for part in range(2**self.bits):
                for report in self._read(part):
                    dealt[_part(report, bits)].add(report)
            self.parts = dict(enumerate(dealt))
            self.changed = set(self.parts)
        for part in self.changed:
            self.states.updateValue((self.owner, part), (array("q", self.parts[part]).tobytes(),))
        return b""

    def clear(self) -> None:
        for part in range(2**self.bits if self.bits else 0):
            self.states.removeKey((self.owner, part))


class _Tracker(StatefulProcessor):
    """The state of a group of keys. Each call to the state is a message to the JVM and each call of a method makes
    frames, so both are made for a group, not for a key; all that is decided goes by the key.

    ``held`` is the last status, its time, when it expires, the count of ids and the ids by key; ``timer`` the next timer.
    """

    def __init__(self, keys: list[str], keep_ms: int) -> None:
        self.keys, self.keep_ms = keys, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "timer long, held binary")
        self.seen = handle.getMapState("seen", "owner binary, part int", "ids binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["arrival", "report_id"])
        timer, held = self._held()
        now: dict[tuple, list] = {}
        out = []
        owners = zip(*(self._column(frame[f"key_{i}"]) for i in range(len(self.keys) + 1)), strict=True)
        for owner, report, status, at, arrival in zip(owners, *(frame[c].tolist() for c in ("report_id", "status", "reported_at", "arrival")), strict=True):
            task = now.get(owner)
            if task is None:
                was, since, _, n, ids = held.get(owner, (None, MISSING, 0, 0, b""))
                task = now[owner] = [was, since, arrival, _Seen(owner, n, ids, self.seen)]
            task[2] = arrival
            if not task[3].add(report):
                continue
            was, since = task[0], task[1]
            ended = was == "started" and status in ("completed", "failed") and since != MISSING and at != MISSING
            out.append((*owner, report, status, was, (at - since) / 1e6 if ended else None))
            task[0], task[1] = status, at
            if len(out) >= ROWS:
                yield self._rows(out)
                out = []
        mark = timerValues.getCurrentWatermarkInMs()
        for owner, (was, since, arrival, seen) in now.items():
            ids = seen.write()
            held[owner] = (was, since, max(arrival // 1000, mark) + self.keep_ms, seen.n, ids)
        self._keep(timer, held, min(held[owner][2] for owner in now))
        yield self._rows(out)

    def _column(self, keys: pd.Series) -> list:
        # as keys of a dict, NaNs would all differ; they come out as null
        return [None if k != k else k for k in keys.tolist()] if keys.dtype.kind == "f" else keys.tolist()

    def _held(self) -> tuple[int | None, dict[tuple, tuple]]:
        timer, held = self.group.get() or (None, None)
        return timer, pickle.loads(bytes(held)) if held else {}

    def _keep(self, timer: int | None, held: dict[tuple, tuple], due: int) -> None:
        """Writes the group; a timer is registered unless an earlier one is, which will look after the later ones."""
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.group.update((timer, pickle.dumps(held)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, held = self._held()
        gone = [owner for owner, task in held.items() if task[2] < timerValues.getCurrentWatermarkInMs()]
        out = []
        for owner in gone:
            was, _, _, n, ids = held.pop(owner)
            _Seen(owner, n, ids, self.seen).clear()
            if was == "started":
                out.append((*owner, None, EXPIRED, was, None))
        if held:
            self._keep(None, held, min(task[2] for task in held.values()))
        else:
            self.group.clear()
        yield self._rows(out)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=[*self.keys, "task", "report", "status", "was", "elapsed"])
        return made.astype({"report": "Int64", "elapsed": "Float64"})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers asks for this store when a query starts; the session's setting is restored."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _whole(reports: DataFrame, report: str, arrived: str) -> DataFrame:
    """A report without an id or a time of arrival lacks a field as well: it has no status."""
    return reports.withColumn("status", F.when(F.col(report).isNotNull() & F.col(arrived).isNotNull(), F.col("status")))


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def track(reports: DataFrame, known: DataFrame, keys: list[str], tasks: list[str], report: str, at: str, arrived: str, keep: str = "30 days", delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """A stream of (keys, task, report, status, code, was, elapsed): a row for each report, for append mode.

    ``reports`` is a stream of keys, task, status, the id ``report`` and the times ``at`` and ``arrived``; ``known`` a
    table of the keys that exist. Start the query in ``rocks``. The state is held by ``groups`` groups of keys, fixed for a
    checkpoint: a batch rewrites the state of all groups that it has a key of, so very many keys ask for more groups.
    """
    judged = checked(_whole(reports, report, arrived), known, keys, tasks, REPORTED)
    owner = [*keys, "task"]
    good = judged.where("code = 200").select(
        *(F.col(k).alias(f"key_{i}") for i, k in enumerate(owner)), F.pmod(F.xxhash64(*owner), F.lit(groups)).cast("int").alias("key_group"),
        F.col(report).cast("long").alias("report_id"), "status", F.coalesce(_micros(at), F.lit(MISSING)).alias("reported_at"), _micros(arrived).alias("arrival"), F.col(arrived).cast("timestamp").alias("arrival_time"))
    good = good.withWatermark("arrival_time", delay)
    kinds = dict(reports.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "task string, report long, status string, was string, elapsed double"])
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    kept = good.groupBy("key_group").transformWithStateInPandas(_Tracker(keys, keep_ms), schema, "Append", "EventTime").withColumn("code", F.lit(200))
    bad = judged.where("code <> 200").select(*keys, "task", F.col(report).cast("long").alias("report"), "status", F.lit(None).cast("string").alias("was"), F.lit(None).cast("double").alias("elapsed"), "code")
    return kept.unionByName(bad)


def tracked(reports: DataFrame, known: DataFrame, keys: list[str], tasks: list[str], report: str, at: str, arrived: str) -> DataFrame:
    """What ``track`` gives for a table of reports that all have arrived in order, without expiry."""
    judged = checked(_whole(reports, report, arrived), known, keys, tasks, REPORTED)
    first = F.row_number().over(Window.partitionBy(*keys, "task", report).orderBy(arrived)) == 1
    good = judged.where("code = 200").withColumn("__first", first).where("__first")
    by = Window.partitionBy(*keys, "task").orderBy(arrived, report)
    good = good.withColumns({"was": F.lag("status").over(by), "took": (_micros(at) - F.lag(_micros(at)).over(by)) / F.lit(1e6)})
    ended = (F.col("was") == "started") & F.col("status").isin("completed", "failed")
    rows = lambda df, was, took: df.select(*keys, "task", F.col(report).cast("long").alias("report"), "status", was.alias("was"), took.cast("double").alias("elapsed"), "code")
    return rows(good, F.col("was"), F.when(ended, F.col("took"))).unionByName(rows(judged.where("code <> 200"), F.lit(None).cast("string"), F.lit(None)))
