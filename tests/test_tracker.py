"""The tracker's stream, stopped and started again between batches, against the batch and a plain loop."""

from collections import Counter
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd

from fablework.streaming import tracker as T

SCHEMA = "chunk string, task string, status string, id long, at timestamp, arrived timestamp"
ARGS = {"keys": ["chunk"], "tasks": ["a", "b"], "report": "id", "at": "at", "arrived": "arrived"}
START = datetime(2024, 1, 1)


def t(minutes):
    return START + timedelta(minutes=minutes)


def fed(spark, tmp_path, batches, **options):
    known = spark.createDataFrame([("x",), ("y",)], "chunk string")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = T.track(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), known, **ARGS, **options)
        with T.rocks(spark):
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    return known, sorted(map(tuple, got.select("chunk", "task", "report", "status", "was", "elapsed", "code").collect()), key=str)


def test_tracker_over_restarts_equals_the_batch(spark, tmp_path):
    batches = [
        [("x", "a", "started", 1, t(0), t(1)), ("x", "b", "completed", 2, t(0), t(1)), ("z", "a", "started", 3, t(0), t(1)), ("x", "c", "started", 4, t(0), t(1)),
         (None, "a", "started", 5, t(0), t(1)), ("x", "a", "assigned", 6, t(0), t(1)), ("y", "a", "started", 7, None, t(2))],
        # the end came before the start of the next try; the first report comes again
        [("x", "a", "started", 9, t(20), t(31)), ("x", "a", "completed", 8, t(10.5), t(30)), ("x", "a", "started", 1, t(0), t(1)), ("y", "a", "failed", 10, t(30), t(32))],
        # arrived late, still known; a second end has no start
        [("x", "a", "failed", 11, t(50), t(33)), ("x", "a", "completed", 12, t(60), t(61)), ("x", "b", "started", 13, t(60), None), ("x", "b", "started", None, t(60), t(61)), ("x", "a", "failed", 11, t(50), t(33))],
    ]
    known, got = fed(spark, tmp_path, batches)
    rows = [r for b in batches for r in b]
    want = T.tracked(spark.createDataFrame(rows, SCHEMA), known, **ARGS)
    assert got == sorted(map(tuple, want.select("chunk", "task", "report", "status", "was", "elapsed", "code").collect()), key=str)
    by_report = {r[2]: r for r in got if r[6] == 200}
    assert by_report[8][5] == 630.0 and by_report[11][5] == 1800.0 and by_report[12][5] is None and by_report[12][4] == "failed"
    assert by_report[10][4:6] == ("started", None) and {r[2]: r[6] for r in got if r[6] != 200} == {3: 404, 4: 400, 5: 400, 6: 400, 13: 400, None: 400}
    assert sum(r[6] == 200 for r in got) == 8


def test_a_start_that_nothing_follows_expires(spark, tmp_path):
    batches = [[("x", "a", "started", 1, t(0), t(0)), ("y", "a", "started", 2, t(0), t(0))], [("y", "a", "completed", 3, t(5), t(6))], [("y", "b", "started", 4, t(300), t(300))], [("x", "a", "completed", 5, t(301), t(301))]]
    _, got = fed(spark, tmp_path, batches, keep="1 hour", delay="1 minute")
    assert ("x", "a", None, T.EXPIRED, "started", None, 200) in got
    assert ("x", "a", 5, "completed", None, None, 200) in got and ("y", "a", 3, "completed", "started", 300.0, 200) in got
    assert sum(r[3] == T.EXPIRED for r in got) == 1


def test_keys_of_one_group_expire_each_by_its_own_time(spark, tmp_path):
    batches = [[("x", "a", "started", 1, t(0), t(0)), ("y", "a", "started", 2, t(0), t(0)), ("x", "b", "completed", 6, t(0), t(0))], [("y", "a", "started", 3, t(5), t(50))],
               [("y", "b", "started", 4, t(70), t(70))], [("x", "a", "completed", 5, t(71), t(71))], [("y", "b", "failed", 7, t(100), t(130))], [("y", "b", "failed", 7, t(100), t(131))]]
    _, got = fed(spark, tmp_path, batches, keep="1 hour", delay="1 minute", groups=1)
    assert [r[:3] for r in got if r[3] == T.EXPIRED] == [("x", "a", None), ("y", "a", None)]
    assert ("x", "a", 5, "completed", None, None, 200) in got and ("y", "a", 3, "started", "started", None, 200) in got and ("y", "b", 7, "failed", "started", 1800.0, 200) in got
    assert len(got) == 9


class Handle:
    """The state of one group in memory; counts what is asked of it."""

    def __init__(self):
        self.calls, self.values, self.timers = Counter(), {}, set()

    def counted(self, name, f):
        def call(*args):
            self.calls[name] += 1
            return f(*args)

        return call

    def getValueState(self, name, schema):  # noqa: N802
        v = self.values
        return SimpleNamespace(exists=self.counted("exists", lambda: name in v), get=self.counted("get", lambda: v.get(name)), update=self.counted("update", lambda x: v.__setitem__(name, x)), clear=self.counted("clear", lambda: v.pop(name, None)))

    def getMapState(self, name, key, value):  # noqa: N802
        m = self.values.setdefault(f"map {name}", {})
        return SimpleNamespace(containsKey=self.counted("containsKey", lambda k: k in m), getValue=self.counted("getValue", m.get), updateValue=self.counted("updateValue", m.__setitem__), removeKey=self.counted("removeKey", lambda k: m.pop(k, None)))

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.calls["registerTimer"] += 1
        self.timers.add(at)


def at_watermark(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def batch(rows):
    """Rows of (key, report, status, minute) as the state gets them, in two frames."""
    frame = pd.DataFrame([(k, "a", 0, i, s, m * 60_000_000, m * 60_000_000, t(m)) for k, i, s, m in rows], columns=["key_0", "key_1", "key_group", "report_id", "status", "reported_at", "arrival", "arrival_time"])
    return [frame[::2], frame[1::2]]


def test_a_batch_asks_little_of_the_state_however_many_keys_and_reports_it_has():
    handle, tracker = Handle(), T._Tracker(["chunk"], 10**12)
    tracker.init(handle)
    for start in (0, 20):
        out = pd.concat(tracker.handleInputRows((0,), batch([(f"k{k}", k * 1000 + m, "started", m) for k in range(50) for m in range(start, start + 21)]), at_watermark(0)))
        assert len(out) == 50 * (21 if start == 0 else 20)
    assert sum(handle.calls.values()) <= 6 and handle.calls["registerTimer"] == 1


def test_a_key_with_many_reports_reads_only_the_parts_that_hold_their_ids():
    handle, tracker, seen, n = Handle(), T._Tracker(["chunk"], 60_000), set(), 0
    tracker.init(handle)
    for size in (T.HELD, 1, 5 * T.HELD, 3 * T.HELD, 2):
        ids = [i << 20 for i in range(max(0, n - 100), n + size)]
        out = pd.concat(tracker.handleInputRows((0,), batch([("hot", i, "failed", n + j) for j, i in enumerate(ids)] + [("cold", -n - 1, "started", n)]), at_watermark(0)))
        assert sorted(out["report"]) == sorted({*ids, -n - 1} - seen)
        seen |= {*ids, -n - 1}
        n += size
    handle.calls.clear()
    assert list(pd.concat(tracker.handleInputRows((0,), batch([("hot", 0, "failed", n), ("hot", n << 20, "failed", n)]), at_watermark(0)))["report"]) == [n << 20]
    assert handle.calls["getValue"] <= 2 and handle.calls["updateValue"] == 1
    # hot is reported to later than cold: it stays, and goes with all its parts when its own time has come
    out = list(tracker.handleExpiredTimer((0,), at_watermark(n * 60_000 + 60_000), None))
    assert [tuple(r) for r in pd.concat(out)[["chunk", "status", "was"]].itertuples(index=False)] == [("cold", T.EXPIRED, "started")] and handle.values["map seen"]
    assert max(handle.timers) == n * 60_000 + 60_000
    assert pd.concat(tracker.handleExpiredTimer((0,), at_watermark(n * 60_000 + 60_001), None)).empty and handle.values == {"map seen": {}}
