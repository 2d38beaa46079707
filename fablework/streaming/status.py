"""Status events as a stream: the latest status of each task, with event times that may be ``delay`` late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame, keys: list[str], status: str, ts: str) -> DataFrame:
    """Last status by event time; for update or complete mode, or as a batch."""
    return events.groupBy(*keys).agg(F.max_by(status, ts).alias(status), F.max(ts).alias(ts))


def counts_by_window(events: DataFrame, ts: str, key: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each key by tumbling window; later events are dropped once the watermark has passed."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_tasks(requests: DataFrame, store, registry, checkpoint: str, on_event=None):
    """Start a query that takes task requests (keys of ``store``, task) in the order of arrival and runs their handlers.

    Each batch is a file of its own: a start is guarded, so a key that has a task already fails; the result is
    saved with the key, or the error with the status failed. ``on_event(keys, task, status)`` hears of each step.
    A batch that is run again after a loss finds its own start and is not run twice.
    """
    from pyspark.sql import functions as F

    from ..sources.store import KeyExists

    tell = on_event or (lambda *_: None)

    def handle(batch: DataFrame, number: int) -> None:
        keys = batch.select(*store.keys, "task").distinct()
        for (name,) in keys.select("task").distinct().orderBy("task").collect():  # as many as there are tasks
            own = keys.where(F.col("task") == name).select(store.keys)
            try:
                store.guard(own, "task")
                store.save_result(own, "started", "null")
                tell(own, name, "started")
                chunks = store.read().join(own, store.keys, "left_semi")
                done = registry.run(name, chunks).select(*store.keys, F.struct(F.lit("completed").alias("status"), F.col("result").cast("string").alias("result")).alias("task"))
                store.update(done)
                tell(own, name, "completed")
            except KeyExists:
                tell(own, name, "failed")
            except Exception as e:
                store.save_result(own, "failed", str(e)[:200])
                tell(own, name, "failed")

    return requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
