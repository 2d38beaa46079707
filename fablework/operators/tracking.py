"""Task status and timing views over append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import numbered


def latest(events: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """Last status of each key by arrival."""
    return events.groupBy(*keys).agg(F.max_by(status, order).alias(status))


def progress(states: DataFrame, key: str, done: Column) -> DataFrame:
    """(key, completed, total, percent)."""
    p = states.groupBy(key).agg(F.count_if(done).alias("completed"), F.count("*").alias("total"))
    return p.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("completed") / F.col("total")).otherwise(0.0))


def gate(states: DataFrame, key: str, done: Column, failed: Column) -> DataFrame:
    """(key, all_done, any_failed)."""
    return states.groupBy(key).agg(F.coalesce(F.bool_and(done), F.lit(False)).alias("all_done"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("any_failed"))


def timing_summary(log: DataFrame, function: str = "function", elapsed: str = "elapsed") -> DataFrame:
    e = F.col(elapsed)
    return log.groupBy(function).agg(F.count("*").alias("calls"), F.sum(e).alias("total"), F.avg(e).alias("avg"), F.min(e).alias("min"), F.max(e).alias("max"))


def quantile(log: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, quantile) of the values that are not null, between two of them by their distance; exact.

    Rows get their number in the order of group and value by ranges (``folds.numbered``), so no buffer holds a group.
    """
    rows = numbered(log.select(group, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL"), [group, "__v"], "__at")
    groups = rows.groupBy(group).agg(F.min("__at").alias("__first"), ((F.count("*") - 1) * F.lit(q)).alias("__place"))
    place, at = F.col("__place"), F.col("__at") - F.col("__first")
    # the two values around the place, each by its nearness; one that lies on it counts whole
    weight = F.greatest(1 - F.abs(at - place), F.lit(0.0))
    met = rows.join(groups.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).where(weight > 0)
    return met.groupBy(group).agg(F.sum(F.col("__v") * weight).alias("quantile"))


def mean_of_means(log: DataFrame, run: str, function: str, elapsed: str) -> DataFrame:
    return log.groupBy(run, function).agg(F.avg(elapsed).alias("m")).groupBy(function).agg(F.avg("m").alias("avg"))


def parse_status(status: Column) -> Column:
    """``word, value`` as (status, value)."""
    return F.struct(F.split_part(status, F.lit(", "), F.lit(1)).alias("status"), F.nullif(F.split_part(status, F.lit(", "), F.lit(2)), F.lit("")).alias("value"))


def transitions(events: DataFrame, keys: list[str], status: str, order: list[str], ts: str) -> DataFrame:
    """Adds ``elapsed``: seconds from the last start to a completion or failure; null without a start and elsewhere."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col(status) == "started", F.unix_micros(F.col(ts).cast("timestamp"))), ignorenulls=True).over(before)
    took = (F.unix_micros(F.col(ts).cast("timestamp")) - began) / F.lit(1e6)
    return events.withColumn("elapsed", F.when(F.col(status).isin("completed", "failed"), took))


def clear_share(notes: DataFrame, keys: list[str], questions: str, types: str) -> DataFrame:
    """(keys, score): the share of sentences whose annotation has neither questions nor types."""
    confusing = (F.coalesce(F.size(questions), F.lit(0)) > 0) | (F.coalesce(F.size(types), F.lit(0)) > 0)
    return notes.groupBy(*keys).agg(F.coalesce(1 - F.avg(confusing.cast("double")), F.lit(0.0)).alias("score"))


#: Statuses of a task, and those that a worker may report.
PENDING, STATUSES, REPORTED = "pending", ("pending", "assigned", "started", "completed", "failed"), ("started", "completed", "failed")


def encode_status(status: Column, value: Column) -> Column:
    """``word, value``; the word alone without a value."""
    return F.concat_ws(", ", status, value)


def is_status(column: Column, word: str) -> Column:
    return F.coalesce(F.contains(column, F.lit(word)), F.lit(False))


def overlay(table: DataFrame, events: DataFrame, keys: list[str], tasks: list[str], order: str = "ts") -> DataFrame:
    """A row a key with a column a task: the last status that ``events`` (keys, task, status, ts) give, else the old one.

    A key that is new has ``pending`` in its other tasks. A start is kept with its time. Only known tasks count.
    """
    said = encode_status(F.col("status"), F.when(F.col("status") == "started", F.date_format(order, "yyyy-MM-dd'T'HH:mm:ss")))
    last = events.where(F.col("task").isin(tasks)).groupBy(*keys).pivot("task", tasks).agg(F.max_by(said, order))
    met = table.join(last.select(*keys, *(F.col(f"`{t}`").alias(f"__{t}") for t in tasks)), keys, "full")
    return met.select(*keys, *(F.coalesce(f"__{t}", f"`{t}`", F.lit(PENDING)).alias(t) for t in tasks))


def checked(events: DataFrame, known: DataFrame, keys: list[str], tasks: list[str], statuses: tuple = REPORTED) -> DataFrame:
    """``events`` with ``code``: 400 for a missing field, task or status that does not exist, 404 for an unknown key, else 200."""
    missing = F.lit(False)
    for c in (*keys, "task", "status"):
        missing = missing | F.col(c).isNull()
    bad = missing | ~F.col("task").isin(tasks) | ~F.col("status").isin(*statuses)
    met = events.join(known.select(keys).distinct().withColumn("__known", F.lit(True)), keys, "left")
    return met.withColumn("code", F.when(bad, 400).when(F.col("__known").isNull(), 404).otherwise(200)).drop("__known")


def assigned(chunks: DataFrame, keys: list[str], task: str, ts: Column) -> DataFrame:
    """The events that hand every chunk's task out: (keys, task, status, ts)."""
    return chunks.select(*keys).distinct().select(*keys, F.lit(task).alias("task"), F.lit("assigned").alias("status"), ts.alias("ts"))


def answers(sent: DataFrame, keys: list[str], task: str, ts: Column, code: str = "code") -> DataFrame:
    """Failed events of the requests that were not accepted (202)."""
    lost = sent.where(F.coalesce(F.col(code) != 202, F.lit(True)))
    return lost.select(*keys, F.lit(task).alias("task"), F.lit("failed").alias("status"), ts.alias("ts"))


def accuracy(items: DataFrame, keys: list[str] = (), accuracy: str = "accuracy", correct: str = "is_correct") -> DataFrame:
    """(keys, score): mean of the accuracy, or where that is null of 1 for a correct answer and 0 for others; no items give 0."""
    one = F.coalesce(F.col(accuracy), F.when(F.col(correct), 1.0).otherwise(0.0))
    return items.groupBy(*keys).agg(F.coalesce(F.avg(one), F.lit(0.0)).alias("score"))


def sample(df: DataFrame, n: int, order: list[str], seed: int = 0) -> DataFrame:
    """``n`` distinct rows, each as likely as any other, the same for a seed: those with the least hash of ``order``."""
    h = F.xxhash64(F.lit(seed), *order)
    return df.withColumn("__h", h).orderBy("__h", *order).limit(n).drop("__h")


def display(df: DataFrame, rows: int = 20, width: int = 40) -> DataFrame:
    """The first ``rows`` in natural order, every cell as text of at most ``width`` characters."""
    from .documents import natural_sort

    cell = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
    return natural_sort(df).limit(rows).select(*(cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns))


def chart(values: DataFrame, label: str, value: str, cap: Column | None = None, top: int = 50, width: int = 600) -> DataFrame:
    """One row, ``svg``: a bar chart of the ``top`` rows with the greatest values, as long as ``cap`` or the greatest at most."""
    row, gap = 20, 200
    kept = values.where(F.col(value).isNotNull()).orderBy(F.desc(value), label).limit(top)
    most = F.greatest(F.max(value).over(Window.partitionBy()) if cap is None else cap, F.lit(1e-9))  # of ``top`` rows
    bar = F.round(F.least(F.col(value) / most, F.lit(1.0)) * width).cast("int").cast("string")
    name = F.replace(F.replace(F.col(label).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    bars = kept.select(F.col(value).alias("v"), name.alias("name"), bar.alias("bar"))
    y = lambda i, more: ((i * row) + more).cast("string")
    line = lambda x, i: F.concat(
        F.lit('<text x="0" y="'), y(i, 14), F.lit('">'), x["name"], F.lit(f'</text><rect x="{gap}" y="'), y(i, 2), F.lit('" width="'), x["bar"], F.lit('" height="16"/>'))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("v"), "name", "bar")))
    size = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{gap + width}" height="'), (F.count("*") * row).cast("string"), F.lit('">'))
    return bars.agg(F.concat(size, F.array_join(F.transform(listed, line), ""), F.lit("</svg>")).alias("svg"))
