"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. The rates of its documents are the ones nearest to 1
(in relative entropy, at most ``MAX_COPIES``) whose words add up to the target:
``min(2, exp(lambda * size / mean size))``, with one dual variable a source. Safeguarded Newton
steps on the convex dual find it; each step is one aggregation of the (source, size) histogram, and
``STEPS_A_JOB`` of them are one job, as their state, a row a source, flows from one to the next.

Rates become copies: every document gets the whole part of its rate, and one more if its key
``u - fraction`` (``u``: a hash of the document) lies below the source's threshold. Thresholds are
found by histograms of the keys, so the words taken differ from the target by about one document;
a last pass fills that gap with documents small enough.

``u`` hashes the row's id, source and text. Rows equal in all three are numbered, and the number enters
``u``, so that such rows are rounded apart; which of them has which number may differ between runs, but
as they are equal the result does not.

Defined results: null text has size 0; documents of size 0 take 0 words. The null source is a
source, the last. A source without words has target 0. Without documents the result is empty. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise, small, table

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_COPIES = 2
BINS = 4096
FILLS = 3
#: Halving alone has a bracket of doubles closed long before; more is an error.
MAX_STEPS = 600
STEPS_A_JOB = 4
TOLERANCE = 1e-9


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, same): size in words; ``same`` is equal for rows of equal id, source and text."""
    return docs.select(F.col(id_col).alias("doc_id"), *_sizes(id_col, text_col, source_col))


def _sizes(id_col: str, text_col: str, source_col: str) -> list[Column]:
    # a null does not change a hash, so a literal between two columns keeps their nulls apart
    same = F.xxhash64(F.lit("mix"), F.col(id_col), F.lit(0), F.col(source_col), F.lit(1), F.col(text_col))
    return [F.col(source_col).alias("source"), size_of(text_col).alias("size"), same.alias("same")]


def size_of(text_col: str) -> Column:
    """Number of words; null text has none."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` with ``u``, a number in [0, 1) from ``same`` and, among rows of equal ``same``, their number.

    Rows that stand alone need no number. The others are numbered within the partitions that they lie in,
    after those of the partitions before, so a large group is many tasks' work.
    """
    unit = lambda number: F.shiftrightunsigned(F.xxhash64("same", number), 11) / F.lit(float(2**53))
    several = materialise(docs.groupBy("same").count().where("count > 1").select("same"), "several")
    if several.isEmpty():
        return docs.withColumn("u", unit(F.lit(0)))
    several = small(several)
    rows = materialise(docs.withColumn("__part", F.spark_partition_id()).join(several, "same", "left_semi"), "repeated")
    counts = rows.groupBy("same", "__part").count()
    before = Window.partitionBy("same").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("same", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("same", "__part").orderBy(F.lit(0)))
    rows = rows.withColumn("__place", place).join(small(counts), ["same", "__part"])
    rows = materialise(rows.withColumn("u", unit(F.col("__before") + F.col("__place"))).select(*docs.columns, "u"), "numbered")
    return docs.join(several, "same", "left_anti").withColumn("u", unit(F.lit(0))).select(rows.columns).unionByName(rows)


def targets(hist: DataFrame, weights: tuple = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) by water filling; one row a source.

    A source is capped if its cap a weight lies below the final level; sources are taken in the
    order of cap a weight, and those before the first that the level no longer exceeds are capped.
    """
    s = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(every) * percent / 100.0, "all_weight": F.sum("weight").over(every)})
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    # the level if this source is the first without a cap; the first such source sets it for all
    s = s.withColumn("open_level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
    s = s.withColumn("final_level", F.min_by("open_level", F.when(F.col("open_level").isNotNull(), F.col("cap") / F.col("weight"))).over(every))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(lam, z, most=MAX_COPIES):
    return F.least(F.lit(float(most)), F.exp(F.least(lam * z, F.lit(50.0))))


def duals(hist: DataFrame, goals: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Solve each source's dual: adds (mean, lam, full) to ``goals``. ``full``: the target is all copies allowed.

    Newton steps kept inside a bracket, by doubling and halving where it has no finite side yet or
    a step would leave it. The driver sees one number a job.
    """
    mean = hist.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(mean.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    state = state.withColumns({
        "full": F.col("target") >= most * F.col("source_size") * (1 - 1e-12), "lam": F.lit(0.0),
        "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "gap": F.lit(None).cast("double"),
    })
    state = materialise(state, "state")
    few = _few(state)
    for _ in range(MAX_STEPS // STEPS_A_JOB):
        step = state
        for _ in range(STEPS_A_JOB):
            step = _newton(hist, step, most, few)
        old, state = state, materialise(step, "state")
        discard(old)
        worst = state.agg(F.max(F.abs(F.col("gap")) / F.greatest(F.col("target"), F.lit(1.0)))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise ArithmeticError(f"a source's words are still {worst:.3g} from its target after {MAX_STEPS} steps")
    # sums of doubles depend on the order of rows in their last bits; without these, reruns agree
    return state.withColumn("lam", F.round("lam", 9)).drop("lo", "hi", "gap")


def _few(sources: DataFrame):
    """A broadcast hint for frames of a row a source, if these have been counted to be few."""
    return F.broadcast if sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda d: d


def _newton(hist: DataFrame, state: DataFrame, most: int, few) -> DataFrame:
    """One step: the state travels with the sums over the histogram, so each step reads its predecessor once."""
    names = [c for c in state.columns if c != "source"]
    met = hist.join(few(state.withColumnRenamed("source", "__s")), hist.source.eqNullSafe(F.col("__s")))  # every source has sizes
    z, words, live = F.col("size") / F.col("mean"), F.col("size") * F.col("n"), ~F.col("full") & (F.col("source_size") > 0)
    rate = _rate(F.col("lam"), z, most)
    step = met.groupBy("__s").agg(
        *(F.first(c).alias(c) for c in names),
        F.sum(F.when(live, words * rate)).alias("f"), F.sum(F.when(live, F.when(rate < most, words * rate * z).otherwise(0.0))).alias("slope"),
    ).withColumnRenamed("__s", "source")
    gap = F.col("f") - F.col("target")
    step = step.withColumns({"gap": gap, "lo": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))})
    newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
    wide = F.greatest(F.abs(F.col("lam")), F.lit(0.5))
    inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton - F.col("lam")) <= 2 * wide)
    safe = (F.when(F.col("lo").isNull(), F.col("hi") - 2 * wide).when(F.col("hi").isNull(), F.col("lo") + 2 * wide)
            .otherwise((F.col("lo") + F.col("hi")) / 2))
    near = F.abs(F.col("gap")) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
    step = step.withColumn("lam", F.when(F.col("gap").isNull() | near, F.col("lam")).when(inside, newton).otherwise(safe))
    return step.select("source", *names)


def _threshold(keyed: DataFrame, need: DataFrame, column: str, low: str, width: str) -> DataFrame:
    """Per source, the bin of ``column`` where the running words pass ``need``: (source, bin, left over before it).

    Bins are partial sums: at most ``BINS`` rows a source leave the tasks.
    """
    b = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(column) - F.expr(low)) / F.expr(width) * BINS))).cast("int")
    bins = keyed.withColumn("bin", b).groupBy("source", "bin").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("upto", run).join(need.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # the last bin that still fits; the next one is cut finer
    return bins.where("upto <= need").groupBy("source").agg(F.max("bin").alias("bin"), F.max("upto").alias("used"))


def _keyed(docs: DataFrame, params: DataFrame, few, most: int = MAX_COPIES) -> DataFrame:
    """``docs`` (with source, size, u) joined with its source's parameters; adds whole and key (null: nothing to round)."""
    d = docs.join(few(params.withColumnRenamed("source", "__s")), docs.source.eqNullSafe(F.col("__s")), "left").drop("__s")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), most))
    d = d.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    return d.withColumn("key", F.when(F.col("rate") > F.col("whole"), F.col("u") - (F.col("rate") - F.col("whole")))).drop("rate")


def _ups(fills: int) -> Column:
    """Whether a document gets one more than the whole part of its rate, from its row and its source's parameters."""
    ups = F.col("key") < F.col("theta")
    for k in range(fills):
        ups = ups | ((F.col("size") <= F.col(f"room{k}")) & (F.least(F.lit(BINS - 1), F.floor(F.col("u") * BINS)) < F.col(f"fill{k}")))
    return F.coalesce(F.col("key").isNotNull() & ups, F.lit(False))


def solve(docs: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """One row of parameters a source, from ``docs`` with source, size and ``u`` (materialised)."""
    hist = materialise(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    params = duals(hist, targets(hist))
    few = _few(params)
    keyed = materialise(_keyed(docs, params, few).select("source", "size", "u", "whole", "key", "target"), "keyed")
    base = keyed.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("whole"))).alias("need"))
    rows = keyed.where("key is not null").drop("whole", "target")

    def found(of_rows: DataFrame, state: DataFrame, need: str, column: str, low: str, width: str) -> DataFrame:
        """``state`` with the bin (0: none) after the last that fits into ``need``, and what is left of it."""
        t = _threshold(of_rows, state.select("source", F.col(need).alias("need")), column, low, width).withColumnRenamed("source", "__s")
        met = state.join(t, state.source.eqNullSafe(F.col("__s")), "left")
        return met.select(*state.columns, (F.coalesce("bin", F.lit(-1)) + 1).alias("cut"), (F.col(need) - F.coalesce("used", F.lit(0))).alias("rest"))

    def of(state: DataFrame) -> DataFrame:
        return rows.join(few(state.withColumnRenamed("source", "__s")), rows.source.eqNullSafe(F.col("__s"))).drop("__s")

    state = found(rows, base, "need", "key", "-1.0", "2.0")
    cut = state = materialise(state.select("source", "rest", (F.lit(-1.0) + F.col("cut") * (2.0 / BINS)).alias("at")), "cut")
    inside = of(state).where(f"key >= at and key < at + {2.0 / BINS}")
    state = found(inside, state.withColumnRenamed("rest", "need"), "need", "key", "at", str(2.0 / BINS))
    state = materialise(state.select("source", "rest", (F.col("at") + F.col("cut") * (2.0 / BINS / BINS)).alias("theta")), "theta")
    discard(cut, hist)
    # what is left is less than the documents at the threshold: documents no larger than that, by their hash
    last = state
    for k in range(FILLS):
        fill = of(state).where((F.col("size") <= F.col("rest")) & ~_ups(k))
        state = found(fill, state.withColumnRenamed("rest", f"room{k}"), f"room{k}", "u", "0.0", "1.0").withColumnRenamed("cut", f"fill{k}")
        old, state = last, materialise(state, "fill")
        discard(old)
        last = state
    discard(keyed)
    state = state.drop("rest").withColumnRenamed("source", "__s")
    return materialise(params.join(state, params.source.eqNullSafe(F.col("__s")), "left").drop("__s"), "params")


def with_copies(docs: DataFrame, params: DataFrame) -> DataFrame:
    """``docs`` (with source, size, u) with its source's source_size and target, and its copies (0, 1 or 2)."""
    d = _keyed(docs, params, _few(params))
    return d.select(*docs.columns, "source_size", "target", (F.col("whole") + _ups(FILLS).cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, u, source_size, target, copies."""
    d = spread(materialise(sized(docs, id_col, text_col, source_col), "sized"))
    return with_copies(d.drop("same"), solve(d))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it."""
    rows = spread(docs.select(F.struct(*docs.columns).alias("row"), *_sizes(id_col, text_col, source_col)))
    copies = with_copies(rows.drop("same"), solve(materialise(rows.select("source", "size", "u"), "sized")))
    return copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
