"""Interval overlap join in totals: how many intervals of the other side stand in each relation to an interval.

Intervals are slots, both ends inclusive; some never end. The intervals of one key on the other side are
disjoint but for those that never end, so in the order of their starts the ends ascend too: those that start
by a slot are a prefix of that order, those that end by a slot another one. A probe's totals in a relation
are those of a stretch between two prefixes, so no pair is ever made:

* the ends of both sides meet in one union, added up by (key, slot), closed and open intervals apart;
* running counts and sums over the slots of a key give each slot its prefixes, by start and by end;
* a probe reads them at its first and at its last slot and takes differences.

The sessions are found without a window over clicks: two clicks of half an hour's bucket never part a session,
so each bucket of a key is one row (first, last, an error at the last), and only buckets are put in order.

Windows run over the slots or buckets of a key in blocks of time; what a block starts with is summed from a
row a block. So a task's rows are bounded by the time that the data span, not by the rows of a hot key.
Probes with the same end are one row in the union, and probes that never end are found by their start.

Defined results: rows with a null key or time take no part; neither do lines of no sale or without a time. A
sale without lines ends when sold; lines before that change nothing. Repeated rows of a sale are sales of
their own with the same lines; repeated clicks change nothing. Equal times are one time. Null status and kind
are not open. A sale with no session in reach has no rows; empty tables give none. Columns that are not named
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, table

SLOT_HOURS = 6
GAP_MINUTES = 30
SECOND = 1_000_000
#: Slots, and buckets of clicks, whose running sums one window makes.
BLOCK_SLOTS = 64
BLOCK_BUCKETS = 672

#: Relations of a probe by its start (earlier, equally, later than the other's) and its end.
RELATIONS = {
    "earlier": ("overlaps", "finished_by", "contains"),
    "equally": ("starts", "equals", "started_by"),
    "later": ("during", "finishes", "overlapped_by"),
}
#: What is summed over closed intervals, in the order of their starts; ``n`` comes first as prefixes are compared by it.
TOTALS = ("n", "crc", "first", "last")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970: of a time without a zone as it reads, whatever the session's zone is."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(c)
    c = c.cast("timestamp_ntz")
    second = F.round(F.extract(F.lit("SECOND"), c) * SECOND).cast("long")
    minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * (60 * SECOND) + second


def _number(value: Column, unit: int) -> Column:
    """Number of the unit that a count of microseconds falls in, in whole numbers."""
    return F.round((value - F.pmod(value, F.lit(unit).cast("long"))) / F.lit(unit)).cast("long")


def sessions(clicks: DataFrame, key: str, ts: str, ends_open: Column, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(k, first, last, open): clicks of a key that follow each other within ``gap_minutes``, in microseconds.

    A session is open if ``ends_open`` holds for a click at its last time.
    """
    gap = gap_minutes * 60 * SECOND
    c = clicks.select(F.col(key).alias("k"), micros(clicks, ts).alias("at"), F.coalesce(ends_open, F.lit(False)).alias("bad"))
    c = c.where("k IS NOT NULL AND at IS NOT NULL").withColumn("bucket", _number(F.col("at"), gap))
    # the last time that ends open is compared with the last time: whole numbers, so the sums stay hashed
    b = c.groupBy("k", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.when(F.col("bad"), F.col("at"))).alias("bad"))
    b = materialise(b.withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS)), "buckets")
    within = Window.partitionBy("k", "block").orderBy("bucket")
    over = Window.partitionBy("k").orderBy("block")
    # what a block takes over: the last click before it, and how many sessions have begun by then
    inner = b.withColumn("before", F.lag("last").over(within))
    begun = F.count_if(F.col("first") - F.col("before") > gap)
    heads = inner.groupBy("k", "block").agg(F.min("first").alias("head"), F.max("last").alias("tail"), begun.alias("more"))
    heads = heads.withColumn("came", F.lag("tail").over(over))
    fresh = F.col("came").isNull() | (F.col("head") - F.col("came") > gap)
    heads = heads.withColumn("fresh", fresh.cast("long"))
    base = F.sum(F.col("fresh") + F.col("more")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("more")
    heads = heads.select("k", "block", base.alias("base"))
    breaks = (F.col("first") - F.col("before") > gap).cast("long")
    number = F.coalesce(F.sum(breaks).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    inner = inner.withColumn("within", number).join(heads, ["k", "block"])
    s = inner.groupBy("k", (F.col("base") + F.col("within")).alias("session")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("bad").alias("bad"))
    s = materialise(s.select("k", "first", "last", F.coalesce(F.col("bad") == F.col("last"), F.lit(False)).alias("open")), "sessions")
    discard(b)
    return s


def intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, k, first, last, open): from sold_at to the latest of it and the lines' shipped_at, in microseconds."""
    s = sales.select("sale_id", F.col("client_id").alias("k"), micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    s = s.where("k IS NOT NULL AND first IS NOT NULL")
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("at")).where("sale_id IS NOT NULL AND at IS NOT NULL")
    shipped = shipped.groupBy("sale_id").agg(F.max("at").alias("at"))
    met = s.join(shipped, "sale_id", "left")
    return met.select("sale_id", "k", "first", F.greatest("first", "at").alias("last"), "open")


def _named(of: Callable[[str], str], totals: tuple[str, ...] = TOTALS) -> str:
    return "named_struct(" + ", ".join(f"'{t}', {of(t)}" for t in totals) + ")"


#: The ends of closed intervals by their start (s) and by their end (e), those of open ones by their start (o).
ENDS = {"s": TOTALS, "e": TOTALS, "o": TOTALS[:-1]}
NAMES = [f"{x}_{t}" for x, totals in ENDS.items() for t in totals]


def _prefixes(ends: DataFrame) -> DataFrame:
    """(k, slot) that are asked for, with what has started and ended before the slot and by it, and what a key has in all.

    ``ends`` has a row for each end: the columns ``s_*`` of a closed interval that starts there, ``e_*`` of
    one that ends there, ``o_*`` of one that starts there and never ends; ``asked`` and nulls for a probe's end.
    """
    at = ends.groupBy("k", "slot").agg(F.max("asked").alias("asked"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NAMES))
    at = materialise(at.withColumn("block", F.floor(F.col("slot") / BLOCK_SLOTS)), "ends")
    blocks = at.groupBy("k", "block").agg(*(F.sum(c).alias(c) for c in NAMES))
    before = "OVER (PARTITION BY k ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = [f"coalesce(sum({c}) {before}, 0) AS b_{c}" for c in NAMES] + [f"sum({c}) OVER (PARTITION BY k) AS t_{c}" for c in NAMES if c[0] != "e"]
    met = at.join(blocks.selectExpr("k", "block", *carried), ["k", "block"])
    up_to = "OVER (PARTITION BY k, block ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = met.selectExpr("*", *(f"sum({c}) {up_to} AS r_{c}" for c in NAMES)).where("asked")
    by = [_named(lambda t: f"b_{x}_{t} + r_{x}_{t}", totals) + f" AS {x}_by" for x, totals in ENDS.items()]  # noqa: B023
    earlier = [_named(lambda t: f"b_{x}_{t} + r_{x}_{t} - {x}_{t}", totals) + f" AS {x}_before" for x, totals in ENDS.items()]  # noqa: B023
    every = [_named(lambda t: f"t_{x}_{t}", ENDS[x]) + f" AS {x}_all" for x in "so"]  # noqa: B023
    out = materialise(run.selectExpr("k", "slot", *by, *earlier, *every), "prefixes")
    discard(at)
    return out


def _stretch(low: str, high: str) -> str:
    """Totals between two prefixes; zero where the second is not the longer one."""
    return f"IF({high}.n > {low}.n, {_named(lambda t: f'{high}.{t} - {low}.{t}')}, {_named(lambda t: '0L')})"


def relate(probes: DataFrame, others: DataFrame, id_col: str = "sale_id", slot_hours: int = SLOT_HOURS) -> DataFrame:
    """Per row of ``probes`` and relation: id, relation, n_pairs, overlap_slots and sessions_crc.

    Both have k, first, last (microseconds) and open; ``others`` of a key are disjoint unless open.
    """
    unit = slot_hours * 3600 * SECOND
    slot = lambda c: _number(F.col(c), unit)
    o = others.select("k", slot("first").alias("first"), slot("last").alias("last"), "open", F.crc32(F.col("first").cast("string")).alias("crc"), F.lit(1).cast("long").alias("n"))
    own = {x: ", ".join(f"{t if x == y else 'NULL'} AS {y}_{t}" for y, totals in ENDS.items() for t in totals) for x in ENDS}
    met = o.selectExpr(
        "k", f"inline(IF(open, array(struct(first AS slot, {own['o']})), array(struct(first AS slot, {own['s']}), struct(last AS slot, {own['e']}))))")

    p = probes.select(F.col(id_col).alias("id"), "k", slot("first").alias("a"), slot("last").alias("b"), "open")
    # of a probe without an end only the start is asked for
    p = materialise(p.withColumn("b", F.when(F.col("open"), F.col("a")).otherwise(F.col("b"))), "probes")
    asked = p.select("k", F.explode(F.array("a", "b")).alias("slot"), F.lit(True).alias("asked"))
    found = _prefixes(met.unionByName(asked, allowMissingColumns=True))
    at_a = found.selectExpr("k", "slot AS a", "s_before", "s_by", "e_before", "o_before", "o_by", "s_all", "o_all")
    at_b = found.selectExpr("k", "slot AS b", "s_by AS s_by_end", "e_before AS e_before_end", "e_by AS e_by_end", "o_by AS o_by_end")
    p = p.join(at_a, ["k", "a"]).join(at_b, ["k", "b"])

    # without an end all that starts does so by it, and all closed ones end before it
    p = p.selectExpr(
        "id", "a", "b", "open", "s_before", "s_by", "e_before", "o_before", "o_by", "IF(open, s_all, s_by_end) AS last_start",
        "IF(open, s_all, e_before_end) AS ended_before", "IF(open, s_all, e_by_end) AS ended_by", "IF(open, o_all, o_by_end) AS o_last")
    starts = {"earlier": ("s_by", "last_start"), "equally": ("s_before", "s_by"), "later": ("e_before", "s_before")}
    endless = {"earlier": "o_last.{0} - o_by.{0}", "equally": "o_by.{0} - o_before.{0}", "later": "o_before.{0}"}
    bounds, stretches = [], []
    for when, (sooner, even, after) in RELATIONS.items():
        low, high = starts[when]
        # prefixes are compared by their lengths; of equal ones all totals are equal
        bounds += [f"greatest({low}, ended_by) AS {sooner}_low", f"greatest({low}, ended_before) AS {even}_low",
                   f"least({high}, ended_by) AS {even}_high", f"least({high}, ended_before) AS {after}_high"]
        stretches += [f"{_stretch(f'{sooner}_low', high)} AS {sooner}", f"{_stretch(f'{even}_low', f'{even}_high')} AS {even}", f"{_stretch(low, f'{after}_high')} AS {after}"]
        stretches += [_named(endless[when].format, ENDS["o"]) + f" AS endless_{when}"]
    p = p.selectExpr("*", *bounds).selectExpr("id", "a", "b", "open", *stretches)

    rows = []
    for when, (sooner, even, after) in RELATIONS.items():
        e = f"endless_{when}"
        begins = (lambda t: f"{t}.first") if when == "earlier" else (lambda t: f"{t}.n * a")  # the first shared slots, summed
        shared = lambda t, ends: f"{ends} - {begins(t)} + {t}.n"  # noqa: B023, E731
        more = lambda c: f"{sooner}.{c} + IF(open, 0, {e}.{c})"  # noqa: B023, E731
        rows += [
            # the other's end is later: those that never end, too, unless the probe doesn't either
            (sooner, more("n"), f"{shared(sooner, f'{sooner}.n * b')} + IF(open, 0, {shared(e, f'{e}.n * b')})", more("crc")),
            (even, f"IF(open, {e}.n, {even}.n)", f"IF(open, NULL, {shared(even, f'{even}.n * b')})", f"IF(open, {e}.crc, {even}.crc)"),
            (after, f"{after}.n", shared(after, f"{after}.last"), f"{after}.crc"),
        ]
    listed = ", ".join(f"named_struct('relation', '{r}', 'n_pairs', {n}, 'overlap_slots', {slots}, 'sessions_crc', {crc})" for r, n, slots, crc in rows)
    out = p.selectExpr(f"id AS `{id_col}`", f"inline(array({listed}))")
    return out.where("n_pairs > 0")


def op11_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = intervals(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))
    met = sessions(table(spark, sf_dir, "clicks"), "client_id", "ts", F.col("kind") == "error")
    out = relate(sales, met)
    discard(met)
    return out


def _cases() -> str:
    order = lambda x, y: {"earlier": f"{x} < {y}", "equally": f"{x} = {y}", "later": f"{x} > {y}"}
    ends = order("b", "e").values()
    return " ".join(f"WHEN {start} AND {end} THEN '{name}'" for when, start in order("a", "s").items() for end, name in zip(ends, RELATIONS[when], strict=True))


ORACLE = f"""
WITH RECURSIVE c AS (
  SELECT client_id AS k, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY k ORDER BY us) AS gap FROM c),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {GAP_MINUTES * 60 * SECOND} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY us) AS session FROM g),
z AS (SELECT k, session, min(us) AS first, max(us) AS last, coalesce(max(CASE WHEN bad THEN us END) = max(us), false) AS open FROM n GROUP BY ALL),
-- crc32 of the decimal text, a character a step
step(i, text, crc) AS (
  SELECT DISTINCT 0, first::VARCHAR, 4294967295::BIGINT FROM z
  UNION ALL
  SELECT i + 1, text, list_reduce(range(8), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, ascii(text[i + 1])::BIGINT))
  FROM step WHERE i < length(text)),
crcs AS (SELECT text, xor(crc, 4294967295) AS crc FROM step WHERE i = length(text)),
o AS (
  SELECT k, first // {SLOT_HOURS * 3600 * SECOND} AS s, CASE WHEN open THEN 1000000000 ELSE last // {SLOT_HOURS * 3600 * SECOND} END AS e, crc
  FROM z JOIN crcs ON text = first::VARCHAR),
l AS (SELECT sale_id, max(epoch_us(shipped_at)) AS us FROM sale_lines GROUP BY 1),
p AS (
  SELECT row_number() OVER () AS rn, sale_id, client_id AS k, epoch_us(sold_at) // {SLOT_HOURS * 3600 * SECOND} AS a,
    CASE WHEN status = 'open' THEN 1000000000 ELSE greatest(epoch_us(sold_at), coalesce(us, epoch_us(sold_at))) // {SLOT_HOURS * 3600 * SECOND} END AS b
  FROM sales LEFT JOIN l USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
m AS (
  SELECT rn, sale_id, CASE {_cases()} END AS relation, least(b, e) - greatest(a, s) + 1 AS shared, b = 1000000000 AND e = b AS endless, crc
  FROM p JOIN o USING (k) WHERE s <= b AND e >= a)
SELECT sale_id, relation, count(*)::BIGINT AS n_pairs, (CASE WHEN bool_or(endless) THEN NULL ELSE sum(shared) END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM m GROUP BY rn, sale_id, relation
"""

QUERIES = {"op11_interval_join": op11_interval_join}
ORACLES = {"op11_interval_join": ORACLE}
