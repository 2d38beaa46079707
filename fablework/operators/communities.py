"""Communities by modularity, level by level, on the undirected projection of a graph.

``louvain``: nodes move between communities while that raises modularity, then communities become the next
level's nodes. ``leiden``: between the two, each community is refined. Its nodes begin alone again, and those
well connected to the community join, one by one and never to leave, a well-connected part of it that they have
a link to and that gains by it. The parts become the next level's nodes, which start in the communities that
were found. At the end communities are split into their connected parts, which never lowers modularity.

Many nodes move in a round: those of one half, by a hash of node and round, so that neighbours rarely swap places.
If two halves together have not raised modularity they are taken back, and of the nodes that gain only those
move that gain most of all that touch the communities they leave and join; such moves do not meet, so their gains
add up. So each step raises modularity, and rounds end when no node gains, not at a number. Of equal
gains the smallest community wins. Everything is joins and aggregations; only sums reach the driver. Reruns agree.
Tables of nodes, communities and links are joined where their rows lie (``_kept``): a broadcast in each of many rounds
would send each through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut as _cut
from ..checkpoints import discard

METHODS = ("leiden", "louvain", "label_propagation")
LEAST = 1e-9


def _kept(df: DataFrame) -> DataFrame:
    """``df``, never broadcast in a join."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    made = _cut(df)
    out = _kept(made)
    out._folder = made._folder
    return out


def _weights(edges: DataFrame) -> DataFrame:
    """(a, b, w) both ways; a loop counts twice."""
    ends = edges.select(F.col("start_node_id").alias("a"), F.col("end_node_id").alias("b"))
    return ends.union(ends.select("b", "a")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))


def _best(links: DataFrame, strength: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """(a, was, c, gain): the community that each node of ``labels`` (a, c) fits best, and what it gains by it."""
    mass = labels.join(strength, "a").groupBy("c").agg(F.sum("k").alias("mass"))
    labels, mass = _kept(labels), _kept(mass)
    to = links.where("a <> b").join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
    own = labels.withColumn("w", F.lit(0.0)).select("a", "c", "w")
    to = to.union(own).groupBy("a", "c").agg(F.sum("w").alias("w"))
    to = to.join(labels.withColumnRenamed("c", "now"), "a").join(strength, "a").join(mass, "c")
    others = F.col("mass") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
    to = to.withColumn("gain", F.round(F.col("w") - F.col("k") * others / total, 9))
    best = to.groupBy("a").agg(
        F.first("now").alias("was"), F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("best"),
        F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stay"))
    return best.select("a", "was", F.col("best.c").alias("c"), (-F.col("best.g") - F.col("stay")).alias("gain"))


def _moved(best: DataFrame, go) -> DataFrame:
    return best.select("a", F.when(go & (F.col("gain") > LEAST), F.col("c")).otherwise(F.col("was")).alias("c"), (F.col("gain") > LEAST).alias("wants"))


def _apart(best: DataFrame) -> DataFrame:
    """The moves that gain most of all that touch the communities they leave and join."""
    wants = best.where(F.col("gain") > LEAST)
    place = F.struct((-F.col("gain")).alias("g"), "a")
    touched = wants.select(place.alias("m"), F.explode(F.array("was", "c")).alias("t")).groupBy("t").agg(F.min("m").alias("m"))
    touched = _kept(touched)
    first = wants.select("a", F.explode(F.array("was", "c")).alias("t")).join(touched, "t").groupBy("a").agg(F.bool_and(F.col("m.a") == F.col("a")).alias("first"))
    first = _kept(first)
    return _moved(best.join(first, "a", "left"), F.coalesce("first", F.lit(False)))


def _quality(links: DataFrame, strength: DataFrame, labels: DataFrame, total: float) -> float:
    met = links.join(labels, "a").join(labels.select(F.col("a").alias("b"), F.col("c").alias("d")), "b")
    inside = met.agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("w") / total)).alias("q"))
    mass = labels.join(strength, "a").groupBy("c").agg(F.sum("k").alias("m")).agg(F.sum(-F.col("m") * F.col("m") / total**2).alias("q"))
    return inside.union(mass).agg(F.sum("q")).first()[0] or 0.0


def _settled(links: DataFrame, strength: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """``labels`` (a, c) after moves that raise modularity until no node gains by one."""
    had, number = _quality(links, strength, labels, total), 0
    while True:
        now, held = labels, []
        for half in (0, 1):
            turn = F.pmod(F.xxhash64("a", F.lit(number)), F.lit(2)) == half
            held.append(cut(_moved(_best(links, strength, now, total), turn)))
            if half == 0 and held[0].where("wants").isEmpty():
                discard(*held)
                return labels
            now = held[-1].select("a", "c")
        has, number = _quality(links, strength, now, total), number + 1
        if has <= had + LEAST / 10:
            discard(*held)
            best = cut(_best(links, strength, labels, total))
            held = [cut(_apart(best))]
            discard(best)
            now = held[0].select("a", "c")
            has = _quality(links, strength, now, total)
        discard(*held[:-1], labels)
        now._folder = held[-1]._folder  # a selection of a table that is kept
        labels, had = now, has


def _refined(links: DataFrame, strength: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """(a, r): the part that each node belongs to of its community; parts are connected."""
    labels = _kept(labels)
    of = _kept(labels.join(strength, "a").select("a", "c", "k"))
    all_of = _kept(of.groupBy("c").agg(F.sum("k").alias("all_k")))
    inside = links.where("a <> b").join(labels, "a").join(labels.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b", "w")
    inside = cut(inside)
    nodes = cut(of.join(all_of, "c").join(_kept(inside).groupBy("a").agg(F.sum("w").alias("to_all")), "a").where(F.col("to_all") >= F.col("k") * (F.col("all_k") - F.col("k")) / total))
    parts = labels.select("a", F.col("a").alias("r"))  # kept, as labels are
    number = 0
    while True:
        ends = inside.join(parts, "a").join(parts.select(F.col("a").alias("b"), F.col("r").alias("s")), "b")
        size = parts.join(of, "a").groupBy("r").agg(F.count("*").alias("n"), F.sum("k").alias("mass"), F.first("c").alias("c"))
        out = _kept(ends.where("r <> s").groupBy("r").agg(F.sum("w").alias("out")))
        size = size.join(all_of, "c").join(out, "r").select("r", "n", "mass", (F.col("out") >= F.col("mass") * (F.col("all_k") - F.col("mass")) / total).alias("well"))
        size = cut(size)
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(number // 2)), F.lit(2)) == number % 2  # noqa: B023, E731
        alone = size.where("n = 1").select(F.col("r").alias("a"))
        to = ends.join(alone, "a", "left_semi").where("r <> s").groupBy("a", "s").agg(F.sum("w").alias("w"))
        to = to.join(nodes.select("a", "k"), "a").join(size.select(F.col("r").alias("s"), "n", "mass", "well"), "s").where("well")
        to = to.withColumn("gain", F.round(F.col("w") - F.col("k") * F.col("mass") / total, 9)).where(F.col("gain") > LEAST)
        # who is alone and has a turn may leave, so nobody joins it
        go = turn("a") & ~((F.col("n") == 1) & turn("s"))
        best = to.groupBy("a").agg(F.min(F.when(go, F.struct((-F.col("gain")).alias("g"), "s"))).alias("m"))
        best = cut(best.select("a", F.col("m.s").alias("to")))
        if best.isEmpty():
            discard(best, size, inside, nodes)
            return parts
        new = cut(parts.join(best, "a", "left").select("a", F.coalesce("to", "r").alias("r")))
        discard(best, size, parts)
        parts, number = new, number + 1


def _connected(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, c): ``labels`` with each community split into its connected parts, named by their smallest nodes."""
    labels = _kept(labels)
    at = links.where("a <> b").join(labels, "a").join(labels.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b")
    at, parts = cut(at), labels.select("a", F.col("a").alias("c"))
    while True:
        near = at.join(parts.select(F.col("a").alias("b"), "c"), "b").select("a", "c").union(parts).groupBy("a").agg(F.min("c").alias("c"))
        # what the smallest node in reach has reached
        far = near.alias("n").join(parts.alias("p"), F.col("n.c") == F.col("p.a")).select("n.a", F.least("n.c", "p.c").alias("c"))
        new = cut(far)
        same = new.join(parts.withColumnRenamed("c", "old"), "a").where("c <> old").isEmpty()
        discard(parts)
        parts = new
        if same:
            discard(at)
            return parts


def modularity(edges: DataFrame, members: DataFrame, column: str = "community_id") -> float:
    """Modularity of a partition of the undirected projection."""
    links = _weights(edges)
    of = _kept(members.select(F.col("element_id").alias("a"), F.col(column).alias("c")))
    met = links.join(of, "a").join(of.toDF("b", "d"), "b")
    total = links.agg(F.sum("w")).first()[0] or 1.0
    inside = met.where("c = d").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    mass = met.groupBy("c").agg(F.sum("w").alias("m")).agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0))).first()[0]
    return inside / total - mass / total**2


def detect(nodes: DataFrame, edges: DataFrame, method: str = "louvain", multi_level: bool = False, max_levels: int | None = None, rounds: int = 10) -> DataFrame:
    """(element_id, community_id), or with ``multi_level`` (element_id, community_list) from the finest level on.

    A community is named by its smallest node. Nodes without edges are their own. Levels go on until one changes
    nothing, or to ``max_levels``. ``rounds`` is label propagation's bound, which may never settle.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    ids = _kept(nodes.select("element_id").distinct())
    if method == "label_propagation":
        from .graph import communities

        found = communities(nodes, edges, rounds)
        return found if not multi_level else found.select("element_id", F.array("community_id").alias("community_list"))
    ends = edges.join(ids.withColumnRenamed("element_id", "start_node_id"), "start_node_id", "left_semi")
    links = cut(_weights(ends.join(ids.withColumnRenamed("element_id", "end_node_id"), "end_node_id", "left_semi")))
    total = links.agg(F.sum("w")).first()[0] or 1.0
    # which node of the level an element is part of, and its communities so far
    names = cut(ids.select("element_id", F.col("element_id").alias("a"), F.array().cast("array<string>").alias("found")))
    first, labels, level = links, _kept(links.select("a").distinct().select("a", F.col("a").alias("c"))), 0
    made = [links, names]
    while max_levels is None or level < max_levels:
        strength = cut(links.groupBy("a").agg(F.sum("w").alias("k")))
        labels = _settled(links, strength, labels, total)
        made += [strength, labels]
        n, groups = labels.agg(F.count("*"), F.count_distinct("c")).first()
        if n == groups:  # every node is its own community
            break
        new = names.join(labels, "a", "left").withColumn("c", F.coalesce("c", "a"))
        new = new.withColumn("c", F.min("element_id").over(Window.partitionBy("c")))
        names = cut(new.select("element_id", "a", F.concat("found", F.array("c")).alias("found")))
        parts = _refined(links, strength, labels, total) if method == "leiden" else labels.select("a", F.col("c").alias("r"))
        made += [names, parts]
        if parts.agg(F.count_distinct("r")).first()[0] == n:  # no part has two nodes
            break
        names = cut(names.join(parts, "a", "left").select("element_id", F.coalesce("r", "a").alias("a"), "found"))
        at = lambda x: parts.select(F.col("a").alias(x), F.col("r").alias(f"to_{x}"))  # noqa: B023, E731
        wider = cut(links.join(at("a"), "a").join(at("b"), "b").groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(F.sum("w").alias("w")))
        start = cut(labels.join(parts, "a").groupBy(F.col("r").alias("a")).agg(F.min("c").alias("c")) if method == "leiden" else parts.select(F.col("r").alias("a"), F.col("r").alias("c")).distinct())
        made += [names, wider, start]
        links, labels, level = wider, start, level + 1
    levels = names.select("element_id", F.when(F.size("found") > 0, F.col("found")).otherwise(F.array("element_id")).alias("found"))
    if method == "leiden":
        last = levels.select(F.col("element_id").alias("a"), F.element_at("found", -1).alias("c"))
        last = cut(last)
        parts = _connected(first, last)
        made += [last, parts]
        parts = parts.withColumnRenamed("a", "element_id")
        whole = F.when(F.size("found") > 1, F.concat(F.slice("found", F.lit(1), F.size("found") - 1), F.array("c"))).otherwise(F.array("c"))
        levels = levels.join(parts, "element_id").select("element_id", whole.alias("found"))
    out = cut(levels.select("element_id", F.col("found").alias("community_list") if multi_level else F.element_at("found", -1).alias("community_id")))
    discard(*made)
    return out
