"""Property-graph operators on ``nodes(element_id, name, label)`` and ``edges(start_node_id, rel_type, end_node_id)``."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut as _cut
from ..checkpoints import discard
from ..functions.text import sanitize_node, sanitize_relation

TRIPLE = ["subject_id", "relation_id", "object_id"]


def triple_properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge whose ends both exist, with the properties of its ends prefixed ``n1.`` and ``n2.``."""
    side = lambda p: nodes.select(*(F.col(c).alias(f"{p}.{c}") for c in nodes.columns))
    rel = edges.select(*(F.col(c).alias(f"r.{c}") for c in edges.columns))
    met = rel.join(side("n1"), F.col("`r.start_node_id`") == F.col("`n1.element_id`")).join(side("n2"), F.col("`r.end_node_id`") == F.col("`n2.element_id`"))
    return met.drop("r.start_node_id", "r.end_node_id")


def all_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = triple_properties(nodes, edges)
    return p.select(F.col("`n1.element_id`").alias("subject_id"), F.col("`r.rel_type`").alias("relation_id"), F.col("`n2.element_id`").alias("object_id"))


def named(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids replaced by names; an unknown id gives a null name."""
    look = nodes.groupBy("element_id").agg(F.max("name").alias("name"))
    out = triples
    for c, n in (("subject_id", "subject"), ("object_id", "object")):
        out = out.join(look.select(F.col("element_id").alias(c), F.col("name").alias(n)), c, "left")
    return out.select("subject", F.col("relation_id").alias("relation"), "object")


def subgraph_by_nodes(triples: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("subject_id", "object_id")) -> DataFrame:
    """Triples with any of ``columns`` among ``ids`` (one column ``element_id``), each once."""
    if missing := set(columns) - set(triples.columns):
        raise KeyError(f"no such columns: {sorted(missing)}")
    ids, out = ids.select("element_id").distinct(), triples
    for i, c in enumerate(columns):  # one pass over the triples, a mark for each end
        out = out.join(ids.select(F.col("element_id").alias(c), F.lit(True).alias(f"__{i}")), c, "left")
    return out.where(" or ".join(f"__{i}" for i in range(len(columns)))).select(triples.columns).distinct()


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element_id, edge_count): a self-loop counts once, isolated nodes have 0."""
    ends = edges.select(F.explode(F.array_distinct(F.array("start_node_id", "end_node_id"))).alias("element_id"))
    counted = ends.groupBy("element_id").agg(F.count("*").alias("edge_count"))
    return nodes.select("element_id").join(counted, "element_id", "left").select("element_id", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


def top_by_degree(degrees: DataFrame, n: int) -> DataFrame:
    return degrees.orderBy(F.desc("edge_count"), "element_id").limit(n)


def dense_rank_by_degree(degrees: DataFrame) -> DataFrame:
    """Adds ``rank``. Only the distinct degrees, few, are ordered in one place."""
    ranks = degrees.select("edge_count").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("edge_count"))))
    return degrees.join(ranks, "edge_count").select("element_id", "edge_count", "rank")


def by_ranked_degree(nodes: DataFrame, edges: DataFrame, best: int = 1, worst: int = -1, enforce_count: bool = False, columns: tuple[str, ...] = ("subject_id", "object_id")) -> DataFrame:
    """Triples of the nodes with dense degree ranks best..worst, or with ``enforce_count`` of just those places."""
    if best < 1 or (worst != -1 and worst < best):
        raise ValueError("ranks must satisfy 1 <= best <= worst")
    d = degree(nodes, edges)
    if enforce_count:
        order = d.orderBy(F.desc("edge_count"), "element_id")
        ids = order.offset(best - 1) if worst == -1 else order.limit(worst).offset(best - 1)
    else:
        ranked = dense_rank_by_degree(d)
        ids = ranked.where(F.col("rank") >= best) if worst == -1 else ranked.where(F.col("rank").between(best, worst))
    return subgraph_by_nodes(all_triples(nodes, edges), ids, columns)


def neighbourhood(triples: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Edges found by ``depth`` undirected steps from ``start``; none for depth 0 or an unknown node.

    Nodes fewer than ``depth`` steps away are found first, a join with the doubled edge list a step; the
    edges at any of them are one pass.
    """
    if depth < 1:
        return triples.limit(0)
    front = reached = triples.sparkSession.createDataFrame([(start,)], "element_id string")
    made: list[DataFrame] = []
    if depth > 1:
        both = triples.select(F.explode(F.array(*(F.struct(F.col(a).alias("at"), F.col(b).alias("to")) for a, b in (("subject_id", "object_id"), ("object_id", "subject_id"))))).alias("e"))
        both = _cut(both.select("e.*").distinct()) if depth > 2 else both.select("e.*")
        made.append(both)
    for _ in range(depth - 1):
        step = both.join(front.withColumnRenamed("element_id", "at"), "at", "left_semi").select(F.col("to").alias("element_id")).distinct()
        front = _cut(step.join(reached, "element_id", "left_anti"))
        made.append(front)
        if front.isEmpty():
            break
        reached = reached.union(front)
    if len(made) > 2:  # the ids as one table; those of single steps go
        reached = _cut(reached)
        discard(*made)
    return subgraph_by_nodes(triples, reached)


def path_lengths(edges: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(element_id, hops) along directed edges, the fewest, of all nodes that can be reached, or up to ``most`` hops."""
    front = edges.sparkSession.createDataFrame([(start, 0)], "element_id string, hops int")
    out, made = front, []
    for i in count(1) if most is None else range(1, most + 1):
        step = edges.join(front.select(F.col("element_id").alias("start_node_id")), "start_node_id").select(F.col("end_node_id").alias("element_id")).distinct()
        front = _cut(step.join(out, "element_id", "left_anti").withColumn("hops", F.lit(i)))
        made.append(front)
        if front.isEmpty():
            break
        out = out.union(front)
        if i % 10 == 0:  # keeps the plan of a long way short
            out = _cut(out)
            discard(*made[:-1])  # the last is where the next step starts
            made = [made[-1], out]
    return out


def _numbered(edges: DataFrame, block: int, deg: DataFrame | None = None) -> DataFrame:
    """Edges with their number ``k`` among those of their start, and the start's ``out``.

    A start's edges are dealt by hash into blocks of about ``block``, so that a hub's are numbered by many tasks; only
    the sizes of a hub's blocks are summed in order. ``deg`` (start_node_id, out) is counted if it is not given.
    """
    deg = edges.groupBy("start_node_id").agg(F.count("*").alias("out")) if deg is None else deg
    dealt = F.pmod(F.xxhash64("rel_type", "end_node_id"), F.ceil(F.col("out") / block))
    e = edges.join(deg, "start_node_id").withColumn("at", dealt)
    sizes = e.where(F.col("out") > block).groupBy("start_node_id", "at").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("start_node_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("start_node_id", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("start_node_id", "at").orderBy("rel_type", "end_node_id")) - 1
    return e.withColumn("k", inside).join(sizes, ["start_node_id", "at"], "left").withColumn("k", F.col("k") + F.coalesce("before", F.lit(0))).drop("at", "before")


def random_walk(edges: DataFrame, starts: DataFrame, length: int, walks: int = 1, seed: int = 0, block: int = 10_000) -> DataFrame:
    """Distinct edges of directed walks; each step is picked by a hash of (walk, step, seed), so reruns agree."""
    edges = _cut(edges)  # read three times, made once
    deg = _cut(edges.groupBy("start_node_id").agg(F.count("*").alias("out")))
    numbered = _cut(_numbered(edges, block, deg))
    degrees = deg.select(F.col("start_node_id").alias("element_id"), "out")
    at = starts.select("element_id").distinct().join(degrees, "element_id", "left_semi")
    at = at.select(F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("n"), "element_id").select(F.concat_ws("#", "element_id", "n").alias("walk"), "element_id")
    out, made = None, [edges, deg, numbered]
    for i in range(length):
        # the number of the edge is part of the join's key, so walks that meet at a hub part at once
        pick = at.join(degrees, "element_id")
        pick = pick.select("walk", F.col("element_id").alias("start_node_id"), F.pmod(F.xxhash64("walk", F.lit(i), F.lit(seed)), "out").alias("k"))
        step = _cut(pick.join(numbered, ["start_node_id", "k"]).select("walk", "start_node_id", "rel_type", "end_node_id"))
        made.append(step)
        out = step if out is None else out.union(step)
        at = step.select("walk", F.col("end_node_id").alias("element_id"))
    found = edges.limit(0) if out is None else out
    found = _cut(found.select("start_node_id", "rel_type", "end_node_id").distinct())
    discard(*made)
    return found


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(element_id, community_id) by synchronous label propagation: the most frequent label of the neighbours
    and oneself, ties to the smallest; a fixed number of rounds at most. Every label is a node of its component."""
    both = edges.select(F.col("start_node_id").alias("a"), F.col("end_node_id").alias("b")).where("a <> b")
    # neither links nor labels are broadcast: every round would send them through the driver
    both = _cut(both.union(both.select("b", "a")).distinct())
    links = both.hint("merge")
    labels = nodes.select("element_id", F.col("element_id").alias("community_id")).distinct()
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("element_id", "b"), "b").select(F.col("a").alias("element_id"), "community_id").union(labels)
        count = votes.groupBy("element_id", "community_id").agg(F.count("*").alias("n"))
        new = _cut(count.groupBy("element_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("community_id").alias("c"))).alias("m")).select("element_id", F.col("m.c").alias("community_id")))
        same = new.hint("merge").join(labels.withColumnRenamed("community_id", "old"), "element_id").where("community_id <> old").isEmpty()
        discard(labels)
        labels = new
        if same:
            break
    discard(both)
    return labels


def community_subgraph(triples: DataFrame, members: DataFrame, community) -> DataFrame:
    """Triples with both ends in a community; ``members``: (element_id, community_id)."""
    ids = members.where(F.col("community_id") == community).select("element_id")
    return triples.join(ids.withColumnRenamed("element_id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("element_id", "object_id"), "object_id", "left_semi").select(TRIPLE)


def pair_index(edges: DataFrame) -> DataFrame:
    """Edges with their place among the edges of the same undirected pair; direction is kept."""
    e = edges.withColumns({"low": F.least("start_node_id", "end_node_id"), "high": F.greatest("start_node_id", "end_node_id")})
    w = Window.partitionBy("low", "high")
    return e.withColumn("place", F.row_number().over(w.orderBy("start_node_id", "rel_type", "end_node_id")) - 1).withColumn("of", F.count("*").over(w))


def relation_summary(named_triples: DataFrame) -> DataFrame:
    return named_triples.groupBy("relation").agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "subject", "relation", "object")).alias("example"))


def statistics(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """One row: counts, the relation types, the ``top`` nodes by degree as ``name (degree)``, mean degree, density."""
    n = nodes.agg(F.count("*").alias("node_count"))
    types = F.array_join(F.sort_array(F.collect_set("rel_type")), ", ")  # as many as there are kinds of relation
    e = edges.agg(F.count("*").alias("edge_count"), F.countDistinct("rel_type").alias("relation_types"), types.alias("relations"))
    degrees = degree(nodes, edges)
    d = degrees.agg(F.avg("edge_count").alias("avg_degree"))
    best = top_by_degree(degrees, top).join(nodes.groupBy("element_id").agg(F.max("name").alias("name")), "element_id")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("edge_count")).alias("k"), "element_id", F.concat("name", F.lit(" ("), F.col("edge_count").cast("string"), F.lit(")")).alias("line"))))
    t = best.agg(F.array_join(F.transform(listed, lambda x: x["line"]), ", ").alias("top_nodes"))
    whole = n.join(e, how="cross").join(d, how="cross").join(t, how="cross")  # one row each
    return whole.withColumn("density", F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1)))


def verbalise(named_triples: DataFrame, mode: str = "triple") -> DataFrame:
    """One ``line`` a triple: plain, a sentence, or JSON."""
    lines = {
        "triple": F.concat_ws(" ", "subject", "relation", "object"),
        "natural": F.concat(F.col("subject"), F.lit(" "), F.lower(F.replace("relation", F.lit("_"), F.lit(" "))), F.lit(" "), F.col("object"), F.lit(".")),
        "json": F.to_json(F.struct(F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"))),
    }
    if mode not in lines:
        raise ValueError(f"unknown mode {mode}")
    return named_triples.withColumn("line", lines[mode])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Set semantics on (s, r, o); triples with a blank part are skipped."""
    ok = new.where("length(trim(s)) > 0 and length(trim(r)) > 0 and length(trim(o)) > 0")
    return old.select("s", "r", "o").unionByName(ok.select("s", "r", "o")).dropDuplicates(["s", "r", "o"])


def upsert_sanitized(old: DataFrame | None, new: DataFrame, mode: str = "UPPER_CASE") -> DataFrame:
    """``upsert`` of triples whose labels are sanitised first; without ``old`` a new graph takes the old one's place.

    A part with nothing left after sanitising is blank, so its triple is skipped.
    """
    made = new.select(sanitize_node(F.col("s")).alias("s"), F.when(F.trim("r") != "", sanitize_relation(F.col("r"), mode)).alias("r"), sanitize_node(F.col("o")).alias("o"))
    return upsert(made.limit(0) if old is None else old, made)


def context(named_triples: DataFrame, top: int = 5) -> DataFrame:
    """(subject, facts): the first ``top`` facts of each subject by relation and object, as one line."""
    w = Window.partitionBy("subject").orderBy("relation", "object")
    first = named_triples.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    facts = F.sort_array(F.collect_list(F.struct("k", F.concat_ws(" ", "relation", "object").alias("fact"))))
    return first.groupBy("subject").agg(F.array_join(F.transform(facts, lambda x: x["fact"]), "; ").alias("facts"))


def node_context(named_triples: DataFrame, name: str, neighbours: bool = True) -> DataFrame:
    """(direction, line): the facts that leave a node and, with ``neighbours``, those that reach it and the neighbours' own.

    A fact is told once: as one that leaves (out) or reaches (in) the node, else as one that leaves a neighbour (near).
    """
    facts = lambda d, way: d.select(F.lit(way).alias("direction"), F.concat_ws(" ", "subject", "relation", "object").alias("line"))
    own = F.coalesce(F.col("subject") == name, F.lit(False))
    reaches = F.coalesce(F.col("object") == name, F.lit(False)) & ~own
    out = facts(named_triples.where(own), "out")
    if neighbours:
        near = named_triples.where(own).select(F.col("object").alias("subject")).union(named_triples.where(reaches).select("subject"))
        others = named_triples.where(~own & ~reaches).join(near.distinct(), "subject", "left_semi")
        out = out.union(facts(named_triples.where(reaches), "in")).union(facts(others, "near"))
    return out.distinct()


def focused_context(named_triples: DataFrame, focus: DataFrame | None = None, top: int = 5) -> DataFrame:
    """``context`` of the nodes in ``focus`` (name), or of the ``top`` subjects with the most facts; ties by name."""
    if focus is None:
        focus = named_triples.groupBy(F.col("subject").alias("name")).count().orderBy(F.desc("count"), "name").limit(top).select("name")
    return context(named_triples.join(focus.select(F.col("name").alias("subject")).distinct(), "subject", "left_semi"), top)


def narrative(named_triples: DataFrame, strategy: str = "summary", start: str | None = None, max_triples: int = 50) -> DataFrame:
    """(place, line): at most ``max_triples`` facts as sentences.

    path: facts in the order of steps from ``start``; cluster: subjects with the most facts first; summary: relations
    by how often they occur, each with an example.
    """
    said = F.concat(F.concat_ws(" ", "subject", F.lower(F.replace("relation", F.lit("_"), F.lit(" "))), "object"), F.lit("."))
    if strategy == "path":
        if start is None:
            raise ValueError("a path needs a start")
        hops = path_lengths(named_triples.select(F.col("subject").alias("start_node_id"), F.col("object").alias("end_node_id")), start)
        lines = named_triples.join(hops.withColumnRenamed("element_id", "subject"), "subject").select(F.col("hops").cast("long").alias("k"), said.alias("line"))
    elif strategy == "cluster":
        size = named_triples.groupBy("subject").agg((-F.count("*")).alias("k"))
        lines = named_triples.join(size, "subject").select("k", said.alias("line"))
    elif strategy == "summary":
        r = relation_summary(named_triples)
        times = F.concat(F.col("relation"), F.lit(" occurs "), F.col("n").cast("string"), F.lit(" times, as in "), F.col("example"), F.lit("."))
        lines = r.select((-F.col("n")).alias("k"), times.alias("line"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    first = lines.orderBy("k", "line").limit(max_triples)
    return first.select((F.row_number().over(Window.orderBy("k", "line")) - 1).alias("place"), "line")


def concatenated(triples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the triples of each chunk, a JSON object a line, in the order of their text."""
    line = F.to_json(F.struct("s", "r", "o"))
    return triples.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
