"""Communities: modularity against plain counting, connected parts, not below the plain method's."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fablework.operators import communities as C


def graph(spark, pairs, alone=()):
    edges = spark.createDataFrame([(str(a), "R", str(b)) for a, b in pairs], "start_node_id string, rel_type string, end_node_id string")
    nodes = spark.createDataFrame([(str(x),) for x in sorted({x for p in pairs for x in p} | set(alone), key=str)], "element_id string")
    return nodes, edges


def quality(pairs, of):
    total, inside, mass = 2 * len(pairs), 0, defaultdict(int)
    for a, b in pairs:
        a, b = str(a), str(b)
        inside += 2 * (of[a] == of[b])
        mass[of[a]] += 1
        mass[of[b]] += 1
    return inside / total - sum(m * m for m in mass.values()) / total**2


def connected(pairs, of):
    near = defaultdict(set)
    for a, b in pairs:
        if of[str(a)] == of[str(b)]:
            near[str(a)].add(str(b))
            near[str(b)].add(str(a))
    for c in set(of.values()):
        members = {x for x in of if of[x] == c}
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        if seen != members or c != min(members):
            return False
    return True


def planted(seed, groups=3, size=8):
    rnd = random.Random(seed)
    of = {i: i // size for i in range(groups * size)}
    return [(a, b) for a in of for b in of if a < b and rnd.random() < (0.5 if of[a] == of[b] else 0.03)]


CASES = {
    "planted": planted(1), "ring": [(f"{i:02d}", f"{(i + 1) % 20:02d}") for i in range(20)], "star": [("hub", i) for i in range(12)],
    "cliques on a hub": [(f"{c}{i}", f"{c}{j}") for c in "abcd" for i in range(4) for j in range(i)] + [("h", f"{c}0") for c in "abcd"] + [("h", "a1")],
    "repeated and loops": planted(4, 2, 4) * 2 + [(0, 0), (7, 7), (7, 7)],
}


@pytest.mark.parametrize("name", CASES)
def test_leiden(spark, name):
    pairs = CASES[name]
    nodes, edges = graph(spark, pairs, alone=["x", "y"])
    found = {m: {r.element_id: r.community_id for r in C.detect(nodes, edges, m).collect()} for m in ("leiden", "louvain")}
    of = found["leiden"]
    assert set(of) == {r.element_id for r in nodes.collect()} and of["x"] == "x" and of["y"] == "y"
    assert connected(pairs, of)
    got = quality(pairs, of)
    assert got >= quality(pairs, found["louvain"]) - 1e-9
    assert got == pytest.approx(C.modularity(edges, spark.createDataFrame(list(of.items()), "element_id string, community_id string")))


def test_levels_end_with_the_communities(spark):
    nodes, edges = graph(spark, planted(2))
    one = {r.element_id: r.community_id for r in C.detect(nodes, edges, "leiden").collect()}
    lists = {r.element_id: r.community_list for r in C.detect(nodes, edges, "leiden", multi_level=True).collect()}
    assert {x: found[-1] for x, found in lists.items()} == one and len({len(found) for found in lists.values()}) == 1
    assert C.detect(nodes, edges.limit(0), "leiden").where("element_id <> community_id").isEmpty() and C.detect(nodes.limit(0), edges, "leiden").isEmpty()


def test_communities_of_many_parts_are_split(spark):
    _, edges = graph(spark, [(f"{i:02d}", f"{i + 1:02d}") for i in range(20) if i != 9])
    labels = spark.createDataFrame([(f"{i:02d}", "c" if i < 15 else "d") for i in range(21)], "a string, c string")
    parts = {r.a: r.c for r in C._connected(C._weights(edges), labels).collect()}
    assert parts == {f"{i:02d}": "00" if i < 10 else "10" if i < 15 else "15" for i in range(21)}


def test_moves_that_do_not_meet(spark):
    links = C.cut(C._weights(graph(spark, CASES["star"])[1]))
    strength, labels = links.groupBy("a").agg(F.sum("w").alias("k")), links.select("a", F.col("a").alias("c")).distinct()
    total = links.agg(F.sum("w")).first()[0]
    moved = C._apart(C._best(links, strength, labels, total))
    assert moved.where("a <> c").count() == 1  # all of them touch the hub's community


def test_rounds_send_no_table_through_the_driver(spark):
    """Small tables too are joined without a broadcast, as in a large graph each round would send one."""
    links = C.cut(spark.createDataFrame([("x", "y", 1.0), ("y", "x", 1.0)], "a string, b string, w double"))
    strength = C.cut(links.groupBy("a").agg(F.sum("w").alias("k")))
    labels = links.select("a", F.col("a").alias("c"))
    best = C._best(links, strength, labels, 2.0)
    for df in (best, C._apart(C.cut(best))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
