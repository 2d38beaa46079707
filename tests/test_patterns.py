"""Graph statements on small graphs."""

import pytest

from fablework.operators.patterns import Graph

PEOPLE = """
// three people; and who knows whom
CREATE (a:Person {name: "Ann", age: 30, likes: ["tea", "rain"]}), (b:Person:Admin {name: 'Bo\\'s', age: 9}), (c:Person {name: "Cy"});
MATCH (a {name: "Ann"}) MATCH (b:Admin) CREATE (a)-[:KNOWS {since: 2020}]->(b)-[:KNOWS]->(a);
MATCH (b:Admin), (c {name: "Cy"}) CREATE (c)<-[:LIKES]-(b) RETURN c;
"""


@pytest.fixture(scope="module")
def written(spark):
    g = Graph(spark)
    assert [d.count() for d in g.run_script(PEOPLE)] == [1]
    return g


@pytest.fixture
def people(written):
    return Graph(written.spark, written.nodes, written.edges)  # changes make new frames


def rows(g, statement):
    return sorted(map(tuple, g.run(statement).collect()), key=lambda r: [str(x) for x in r])


def test_match(people):
    assert people.nodes.count() == 3 and people.edges.count() == 3
    assert rows(people, "MATCH (x)-[r:KNOWS]->(y) RETURN x.name, type(r) AS t, y.name, r.since") == [("Ann", "KNOWS", "Bo's", "2020"), ("Bo's", "KNOWS", "Ann", None)]
    assert rows(people, "MATCH (x:Person)-[:KNOWS|LIKES]-(y) RETURN x.name AS n, count(y) AS k") == [("Ann", 2), ("Bo's", 3), ("Cy", 1)]
    assert rows(people, "MATCH (x)-[]->(y)-[]->(z) RETURN x.name, z.name") == [("Ann", "Ann"), ("Ann", "Cy"), ("Bo's", "Bo's")]
    assert rows(people, "MATCH (x)<--(y:Admin) RETURN DISTINCT y.name") == [("Bo's",)]


@pytest.mark.parametrize(("where", "names"), [
    ("x.age > 9", ["Ann"]), ("x.age >= 9 AND NOT x.name = 'Ann'", ["Bo's"]), ("x.age IS NULL OR x.age = 30", ["Ann", "Cy"]), ("x.name IN ['Cy', 'Di']", ["Cy"]),
    ("x.name CONTAINS 'n'", ["Ann"]), ("x.name STARTS WITH 'B' OR x.name ENDS WITH 'y'", ["Bo's", "Cy"]), ("x.age IN [9, 30]", ["Ann", "Bo's"]), ("(x.age = 1)", []),
])
def test_where(people, where, names):
    assert rows(people, f"MATCH (x:Person) WHERE {where} RETURN x.name") == [(n,) for n in names]


def test_merge_and_set(people):
    people.run("MATCH (x:Person) MERGE (t:Town {name: 'Here'}) MERGE (x)-[:IN]->(t)")
    people.run("MATCH (x:Person) MERGE (t:Town {name: 'Here'}) MERGE (x)-[:IN]->(t)")
    assert rows(people, "MATCH (t:Town)<-[:IN]-(x) RETURN t.name, count(*) AS n") == [("Here", 3)]
    people.run("MATCH (x:Person) MERGE (n:Name {of: x.name})")
    assert rows(people, "MATCH (n:Name) RETURN n.of") == [("Ann",), ("Bo's",), ("Cy",)]
    got = people.run("MERGE (x:Person {name: 'Cy'}) SET x.age = 5, x.says = 'hm' RETURN x").first()["x"]
    assert got["props"] == {"name": '"Cy"', "age": "5", "says": '"hm"'}
    people.run("MATCH (x:Person), (y:Person {name: 'Ann'}) SET x.age = null, x.friend = y.name")
    assert rows(people, "MATCH (x:Person) RETURN x.age, x.friend, x.says") == [(None, "Ann", None), (None, "Ann", None), (None, "Ann", "hm")]


def test_values_joined_across_patterns(people):
    people.run("CREATE (:Said {by: 'Ann', text: 'a'}), (:Said {by: 'Ann', text: 'b'}), (:Said {by: 'X', text: 'c'})")
    assert rows(people, "MATCH (p:Person) MATCH (s:Said) WHERE s.by = p.name RETURN p.name, collect(s.text) AS said") == [("Ann", ["a", "b"])]


def test_distinct_reduces_patterns_before_they_meet(spark):
    """100,000 nodes on either side of one value: 10^10 pairs before they were made one."""
    n = 100_000
    nodes = spark.range(2 * n).selectExpr("cast(id as string) AS element_id", f"if(id < {n}, concat('a', id % 3), concat('b', id)) AS name", f"if(id < {n}, 'left', 'right') AS label", "'x' AS town")
    g = Graph.of(nodes, spark.createDataFrame([], "start_node_id string, rel_type string, end_node_id string"))
    found = g.run("MATCH (a:left) MATCH (b:right) WHERE a.town = b.town RETURN DISTINCT a.name AS name")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3 and plan.index("Aggregate", plan.index("Join"))  # either side, and the whole
    assert sorted(r.name for r in found.collect()) == ["a0", "a1", "a2"]


@pytest.mark.parametrize("statement", [
    "MATCH (x:Person), (y:Person) WHERE x.age > y.age RETURN DISTINCT x.name, y.name", "MATCH (x:Person) MATCH (y:Admin)-[r]->(z) WHERE x.name <> z.name RETURN DISTINCT elementId(x) AS x, type(r) AS t",
    "MATCH (x:Person) MATCH (y:Admin) RETURN DISTINCT x.name", "MATCH (x:Person) MATCH (y:Nobody) RETURN DISTINCT x.name", "MATCH (x:Admin)-->(z) MATCH (y:Person {name: z.name}) RETURN DISTINCT x.name, y.age",
    "MATCH (x)-->(y) MATCH (z)-->(w) MATCH (y)-->(z) RETURN DISTINCT x.name, w.name", "MATCH (x:Person) MATCH (y:Person) WHERE y.age IS NULL RETURN DISTINCT x.likes",
])
def test_distinct_equals_all_rows_made_one(people, statement):
    every = people.run(statement.replace(" DISTINCT", ""))
    want = {str(r) for r in every.collect()}
    assert sorted(str(r) for r in people.run(statement).collect()) == sorted(want)


def test_delete_order_and_limits(people):
    with pytest.raises(ValueError, match="edges"):
        people.run("MATCH (x {name: 'Ann'}) DELETE x")
    assert people.run("MATCH (x) RETURN x.name AS n ORDER BY n DESC SKIP 1 LIMIT 1").first()["n"] == "Bo's"
    people.run("MATCH ()-[r:LIKES]->() DELETE r")
    people.run("MATCH (x {name: 'Ann'}) DETACH DELETE x")
    assert people.nodes.count() == 2 and people.edges.count() == 0
    assert rows(people, "MATCH (x)-[r]->(y) RETURN count(r) AS n") == [(0,)]


@pytest.mark.parametrize("bad", ["FIND (x)", "MATCH (x RETURN x", "MATCH (x)-[*1..3]->(y) RETURN x", "MATCH (x) RETURN size(x)", "CREATE (a)-[:X]-(b)", "MATCH (x) RETURN x FOO", "OPTIONAL MATCH (x)"])
def test_errors(people, bad):
    with pytest.raises(SyntaxError):
        people.run(bad)


def test_empty(spark):
    g = Graph(spark)
    assert g.run("") is None and g.run_script("// nothing\n;") == []
    assert rows(g, "MATCH (a)-[r]->(b) RETURN a, r, b LIMIT 50") == []
