"""Graph queries over the star schema: regions, nations, customers and suppliers as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as Z
from ..operators import communities as C
from ..operators import graph as G
from ..operators import scope as P
from ..operators.patterns import Graph

TOP = 40


def load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    node = lambda n, p, k, name: t(n).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("element_id"), F.col(name).alias("name"), F.lit(n).alias("label"))
    nodes = node("region", "r", "r_regionkey", "r_name").union(node("nation", "n", "n_nationkey", "n_name")).union(node("customer", "c", "c_custkey", "c_name")).union(node("supplier", "s", "s_suppkey", "s_name"))
    edge = lambda n, p, k, rel, q, o: t(n).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("start_node_id"), F.lit(rel).alias("rel_type"), F.concat(F.lit(q), F.col(o).cast("string")).alias("end_node_id"))
    edges = edge("nation", "n", "n_nationkey", "PART_OF", "r", "n_regionkey").union(edge("customer", "c", "c_custkey", "IN", "n", "c_nationkey")).union(edge("supplier", "s", "s_suppkey", "IN", "n", "s_nationkey"))
    return nodes, edges


def _starts(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'nation'").select("element_id")


def _members(nodes: DataFrame) -> DataFrame:
    return nodes.select("element_id", F.when(F.col("element_id") < "n", 0).otherwise(1).alias("community_id"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = load(spark, d)
    t = G.by_ranked_degree(nodes, edges, 1, TOP, True, ("subject_id",))
    said = G.verbalise(G.named(t, nodes)).select("line")
    # TOP nodes have TOP out-edges or so here: a short text
    return said.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a denser graph: customers buy parts, parts come from suppliers; (start_node_id, rel_type, end_node_id)."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda a, rel, b: (a.alias("start_node_id"), F.lit(rel).alias("rel_type"), b.alias("end_node_id"))
    bought = lines.join(t("orders"), lines.l_orderkey == F.col("o_orderkey")).select(*edge(at("c", "o_custkey"), "BUYS", at("p", "l_partkey")))
    return bought.union(lines.select(*edge(at("p", "l_partkey"), "FROM", at("s", "l_suppkey")))).distinct()


def _triples(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("start_node_id").alias("subject_id"), F.col("rel_type").alias("relation_id"), F.col("end_node_id").alias("object_id"))


def _sales_khop(k: int):
    return lambda spark, d: G.neighbourhood(_triples(sales(spark, d)), "s1", k)


def _preview(spark: SparkSession, d: str) -> DataFrame:
    """The first edges of the graph without every second nation."""
    nodes, edges = load(spark, d)
    odd = (F.col("label") == "nation") & (F.substring("element_id", 2, 9).cast("int") % 2 == 1)
    return P.preview(nodes.select("*", F.when(odd, "other").otherwise("main").alias("db"), F.lit("all").alias("kg")), edges, "main", "all")


def _scoped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The star schema's elements, each node in a graph named by its kind, odd nations in another database, regions dummies."""
    nodes, edges = load(spark, d)
    db = F.when((F.col("label") == "nation") & (F.substring("element_id", 2, 9).cast("int") % 2 == 1), "other").otherwise("main")
    return nodes.withColumns({"db": db, "kg": F.col("label"), "_init": F.col("label") == "region"}), edges.withColumn("db", F.lit(None).cast("string"))


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose labels need sanitising: part names with the words of their types, some blank."""
    p = spark.read.parquet(f"{d}/part.parquet")
    blank = F.when(F.col("p_partkey") % 50 == 0, F.lit(" - ")).otherwise(F.concat(F.lit("the "), "p_name"))
    return p.select(blank.alias("s"), F.lower("p_type").alias("r"), F.concat("p_brand", F.lit("!")).alias("o"))


def _q(f):
    return lambda spark, d: f(*load(spark, d))


def _said(statement: str):
    return _q(lambda n, e: Graph.of(n, e).run(statement))


def _grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A group for each region's name, made once, and its nations as members."""
    g = Graph.of(nodes, edges)
    g.run("MATCH (n:nation)-[:PART_OF]->(r:region) MERGE (g:group {name: r.name}) CREATE (n)-[:MEMBER {of: r.name}]->(g)")
    return g.run("MATCH (n)-[m:MEMBER]->(g:group) WHERE m.of = g.name RETURN g.name AS name, collect(n.name) AS nations")


NAMES = ["subject", "relation", "object"]
QUERIES = {
    "triples_properties": _q(lambda n, e: G.triple_properties(n, e).select(*(F.col(f"`{a}`").alias(b) for a, b in (("r.rel_type", "rel_type"), ("n1.element_id", "n1_id"), ("n1.name", "n1_name"), ("n1.label", "n1_label"), ("n2.element_id", "n2_id"), ("n2.name", "n2_name"), ("n2.label", "n2_label"))))),
    "triples_named": _q(lambda n, e: G.named(G.all_triples(n, e), n)),
    "subgraph_by_nodes": _q(lambda n, e: G.subgraph_by_nodes(G.all_triples(n, e), _starts(n))),
    **{f"khop_{k}": _q(lambda n, e, k=k: G.neighbourhood(G.all_triples(n, e), "s1", k)) for k in (1, 2, 3)},
    "node_degree": _q(G.degree),
    "top_nodes_named": _q(lambda n, e: G.top_by_degree(G.degree(n, e), 10).join(n.select("element_id", "name"), "element_id").select("name", "edge_count")),
    "degree_dense_rank": _q(lambda n, e: G.dense_rank_by_degree(G.degree(n, e))),
    "ranked_subgraph": _q(lambda n, e: G.by_ranked_degree(n, e, 1, 3)),
    "ranked_enforce_count": _q(lambda n, e: G.by_ranked_degree(n, e, 2, 6, True)),
    "degree_range": _q(lambda n, e: G.subgraph_by_nodes(G.all_triples(n, e), G.degree(n, e).where("edge_count between 2 and 20").select("element_id"))),
    "graph_ranked_verbalize": _lines,
    "verbalize_natural": _q(lambda n, e: G.verbalise(G.named(G.all_triples(n, e), n), "natural").select("line")),
    "verbalize_json": _q(lambda n, e: G.verbalise(G.named(G.all_triples(n, e), n), "json").select("line")),
    "shortest_path_len": _q(lambda n, e: G.path_lengths(e, "c1")),
    "community_subgraph": _q(lambda n, e: G.community_subgraph(G.all_triples(n, e), _members(n), 1)),
    "undirected_pair_index": _q(lambda n, e: G.pair_index(e)),
    "relation_summary": _q(lambda n, e: G.relation_summary(G.named(G.all_triples(n, e), n))),
    "graph_stats": _q(G.statistics),
    "triple_upsert": _q(lambda n, e: (lambda t: G.upsert(t, t.union(t)))(G.named(G.all_triples(n, e), n).toDF("s", "r", "o"))),
    "graph_scan": _q(lambda n, e: n.unionByName(e, allowMissingColumns=True).distinct()),
    "distinct_values": _q(lambda n, e: n.select("label").distinct()),
    "graph_context": _q(lambda n, e: G.context(G.named(G.all_triples(n, e), n))),
    "random_walk": _q(lambda n, e: G.random_walk(e, n.where("label = 'customer'").select("element_id"), 3)),
    "community_detect": _q(C.detect),
    "community_leiden": _q(lambda n, e: C.detect(n, e, "leiden")),
    "community_levels": _q(lambda n, e: C.detect(n, e, multi_level=True)),
    "label_propagation": _q(lambda n, e: C.detect(n, e, "label_propagation")),
    "pattern_path": _said("MATCH (c:customer)-[:IN]->(n:nation)-[:PART_OF]->(r:region) WHERE r.name <> 'ASIA' RETURN r.name AS region, n.name AS nation, count(c) AS customers"),
    "pattern_neighbours": _said("MATCH (a)-[x]-(b:nation) RETURN a.name AS a, type(x) AS x, b.name AS b"),
    "pattern_values": _said("MATCH (a:customer)-[:IN]->(n) MATCH (s:supplier)-[:IN]->(m) WHERE m.name = n.name RETURN DISTINCT a.name AS customer, m.name AS nation"),
    "pattern_merge": lambda s, d: _grouped(*load(s, d)).selectExpr("name", "array_join(nations, ', ') AS nations"),
    "sales_edges": sales,
    **{f"sales_khop_{k}": _sales_khop(k) for k in (1, 2)},
    "sales_walk": lambda s, d: G.random_walk(sales(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("element_id")), 3),
    "graph_preview": _preview,
    "scoped_scan": lambda s, d: P.scan(*_scoped(s, d), "main", "nation").drop("_init"),
    "scoped_fetch": lambda s, d: (lambda n, e: P.fetch(n, e, n.where("kg = 'supplier'")).select("element.element_id", "element.name", "element.db"))(*_scoped(s, d)),
    "scoped_drop": lambda s, d: (lambda n, _: P.drop_graph(n, "main", "nation").drop("_init"))(*_scoped(s, d)),
    "retagged_edges": lambda s, d: P.retag(_scoped(s, d)[1], "main"),
    "in_database": lambda s, d: P.in_database(_scoped(s, d)[0], "main"),
    "value_join": lambda s, d: P.value_join(
        load(s, d)[0].where("label = 'customer'").withColumn("number", F.regexp_extract("name", "#0*([0-9]+)", 1)),
        s.read.parquet(f"{d}/clients.parquet").select(F.col("client_id").cast("string").alias("element_id"), F.col("master_id").cast("string").alias("master")), "number", "master"),
    "node_context": _q(lambda n, e: G.node_context(G.named(G.all_triples(n, e), n), "NATION_1")),
    "focused_context": _q(lambda n, e: G.focused_context(G.named(G.all_triples(n, e), n), n.where("label = 'nation'").select("name"))),
    "narrative_cluster": _q(lambda n, e: G.narrative(G.named(G.all_triples(n, e), n), "cluster")),
    "narrative_summary": _q(lambda n, e: G.narrative(G.named(G.all_triples(n, e), n))),
    "upsert_sanitized": lambda s, d: G.upsert_sanitized(None, _dirty(s, d)),
    "concatenated_triples": _q(lambda n, e: G.concatenated(G.named(G.all_triples(n, e), n).toDF("s", "r", "o").withColumn("chunk", F.col("o")), ["chunk"])),
}

G_SQL = """nodes AS (
  SELECT 'r' || r_regionkey AS element_id, r_name AS name, 'region' AS label FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier),
edges AS (
  SELECT 'n' || n_nationkey AS start_node_id, 'PART_OF' AS rel_type, 'r' || n_regionkey AS end_node_id FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'IN', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'IN', 'n' || s_nationkey FROM supplier),
t AS (SELECT a.element_id AS subject_id, rel_type AS relation_id, b.element_id AS object_id, a.name AS subject, rel_type AS relation, b.name AS object
  FROM edges JOIN nodes a ON a.element_id = start_node_id JOIN nodes b ON b.element_id = end_node_id),
ends AS (SELECT start_node_id AS element_id FROM edges UNION ALL SELECT end_node_id FROM edges WHERE end_node_id <> start_node_id),
deg AS (SELECT element_id, count(e.element_id)::BIGINT AS edge_count FROM nodes LEFT JOIN ends e USING (element_id) GROUP BY element_id),
rk AS (SELECT *, dense_rank() OVER (ORDER BY edge_count DESC)::INTEGER AS rank, row_number() OVER (ORDER BY edge_count DESC, element_id) AS place FROM deg)"""
IDS = "subject_id, relation_id, object_id"


def _sql(q: str) -> str:
    return f"WITH {G_SQL} {q}"


def _either(cond: str) -> str:
    return _sql(f"SELECT DISTINCT {IDS} FROM t WHERE subject_id IN (SELECT element_id FROM {cond}) OR object_id IN (SELECT element_id FROM {cond})")


def _khop(k: int) -> str:
    return f"""WITH RECURSIVE {G_SQL}, und AS (SELECT subject_id AS a, object_id AS b FROM t UNION SELECT object_id, subject_id FROM t),
reach(id, d) AS (SELECT 's1', 0 UNION SELECT b, d + 1 FROM reach JOIN und ON a = id WHERE d < {k - 1})
SELECT DISTINCT {IDS} FROM t WHERE subject_id IN (SELECT id FROM reach) OR object_id IN (SELECT id FROM reach)"""


SALES = """sales AS (SELECT DISTINCT 'c' || o_custkey AS subject_id, 'BUYS' AS relation_id, 'p' || l_partkey AS object_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT DISTINCT 'p' || l_partkey, 'FROM', 's' || l_suppkey FROM lineitem)"""
SCOPED = """scoped AS (SELECT *, CASE WHEN label = 'nation' AND substr(element_id, 2)::INTEGER % 2 = 1 THEN 'other' ELSE 'main' END AS db, label AS kg FROM nodes)"""
NEVER = "NULL::VARCHAR"


ORACLES = {
    "pattern_path": _sql("""SELECT r.name AS region, n.name AS nation, count(*) AS customers FROM nodes c JOIN edges x ON x.start_node_id = c.element_id JOIN nodes n ON n.element_id = x.end_node_id
JOIN edges y ON y.start_node_id = n.element_id JOIN nodes r ON r.element_id = y.end_node_id WHERE c.label = 'customer' AND r.label = 'region' AND r.name <> 'ASIA' GROUP BY r.name, n.name"""),
    "pattern_neighbours": _sql("""SELECT object AS a, relation AS x, subject AS b FROM t WHERE subject_id LIKE 'n%'
UNION ALL SELECT subject, relation, object FROM t WHERE object_id LIKE 'n%'"""),
    "pattern_values": """SELECT DISTINCT c_name AS customer, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey""",
    "pattern_merge": "SELECT r_name AS name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
    "sales_edges": f"WITH {SALES} SELECT subject_id AS start_node_id, relation_id AS rel_type, object_id AS end_node_id FROM sales",
    "sales_khop_1": f"WITH {SALES} SELECT * FROM sales WHERE subject_id = 's1' OR object_id = 's1'",
    "sales_khop_2": f"WITH {SALES}, r AS (SELECT 's1' AS id UNION SELECT subject_id FROM sales WHERE object_id = 's1') SELECT * FROM sales WHERE subject_id IN (SELECT id FROM r) OR object_id IN (SELECT id FROM r)",
    "graph_preview": _sql("""SELECT start_node_id, rel_type, end_node_id, a.name AS start_name, b.name AS end_name
        FROM edges JOIN nodes a ON a.element_id = start_node_id JOIN nodes b ON b.element_id = end_node_id
        WHERE NOT (a.label = 'nation' AND substr(a.element_id, 2)::INTEGER % 2 = 1) AND NOT (b.label = 'nation' AND substr(b.element_id, 2)::INTEGER % 2 = 1)
        ORDER BY 1, 2, 3, 4, 5 LIMIT 50"""),
    "scoped_scan": _sql(f"""SELECT * FROM (WITH {SCOPED}, own AS (SELECT * FROM scoped WHERE db = 'main' AND kg = 'nation')
SELECT element_id, name, label, db, kg, 'node' AS element_type, {NEVER} AS start_node_id, {NEVER} AS rel_type, {NEVER} AS end_node_id FROM own
UNION SELECT NULL, NULL, NULL, NULL, NULL, 'relationship', start_node_id, rel_type, end_node_id FROM edges
WHERE start_node_id IN (SELECT element_id FROM own) OR end_node_id IN (SELECT element_id FROM own))"""),
    "scoped_fetch": _sql(f"SELECT * FROM (WITH {SCOPED} SELECT element_id, name, db FROM scoped WHERE kg = 'supplier')"),
    "scoped_drop": _sql(f"SELECT * FROM (WITH {SCOPED} SELECT * FROM scoped WHERE NOT (db = 'main' AND kg = 'nation'))"),
    "retagged_edges": _sql("SELECT *, 'main' AS db FROM edges"),
    "in_database": _sql(f"SELECT * FROM (WITH {SCOPED} SELECT * FROM scoped WHERE db = 'main' AND label <> 'region')"),
    "value_join": _sql("SELECT 'c' || c_custkey AS left_id, client_id::VARCHAR AS right_id FROM customer JOIN clients ON master_id::VARCHAR = regexp_extract(c_name, '#0*([0-9]+)', 1)"),
    "node_context": _sql("""SELECT DISTINCT CASE WHEN subject = 'NATION_1' THEN 'out' WHEN object = 'NATION_1' THEN 'in' ELSE 'near' END AS direction, subject || ' ' || relation || ' ' || object AS line
FROM t WHERE subject = 'NATION_1' OR object = 'NATION_1' OR subject IN (SELECT object FROM t WHERE subject = 'NATION_1' UNION ALL SELECT subject FROM t WHERE object = 'NATION_1')"""),
    "focused_context": _sql("SELECT subject, string_agg(relation || ' ' || object, '; ' ORDER BY k) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY relation, object) AS k FROM t WHERE subject IN (SELECT n_name FROM nation)) WHERE k <= 5 GROUP BY subject"),
    "narrative_cluster": _sql("""SELECT (row_number() OVER (ORDER BY k, line) - 1)::INTEGER AS place, line FROM (SELECT -count(*) OVER (PARTITION BY subject) AS k,
subject || ' ' || lower(replace(relation, '_', ' ')) || ' ' || object || '.' AS line FROM t) ORDER BY k, line LIMIT 50"""),
    "narrative_summary": _sql("""SELECT (row_number() OVER (ORDER BY k, line) - 1)::INTEGER AS place, line FROM (SELECT -count(*) AS k,
relation || ' occurs ' || count(*) || ' times, as in ' || min(subject || ' ' || relation || ' ' || object) || '.' AS line FROM t GROUP BY relation)"""),
    "upsert_sanitized": """SELECT DISTINCT s, r, o FROM (SELECT CASE WHEN p_partkey % 50 <> 0 THEN trim(regexp_replace('the ' || p_name, '[^A-Za-z0-9]+', '_', 'g'), '_') END AS s,
upper(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(p_type), '[^a-z0-9_ ]', '_', 'g'), '[_ ]+'), lambda x: x <> ''), '_')) AS r,
trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_') AS o FROM part) WHERE s IS NOT NULL""",
    "concatenated_triples": _sql("""SELECT object AS chunk, string_agg('{"s":"' || subject || '","r":"' || relation || '","o":"' || object || '"}', chr(10) ORDER BY '{"s":"' || subject || '","r":"' || relation || '","o":"' || object || '"}') AS text FROM t GROUP BY object"""),
    "triples_properties": _sql("SELECT rel_type, a.element_id AS n1_id, a.name AS n1_name, a.label AS n1_label, b.element_id AS n2_id, b.name AS n2_name, b.label AS n2_label FROM edges JOIN nodes a ON a.element_id = start_node_id JOIN nodes b ON b.element_id = end_node_id"),
    "triples_named": _sql("SELECT subject, relation, object FROM t"),
    "subgraph_by_nodes": _either("(SELECT element_id FROM nodes WHERE label = 'nation')"),
    **{f"khop_{k}": _khop(k) for k in (1, 2, 3)},
    "node_degree": _sql("SELECT * FROM deg"),
    "top_nodes_named": _sql("SELECT name, edge_count FROM rk JOIN nodes USING (element_id) WHERE place <= 10"),
    "degree_dense_rank": _sql("SELECT element_id, edge_count, rank FROM rk"),
    "ranked_subgraph": _either("(SELECT * FROM rk WHERE rank <= 3)"),
    "ranked_enforce_count": _either("(SELECT * FROM rk WHERE place BETWEEN 2 AND 6)"),
    "degree_range": _either("(SELECT * FROM deg WHERE edge_count BETWEEN 2 AND 20)"),
    "graph_ranked_verbalize": _sql(f"SELECT string_agg(subject || ' ' || relation || ' ' || object, chr(10) ORDER BY subject || ' ' || relation || ' ' || object) AS text FROM t WHERE subject_id IN (SELECT element_id FROM rk WHERE place <= {TOP})"),
    "verbalize_natural": _sql("SELECT subject || ' ' || lower(replace(relation, '_', ' ')) || ' ' || object || '.' AS line FROM t"),
    "verbalize_json": _sql("""SELECT '{"s":"' || subject || '","r":"' || relation || '","o":"' || object || '"}' AS line FROM t"""),
    "shortest_path_len": f"WITH RECURSIVE {G_SQL}, reach(element_id, hops) AS (SELECT 'c1', 0 UNION SELECT end_node_id, hops + 1 FROM reach JOIN edges ON start_node_id = element_id) SELECT element_id, min(hops)::INTEGER AS hops FROM reach GROUP BY element_id",
    "community_subgraph": _sql(f"SELECT {IDS} FROM t WHERE subject_id >= 'n' AND object_id >= 'n'"),
    "undirected_pair_index": _sql("SELECT start_node_id, rel_type, end_node_id, least(start_node_id, end_node_id) AS low, greatest(start_node_id, end_node_id) AS high, (row_number() OVER (PARTITION BY least(start_node_id, end_node_id), greatest(start_node_id, end_node_id) ORDER BY start_node_id, rel_type, end_node_id) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY least(start_node_id, end_node_id), greatest(start_node_id, end_node_id)) AS of FROM edges"),
    "relation_summary": _sql("SELECT relation, count(*) AS n, min(subject || ' ' || relation || ' ' || object) AS example FROM t GROUP BY relation"),
    "graph_stats": _sql("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT rel_type) FROM edges) AS relation_types, (SELECT avg(edge_count) FROM deg) AS avg_degree, (SELECT count(*) FROM edges)::DOUBLE / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)) AS density, (SELECT string_agg(DISTINCT rel_type, ', ' ORDER BY rel_type) FROM edges) AS relations, (SELECT string_agg(name || ' (' || edge_count || ')', ', ' ORDER BY place) FROM rk JOIN nodes USING (element_id) WHERE place <= 5) AS top_nodes"),
    "triple_upsert": _sql("SELECT DISTINCT subject AS s, relation AS r, object AS o FROM t"),
    "graph_scan": _sql("SELECT DISTINCT element_id, name, label, NULL::VARCHAR AS start_node_id, NULL::VARCHAR AS rel_type, NULL::VARCHAR AS end_node_id FROM nodes UNION SELECT NULL, NULL, NULL, start_node_id, rel_type, end_node_id FROM edges"),
    "graph_context": _sql("SELECT subject, string_agg(relation || ' ' || object, '; ' ORDER BY k) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY relation, object) AS k FROM t) WHERE k <= 5 GROUP BY subject"),
    "distinct_values": _sql("SELECT DISTINCT label FROM nodes"),
}
