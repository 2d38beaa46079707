"""Results' shapes, counts of moderation, previews, and files that are read back."""

from pyspark.sql import functions as F

from fablework.operators import documents, scope, triples
from fablework.sources import store

SHAPES = {
    '{"cursor": {"firstBatch": [1]}}': True, '{"cursor": {"firstBatch": {}}}': False, '{"cursor": 3}': False, '{"firstBatch": []}': False, '{"ok": 1}': False,
    '{"a": [], "b": ["x"]}': True, '{"a": [[1]], "b": [null]}': False, '{"a": "[1]"}': False, '{"a": [{"b": 1}]}': True, '{"a": [true]}': True, "{}": False,
    "[]": False, '[{"a": 1}]': True, '[{"a": 1}, 2]': False, "[null]": False, "3": False, '"x"': False, "null": False, "": False, "{broken": False,
}


def test_result_shapes(spark):
    df = spark.createDataFrame([(k, v) for k, v in SHAPES.items()] + [(None, False)], "j string, want boolean")
    assert [r.j for r in df.withColumn("got", documents.tabular(F.col("j"))).where("NOT (got <=> want)").collect()] == []


def test_moderation_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None), (None, "b")], "id int, source string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 1), (3, None)], "id int, bad int")
    got = triples.moderation_counts(df, labels, "id", "bad", ["source"])
    assert {tuple(r) for r in got.collect()} == {("a", 3, 1, 2), (None, 1, 1, 0), ("b", 1, 1, 0)}
    assert triples.moderation_counts(df.limit(0), labels, "id", "bad").collect()[0] == (0, 0, 0)


def test_preview_keeps_to_the_graph(spark):
    nodes = spark.createDataFrame([(str(i), f"n{i}", "d", "k" if i < 8 else "other", i == 7) for i in range(10)], "element_id string, name string, db string, kg string, _init boolean")
    edges = spark.createDataFrame([(str(a), "R", str(b)) for a in range(10) for b in range(10) if a != b], "start_node_id string, rel_type string, end_node_id string")
    got = [(r.start_node_id, r.end_node_id) for r in scope.preview(nodes, edges, "d", "k", 9).collect()]
    assert got == [(str(a), str(b)) for a in range(7) for b in range(7) if a != b][:9]


def test_files_are_read_back(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nof two lines'), (2, ""), (3, None), (4, "ça\\n")]
    df = spark.createDataFrame(rows, "id int, text string")
    store.save_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, store.load_csv(spark, str(tmp_path / "csv"), "id int, text string").collect())) == rows
    books = spark.createDataFrame([("b 1", "<TEI>\n<p>ä</p>\n</TEI>"), ("b2", None), ("b3", "<TEI/>")], "path string, tei string")
    store.save_tei(books, str(tmp_path / "tei"))
    got = {r.path: r.value for r in store.load_tei(spark, str(tmp_path / "tei")).collect()}
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    assert {k: v.rstrip("\n") for k, v in got.items()} == {"b 1": head + "<TEI>\n<p>ä</p>\n</TEI>", "b3": head + "<TEI/>"}
