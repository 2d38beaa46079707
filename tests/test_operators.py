"""Operators on small own fixtures."""

import pytest
from pyspark.sql import functions as F

from fablework.functions import text as Z
from fablework.operators import documents, graph, segments, similarity, triples
from fablework.sources import readers
from fablework.streaming import status


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("said", "mode", "want"), [
    ("has partOf", "UPPER_CASE", "HAS_PART_OF"), ("9 lives", "UPPER_CASE", "RELATED_TO"), ("is CTO of", "camelCase", "isCtoOf"), ("", "UPPER_CASE", "RELATED_TO"),
])
def test_sanitize_relation(spark, said, mode, want):
    assert one(spark, Z.sanitize_relation(F.lit(said), mode)) == want


def test_text_functions(spark):
    assert one(spark, Z.sanitize_node(F.lit("  the-Big house! "))) == "the_Big_house"
    assert one(spark, Z.normalize_title(F.lit("A__b -- c!"))) == "A b c"
    assert one(spark, Z.strip_fence(F.lit('```JSON\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, Z.node_label(F.lit(None).cast("string"), F.lit("x" * 30))) == "x" * 17 + "..."
    assert one(spark, Z.chunk_id(F.lit(1), F.lit(2), F.lit(3), F.lit(25.0))) == "story-1_book-2_chapter-3_p.25000"
    # 751 of 4000 characters: the double of 18.775 times 100 lies below 1877.5
    assert one(spark, Z.chunk_id(F.lit(1), F.lit(2), F.lit(3), Z.rounded(F.lit(751) * 100 / F.lit(4000), 2))) == "story-1_book-2_chapter-3_p.18770"
    assert [one(spark, Z.rounded(F.lit(x).cast("double"), 2)) for x in (18.785, -0.125, 3.0, None)] == [18.79, -0.13, 3.0, None]
    assert one(spark, Z.chapter_list(F.lit(" a \n\n b"))) == ["a", "b"]


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "A", "x"), ("b", "B", "x"), ("c", "C", "x"), ("d", "D", "x")], "element_id string, name string, label string")
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("a", "R", "a")], "start_node_id string, rel_type string, end_node_id string")
    assert {r[0]: r[1] for r in graph.degree(nodes, edges).collect()} == {"a": 2, "b": 2, "c": 1, "d": 0}
    t = graph.all_triples(nodes, edges)
    assert [graph.neighbourhood(t, "c", k).count() for k in (0, 1, 2, 3)] == [0, 1, 2, 3]
    assert {r[0]: r[1] for r in graph.path_lengths(edges, "a").collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        graph.by_ranked_degree(nodes, edges, 0)
    with pytest.raises(KeyError):
        graph.subgraph_by_nodes(t, nodes, ("nothing",))
    walk = graph.random_walk(edges, nodes, 4, 3)
    assert sorted(walk.collect()) == sorted(graph.random_walk(edges, nodes, 4, 3).collect())
    hub = spark.createDataFrame([("h", "R", f"n{i}") for i in range(50)], "start_node_id string, rel_type string, end_node_id string")
    numbers = graph._numbered(hub, 7).select("k", "end_node_id", "out").collect()  # in eight blocks
    assert sorted(r["k"] for r in numbers) == list(range(50)) and len({r["end_node_id"] for r in numbers}) == 50 and {r["out"] for r in numbers} == {50}
    assert graph.random_walk(hub, nodes.limit(0).union(spark.createDataFrame([("h", "H", "x")], nodes.schema)), 1, 400, block=7).count() > 40
    assert {r[1] for r in graph.communities(nodes, edges).where("element_id = 'd'").collect()} == {"d"}


def test_triples(spark):
    cases = [
        ('[{"s": ["a", "b"], "r": "x", "o": "y"}]', 2), ('{"s": ["a", "b"], "r": ["p", "q"], "o": "y"}', 2), ('{"s": ["a", "b", "c"], "r": ["p", "q"], "o": "y"}', 6),
        ('{"subject": ["a", "b"], "rels": [{"r": "x", "o": "y"}, {"r": "", "o": "z"}]}', 2), ('{"s": "a", "rels": [{"r": "", "o": ""}]}', 0),
    ]
    for text, n in cases:
        assert triples.parse(spark.createDataFrame([(text,)], "j string"), "j").count() == n, text


def test_documents_and_chunks(spark):
    d = spark.createDataFrame([(1, [(1, "x"), (2, "y")], ["p", "q"]), (2, None, [])], "id int, a array<struct<n int, s string>>, b array<string>")
    f = documents.flatten(d)
    assert f.columns == ["id", "a.n", "a.s", "b"] and f.count() == 5
    s = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([5, 5, 20, 3])], "doc_id int, pos int, text string")
    assert [len(r[2]) for r in segments.pack(s, ["doc_id"], 12).orderBy("chunk").collect()] == [11, 20, 3]
    assert segments.pack(s, ["doc_id"], 0).count() == 1


def test_readers(spark, tmp_path):
    assert readers.split_statements("a 'x;y' -- c;\n; /* ; */ b") == ["a 'x;y'", "b"]
    p = tmp_path / "a.tei"
    p.write_text('<TEI><div><head>One</head><p>a <b>bold</b>\n word</p><div><p> </p><p>z</p></div></div></TEI>')
    assert [tuple(r)[1:4] + (r.text,) for r in readers.tei(spark, str(p)).orderBy("paragraph").collect()] == [(1, "One", 1, "a bold word"), (2, "", 2, "z")]
    with readers.temporary_database(spark, "tmp_db"), pytest.raises(ValueError):
        readers.create_database(spark, "tmp_db")


def test_similarity_and_streams(spark):
    a = spark.createDataFrame([("great big book",), ("other",)], "t string")
    b = spark.createDataFrame([("book big great",), ("none",)], "t string")
    assert [(r.l, r.r, r.score) for r in similarity.fuzzy_join(a, b, "t").collect()] == [("great big book", "book big great", 100.0)]
    e = spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (1, "y", "2024-01-01 00:01:00")], "k int, s string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert status.latest_status(e, ["k"], "s", "ts").first()["s"] == "y"
    assert status.counts_by_window(e, "ts", "k").first()["n"] == 2


@pytest.mark.parametrize(("said", "want"), [
    ('{"a": 1, // x\n "b": [1, 2, /* , */ ],}', '{"a": 1, "b": [1, 2 ]}'),
    ('{"u": "http://x/*y*/,}",\t\n"q": "a \\" // b  c"}', '{"u": "http://x/*y*/,}", "q": "a \\" // b  c"}'),
    ("", ""), ("  /* only */ ", ""), ("{} // end", "{}"), ("{} /* open", "{}"), ('{"a": "open // x', '{"a": "open // x'), ("a \\", "a \\"), (None, None),
])
def test_json_repair(spark, said, want):
    assert one(spark, Z.json_repair(F.lit(said).cast("string"))) == want


def test_json_repair_long_string(spark):
    said = '{"a": "' + "x\\n" * 200_000 + '",}'
    assert one(spark, Z.json_repair(F.lit(said))) == said[:-2] + "}"


def test_metrics_payload(spark):
    import json

    made = json.loads(one(spark, Z.metrics_payload(F.lit(7), F.lit("T"), F.lit(None).cast("string"), F.lit("g"), {"P": (F.lit(0.5), F.lit(1.0), F.lit(None).cast("double"))}, {"S": F.lit(2.0)})))
    assert made == {
        "BookID": "7", "BookTitle": "T", "SummaryText": None, "GoldSummaryText": "g", "QAResults": [],
        "Metrics": {"PRF1Metrics": [{"Name": "P", "Precision": 0.5, "Recall": 1.0, "F1Score": None}], "ScalarMetrics": [{"Name": "S", "Value": 2.0}], "QA": {"QAItems": []}},
    }


def test_pack_long_segments(spark):
    rows = [(1, 0, "a b."), (1, 1, "One two. Three four! Five? Sixsixsixsixsixsixsix."), (1, 2, "Five? Six. Seven eig."), (1, 3, "c d"), (1, 4, "e f"), (2, 0, "")]
    made = segments.pack(spark.createDataFrame(rows, "k int, pos int, text string"), ["k"], 20).orderBy("k", "chunk").collect()
    assert [(r.k, r.chunk, r.text) for r in made] == [
        (1, 0, "a b."), (1, 1, "One two. Three four!"), (1, 2, "Five?"), (1, 3, "Sixsixsixsixsixsixsix."),
        (1, 4, "Five? Six."), (1, 5, "Seven eig."), (1, 6, "c d\ne f"), (2, 0, ""),
    ]


def test_decoded_triples_and_prompts(spark):
    said = {"a b likes c d sees e": [("a", "likes", "b"), ("c", "sees", "d")], "a b": [], "": [], "a  r": [], None: None}
    for text, want in said.items():
        got = one(spark, triples.from_decoded(F.lit(text).cast("string")))
        assert (got if got is None else [tuple(t) for t in got]) == want, text
    assert one(spark, Z.prompt("Do.", F.lit(None).cast("string"), Z.one_line(F.lit(" a\nb ")))) == "Do.\n\nText:\na b"
    assert readers.split_graph_statements("CREATE (a {n: 'x;y'}); // no; \n /* ; */ MATCH (b) RETURN \"q\\\";\"; ;") == ["CREATE (a {n: 'x;y'})", 'MATCH (b) RETURN "q\\";"']


def test_transitions_and_scores(spark):
    from fablework.operators import tracking

    rows = [(1, "completed", 1), (1, "started", 2), (1, "started", 5), (1, "failed", 9), (2, "started", 1), (2, "assigned", 3)]
    e = spark.createDataFrame(rows, "k int, status string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.s): r.elapsed for r in tracking.transitions(e, ["k"], "status", ["ts"], "ts").collect()}
    assert got == {(1, 1): None, (1, 2): None, (1, 5): None, (1, 9): 4.0, (2, 1): None, (2, 3): None}
    notes = spark.createDataFrame([(1, ["q"], None), (1, [], []), (2, None, ["t"])], "k int, q array<string>, t array<string>")
    assert sorted(map(tuple, tracking.clear_share(notes, ["k"], "q", "t").collect())) == [(1, 0.5), (2, 0.0)]
    vectors = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]]), ([], [[1.0]])], "a array<array<double>>, b array<array<double>>")
    assert [r[0] and tuple(r[0]) for r in vectors.select(similarity.greedy_match(F.col("a"), F.col("b"))).collect()] == [(0.5, 1.0, 2 / 3), None]
    named = spark.createDataFrame([("a", "r", str(i)) for i in range(7)] + [("b", "r", "x")], "subject string, relation string, object string")
    assert sorted(map(tuple, graph.context(named, 2).collect())) == [("a", "r 0; r 1"), ("b", "r x")]


def test_fuzzy_join_loses_no_pair(spark):
    import random

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def score(x, y):
        x, y = (" ".join(sorted(t.split())) for t in (x, y))
        return 200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abeilnorst") for _ in range(rnd.randrange(3, 9)))
    typo = lambda w: (lambda i: w[:i] + rnd.choice(("", "x", w[i] + "q")) + w[i + 1 :])(rnd.randrange(len(w)))
    titles = [" ".join(word() for _ in range(rnd.randrange(1, 7))) for _ in range(90)]
    typed = [" ".join(rnd.sample(ws := [typo(w) for w in t.split()], len(ws))) for t in titles]
    one = [t[:-1] + "y" for t in titles]
    sides = [*titles, "Alexandria", "blue-metal", "", "  ", "zzz"], [*typed, *one, "Alexandrla", "blue metal", "", "ça"]
    left, right = (spark.createDataFrame([(t,) for t in [*side, None]], "t string") for side in sides)
    for threshold in (70.0, 90.0, 100.0):
        want = {}
        for x in set(sides[0]):
            s, y = min((-score(x, y), y) for y in set(sides[1]))
            if -s >= threshold:
                want[x] = (y, -s)
        got = similarity.fuzzy_join(left, right, "t", threshold).collect()
        assert {r.l: (r.r, r.score) for r in got} == want and len(got) == len(want), threshold
        if threshold == 90:
            assert want["Alexandria"] == ("Alexandrla", 90.0) and want["blue-metal"] == ("blue metal", 90.0)
            assert any(not set(x.split()) & set(y.split()) for x, (y, _) in want.items() if len(x.split()) > 1)
    other = F.pandas_udf(lambda a, b: (a.str[0] == b.str[0]) * 95.0, "double")
    got = similarity.fuzzy_join(spark.createDataFrame([("ab",)], "t string"), spark.createDataFrame([("ad",), ("ac",)], "t string"), "t", 90.0, other)
    assert [tuple(r) for r in got.collect()] == [("ab", "ac", 95.0)]


@pytest.mark.parametrize(("text", "want"), [
    ('{"s":"A","facts":[{"r":"x","o":"B"}]}', [("A", "x", "B")]),
    ('{"z": [{"relation": "x", "object_": "B"}, {"r": "", "relation": "y", "o": "", "object": "C"}], "s": ["A", "D"], "b": [{"r": "n", "o": "n"}]}',
     [("A", "x", "B"), ("A", "y", "C"), ("D", "x", "B"), ("D", "y", "C")]),
    ('[{"subject": "A", "note": "[{", "n": 1, "e": [], "w": ["x"], "a \'b.c": [{"r": "x", "o": 7}]}, {"s": "A", "r": "y", "o": ["B"]}]', [("A", "x", "7"), ("A", "y", "B")]),
    ('{"s": "A", "b": [{"r": "x", "o": "1"}], "a": [{"r": "y", "o": "2"}]}', [("A", "x", "1")]),
    ('```json\n{"s": "A", "r": "x", "o": "B", "facts": [{"q": 1}]}\n```', []),
])
def test_nested_pairs_under_any_key(spark, text, want):
    assert sorted(map(tuple, triples.parse(spark.createDataFrame([(text,)], "j string"), "j").collect())) == want


def test_html_paragraphs_without_closing_tags(spark):
    html = '<body><div><p>a <b>b</b><p class="x">c\nd</p>no<P>e</div><p><pre>no</pre><ul><li><p>f<li>no</ul><param><p>g<picture>h'
    assert one(spark, Z.html_paragraphs(F.lit(html))) == ["a <b>b</b>", "c\nd", "e", "", "f", "g<picture>h"]
    assert one(spark, Z.html_paragraphs(F.lit("<p>" + "x" * 300_000))) == ["x" * 300_000]


def test_path_lengths_of_a_long_way(spark):
    chain = [(f"n{i}", "R", f"n{i + 1}") for i in range(23)] + [("n23", "R", "n0"), ("x", "R", "n3")]
    edges = spark.createDataFrame(chain, "start_node_id string, rel_type string, end_node_id string").coalesce(1)
    assert {r[0]: r[1] for r in graph.path_lengths(edges, "n0").collect()} == {f"n{i}": i for i in range(24)}
    assert graph.path_lengths(edges, "n0", 6).count() == 7


def test_parse_tells_lists_from_scalars_by_kind(spark):
    cases = [
        ('{"s": "[x", "r": "r", "o": "o"}', [("[x", "r", "o")]), ('{"s": "A", "r": "likes", "o": "[draft] B"}', [("A", "likes", "[draft] B")]),
        ('{"s": "[]", "r": ["[a", "b]"], "o": "["}', [("[]", "[a", "["), ("[]", "b]", "[")]), ('{"s": "", "subject": ["A", "[B"], "r": 1, "o": "o"}', [("A", "1", "o"), ("[B", "1", "o")]),
        ('{"s": "[A", "facts": [{"r": "[r", "o": "[o]"}]}', [("[A", "[r", "[o]")]), ('[{"s": "A", "r": "r", "o": "o"}] trailing', []), ('{"s": [], "r": "r", "o": "o"}', []),
    ]
    for text, want in cases:
        assert sorted(map(tuple, triples.parse(spark.createDataFrame([(text,)], "j string"), "j").collect())) == want, text


def test_node_context_tells_neighbours_facts(spark):
    rows = [("A", "knows", "B"), ("B", "likes", "C"), ("D", "sees", "A"), ("D", "has", "E"), ("C", "is", "F"), ("A", "knows", "B"), (None, "r", "A"), ("A", "meets", "D")]
    facts = spark.createDataFrame(rows, "subject string, relation string, object string")
    got = sorted(map(tuple, graph.node_context(facts, "A").collect()))
    assert got == [("in", "D sees A"), ("in", "r A"), ("near", "B likes C"), ("near", "D has E"), ("out", "A knows B"), ("out", "A meets D")]
    assert {r.direction for r in graph.node_context(facts, "A", neighbours=False).collect()} == {"out"} and graph.node_context(facts, "X").count() == 0


def test_tables_of_single_steps_are_deleted(spark, tmp_path, monkeypatch):
    import os
    import uuid

    from fablework import checkpoints
    from fablework.operators import communities

    chain = [(f"n{i}", "R", f"n{i + 1}") for i in range(12)]
    edges = spark.createDataFrame(chain, "start_node_id string, rel_type string, end_node_id string").coalesce(1)
    nodes = edges.select(F.col("start_node_id").alias("element_id"))
    monkeypatch.setattr(checkpoints, "shared_folder", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    left = []
    for run in (lambda: graph.random_walk(edges, nodes, 3), lambda: communities.detect(nodes, edges, "label_propagation"), lambda: communities.detect(nodes, edges, "leiden"),
                lambda: graph.path_lengths(edges, "n0"), lambda: graph.neighbourhood(graph.all_triples(nodes.union(edges.select("end_node_id")).distinct(), edges), "n3", 4)):
        had = len(os.listdir(tmp_path))
        assert run().count() > 0
        left.append(len(os.listdir(tmp_path)) - had)
    assert left[:2] == [1, 1] and left[2] <= 4 and left[3] <= 5 and left[4] == 1


def test_walks_make_their_edges_once(spark):
    """The edges' plan, of joins and a distinct, was run for the degrees and again for the numbers."""
    import random

    from pyspark.sql import functions as F

    seen, rnd = spark.sparkContext.accumulator(0), random.Random(4)
    rows = sorted({(f"n{rnd.randrange(30)}", "R", f"n{rnd.randrange(30)}") for _ in range(400)} | {("hub", "R", f"n{i}") for i in range(30)})
    names = "start_node_id string, rel_type string, end_node_id string"

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    edges = spark.createDataFrame(rows, names).mapInPandas(counted, names)
    starts = edges.select(F.col("start_node_id").alias("element_id")).distinct().localCheckpoint()
    before = seen.value
    walk = graph.random_walk(edges, starts, 3, block=7)
    assert seen.value - before == len(rows) and set(map(tuple, walk.collect())) <= set(rows)
    numbers = {(r.start_node_id, r.k): r.end_node_id for r in graph._numbered(spark.createDataFrame(rows, names), 7).collect()}
    assert len(numbers) == len(rows) and {k for s, k in numbers if s == "hub"} == set(range(30))


def test_fuzzy_join_compares_few_pairs(spark):
    import random

    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdeilmnorstu") for _ in range(rnd.randrange(4, 9))) for _ in range(400)]
    titles = sorted({" ".join(rnd.sample(words, 3)) for _ in range(2000)})
    typed = [t[:i] + "x" + t[i + 1 :] for t in titles for i in [rnd.randrange(len(t))]]
    l, r = spark.createDataFrame([(t,) for t in titles], "l string"), spark.createDataFrame([(t,) for t in typed], "r string")
    pairs = similarity._segment_pairs(l, r, 90.0)
    n = pairs.count()
    assert n < 0.01 * len(titles) * len(typed), n
    found = pairs.withColumn("s", similarity.token_sort_ratio("l", "r")).where("s >= 90").count()
    every = l.crossJoin(r).withColumn("s", similarity.token_sort_ratio("l", "r")).where("s >= 90").count()
    assert found == every > 1000


def test_quantile_is_exact(spark):
    import random

    import numpy as np

    from fablework.operators import tracking

    rnd = random.Random(3)
    rows = [("a", rnd.choice([1.0, 2.5, rnd.random() * 9])) for _ in range(999)] + [("b", 4.0), (None, 1.0), (None, 2.0), ("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for q in (0.0, 0.37, 0.9, 1.0):
        got = {r.g: r.quantile for r in tracking.quantile(df, "g", "v", q).collect()}
        want = np.quantile([v for g, v in rows if g == "a" and v is not None], q)
        assert abs(got["a"] - want) < 1e-12 and got["b"] == 4.0 and abs(got[None] - (1 + q)) < 1e-12 and "c" not in got
    assert tracking.quantile(df.limit(0), "g", "v", 0.5).count() == 0


def test_parsing_is_spread_over_the_cores(spark):
    """A small file is one part, but reading its JSON is not one task."""
    df = spark.createDataFrame([('```json\n{"s": "a", "r": ["x", "y"], "o": "b"}\n```',)] * 100, "j string").coalesce(1)
    got = triples.parse_strict(df, "j")
    assert got.rdd.getNumPartitions() > 1 and got.count() == 200
