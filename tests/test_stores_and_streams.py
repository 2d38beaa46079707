"""Collections, commands, readers, task streams, model wrappers and communities on small own data."""

import io
import json
import threading
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from fablework.operators import communities as C
from fablework.operators import documents as D
from fablework.operators import graph as G
from fablework.operators import segments as S
from fablework.operators import similarity as M
from fablework.operators import tracking as K
from fablework.operators import triples as J
from fablework.sources import readers as R
from fablework.sources import store as W
from fablework.streaming import status as ST
from fablework.tasks import Registry

MIXED = [
    '{"t":"Oil","with":["a","b","c"],"does":["x","y"]}', '{"t":"Soup","with":["a","b","c"]}', '{"t":"Fog","with":"r","does":{"text":"quiet"}}',
    '{"t":"Brew","with":["s","f"],"does":"cold"}', '{"t":"Tea","does":{"secs":12.5,"cost":6.95}}',
    '{"t":"Mix","with":[{"name":"m","from":"A"},{"name":"n","from":"B"},{"name":"o","from":"C"}],"does":0}',
    '{"ok":false}', '{"with":null}', '{"null":null}', "{}", '{"":""}']


def test_reconcile(spark):
    df = spark.createDataFrame(list(enumerate(MIXED)), "i int, j string")
    out = D.reconcile(df, "j", "i")
    assert out.columns == ["i", "t", "ok", "null", "", "with.name", "with.from", "does.text", "does.secs", "does.cost"]
    rows = out.collect()
    assert len(rows) == 21
    assert {(r["with.name"], r["does.text"]) for r in rows if r.i == 0} == {(a, b) for a in "abc" for b in "xy"}
    assert {r["does.secs"] for r in rows if r.i == 5} == {0.0} and [r["does.cost"] for r in rows if r.i == 4] == [6.95]
    own = D.reconcile(df, "j", "i", merge=False)
    assert {"does._unspecified_str", "does._unspecified_int", "with._unspecified_str"} <= set(own.columns) and own.count() == 21
    deep = D.reconcile(spark.createDataFrame([(1, '{"a":{"b":{"c":1,"d":[1,2]}},"z":[[1,2],[3]]}')], "i int, j string"), "j", "i")
    assert deep.count() == 6 and set(deep.columns) == {"i", "z", "a.b.c", "a.b.d"}
    assert D.reconcile(df.limit(0), "j", "i").columns == ["i"]
    with pytest.raises(Exception):
        D.reconcile(spark.createDataFrame([(1, "no json")], "i int, j string"), "j", "i").collect()


def test_markers_with_quotes(spark):
    seg = spark.createDataFrame([(1, 0, "before"), (1, 1, "x It's a \\d start"), (1, 2, 'the "end" here'), (1, 3, "after")], "b int, pos int, text string")
    got = S.between_markers(seg, ["b"], ["pos"], "It's a \\d", '"end"').orderBy("pos").collect()
    assert [r.text for r in got] == ["It's a \\d start", 'the "end"']


def test_chunk_metadata(spark):
    seg = spark.createDataFrame([(1, 0, "aaa", 5, 6, 0.0), (1, 1, "bbb", 7, 9, 30.0), (1, 2, "One two. Three four.", 10, 11, 60.0), (1, 3, "c", 12, 12, 90.0)],
                                "b int, pos int, text string, line_start int, line_end int, percent double")
    got = S.pack(seg, ["b"], 10, first=["line_start"], last=["line_end", "percent"]).orderBy("chunk").collect()
    assert [tuple(r)[2:] for r in got] == [("aaa\nbbb", 5, 9, 30.0), ("One two.", 10, 11, 60.0), ("Three four.", 10, 11, 60.0), ("c", 12, 12, 90.0)]
    assert [tuple(r)[2:] for r in S.pack(seg, ["b"], 0, first=["line_start"], last=["line_end"]).collect()] == [("aaa\nbbb\nOne two. Three four.\nc", 5, 12)]


def test_collection(spark, tmp_path):
    c = W.Collection(spark, f"{tmp_path}/chunks", ["id"], "id int, text string, summary string, task struct<status:string,result:string>")
    rows = lambda r, s: spark.createDataFrame(r, s)
    assert c.read().count() == 0 and c.find_one(id=1) is None
    c.insert(rows([(1, "a"), (2, "b")], "id int, text string"))
    with pytest.raises(W.KeyExists):
        c.insert(rows([(2, "c")], "id int, text string"))
    c.update(rows([(1, "sum"), (9, "lost")], "id int, summary string"))
    assert sorted((r.id, r.text, r.summary) for r in c.read().collect()) == [(1, "a", "sum"), (2, "b", None)]
    c.save_result(rows([(1,)], "id int"), "started", "null")
    with pytest.raises(W.KeyExists):
        c.upsert(rows([(1, "x")], "id int, text string"), guarded="task")
    c.upsert(rows([(2, "B"), (3, "C")], "id int, text string"), guarded="task")
    assert c.find_one(id=1).task.status == "started" and [r.text for r in c.find(id=3).collect()] == ["C"]
    c.unset(rows([(1,)], "id int"), "task")
    assert c.find_one(id=1).task is None
    c.delete("id = 2")
    assert sorted(r.id for r in c.read().collect()) == [1, 3] and len(c.versions()) <= 2
    (tmp_path / "chunks" / "v99").mkdir()  # a version that was not finished
    assert c.read().count() == 2
    c.drop()
    assert c.versions() == []


def test_commands(spark, tmp_path):
    script = '{"insert": "p", "documents": [{"_id": 1, "n": "a; b", "k": 2,}, /* {;} */ {"n": "c"}]}; // end\n{"find": "p", "filter": {"n": "a; b"}};'
    made = R.split_commands(script)
    assert len(made) == 2 and [R.returns_rows(c) for c in made] == [False, True]
    assert W.run_command(spark, str(tmp_path), made[0]) is None
    assert [json.loads(r.doc)["k"] for r in W.run_command(spark, str(tmp_path), made[1]).collect()] == [2]
    W.run_command(spark, str(tmp_path), '{"delete": "p", "deletes": [{"q": {"k": 2}, "limit": 0}]}')
    assert W.run_command(spark, str(tmp_path), '{"find": "p"}').count() == 1
    W.run_command(spark, str(tmp_path), '{"drop": "p"}')
    assert W.run_command(spark, str(tmp_path), '{"find": "p"}').count() == 0 and W.run_command(spark, str(tmp_path), '{"ping": 1}') is None
    with pytest.raises(ValueError):
        W.run_command(spark, str(tmp_path), '{"explode": "p"}')
    assert R.is_single("SELECT 1; -- x") and not R.is_single("-- only") and not R.is_single("SELECT 1; SELECT 2")
    (tmp_path / "q.sql").write_text("SELECT 3 AS a; SELECT 4 AS b")
    assert [d.first()[0] for d in R.run_file(spark, str(tmp_path / "q.sql"))] == [3, 4]
    assert R.connection_string("postgresql", "h", 5, "d", "u", "p@") == "postgresql://u:p%40@h:5/d" and R.connection_string("mongodb", "h", 5) == "mongodb://h:5"


TEI = """<div type="part" xml:id="a 1"><p>own</p><note><head>no head</head></note>
<div type="chapter"><head>One</head><p>First<lb/>line
  goes on</p><p> </p><div><p>nested</p></div></div></div>"""


def test_tei(spark, tmp_path):
    whole = spark.createDataFrame([("f", TEI), ("g", None)], "path string, tei string").withColumn("tei", R.clean_tei(F.col("tei")))
    text = whole.first().tei
    assert text.startswith('<TEI xmlns="http://www.tei-c.org/ns/1.0"><div type="part" xml:id="id_a_1">') and R.clean_tei(F.lit(text)) is not None
    assert [tuple(r) for r in R.tei_rows(whole).collect()] == [("f", 1, "part", 1, 1, 1, "own"), ("f", 2, "One", 2, 2, 3, "First line goes on"), ("f", 3, "", 3, 3, 3, "nested")]
    (tmp_path / "b.tei").write_bytes("﻿".encode() + text.encode())
    assert [r.text for r in R.tei(spark, str(tmp_path / "b.tei"), ["One ", " "]).collect()] == ["First line goes on"]
    assert R.tei(spark, str(tmp_path / "b.tei")).count() == 3


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", "<html><body><h1>One</h1><p>A &amp; <b>b</b></p></body></html>")
        z.writestr("O/b.xhtml", "<html><body><h2>Two</h2><p/><p>C</p></body></html>")
    (tmp_path / "x.epub").write_bytes(data.getvalue())
    rows = R.tei_rows(R.epub(spark, str(tmp_path / "x.epub")))
    assert [(r.head, r.text) for r in rows.collect()] == [("One", "A & b"), ("Two", "C")]


def test_manifest_and_json(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿id,chapters,start\n1,"One\nTwo ""x""",\n')
    assert [tuple(r) for r in R.manifest(spark, str(tmp_path / "m.csv")).collect()] == [("1", 'One\nTwo "x"', "")]
    (tmp_path / "d.json").write_text('{"a": 1} // x\n{"a": 2}\n')
    assert sorted(r.a for r in R.json_documents(spark, str(tmp_path / "d.json")).collect()) == [1, 2]
    spark.createDataFrame([("b", 2), ("a", 1)], "n string, k int").createOrReplaceTempView("scan_me")
    assert [r.n for r in R.scan(spark, "scan_me", ["n"]).collect()] == ["b", "a"][::-1]


def test_timing_file(spark, tmp_path):
    now = spark.createDataFrame([("f", 1.0, 2)], "function string, elapsed double, run_id int")
    at = f"{tmp_path}/t"
    assert W.read_timing(spark, at, now).count() == 1
    W.append_timing(now.withColumn("run_id", F.lit(1)), at)
    W.append_timing(now, at)
    assert sorted(r.run_id for r in W.read_timing(spark, at, now).collect()) == [1, 2]
    (tmp_path / "broken").write_text("function,elapsed,run_id\nf,not a number,x\n")
    assert W.read_timing(spark, f"{tmp_path}/broken", now).count() == 1


def test_models(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "i int, text string").coalesce(1)

    def flags(texts):
        if "text 40" in texts:
            raise OSError("out")
        assert len(texts) <= 32
        return [t.endswith("3") for t in texts]

    got = {r.i for r in J.moderate_texts(df, "text", flags).where("flagged").collect()}
    assert got == {3, 13, 23}  # the second batch of 32 failed and passed, the third has none
    seen = []

    def extractor(text):
        seen.append(text)
        if text.endswith("1") or seen.count(text) < 2:
            raise ValueError("again")
        return [("s", "r", text)]

    out = J.extract(df.where("i < 3"), "text", extractor, tries=3).collect()
    assert sorted((r.i, r.o, r.error) for r in out if r.i != 1) == [(0, "text 0", None), (2, "text 2", None)] and [r.error for r in out if r.i == 1] == ["again"]
    with pytest.raises(Exception):
        J.parse_strict(spark.createDataFrame([("not json",)], "j string"), "j").collect()
    assert J.parse_strict(spark.createDataFrame([(None,), ("[]",)], "j string"), "j").count() == 0


def test_post(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(400 if got[-1].get("bad") else 202)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"bad": 1}'), (3, None)], "i int, j string")
    sent = W.post_payloads(df, "j", f"http://127.0.0.1:{server.server_port}/")
    rows = sent.collect()
    assert {r.i: r.code for r in rows} == {1: 202, 2: 400, 3: None} and len(got) == 2
    server.shutdown()
    again = spark.createDataFrame([(r.i, r.code) for r in rows], "i int, code int")
    assert sorted(r.i for r in K.answers(again, ["i"], "t", F.lit(None)).collect()) == [2, 3]
    assert K.assigned(again, ["i"], "t", F.lit(None)).count() == 3


def test_streams(spark, tmp_path):
    at, schema = tmp_path / "events", "id int, status string, ts timestamp"
    day = lambda h, m=0: datetime(2024, 1, 1, h, m)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at))
    put([(1, "started", day(1)), (2, "started", day(1, 5))])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
    q = ST.latest_status(stream(), ["id"], "status", "ts").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    w = ST.counts_by_window(stream(), "ts", "id").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    for s in (q, w):
        s.processAllAvailable()
    for more in ([(1, "completed", day(2))], [(1, "pending", day(0, 30)), (2, "failed", day(3))], [(9, "started", day(1, 1)), (9, "started", day(5))]):
        put(more)
        for s in (q, w):
            s.processAllAvailable()
    assert {(r.id, r.status) for r in spark.table("latest").collect()} == {(1, "completed"), (2, "failed"), (9, "started")}  # an older event changes nothing
    counted = {(r.start.hour, r.id): r.n for r in spark.table("windows").collect()}
    assert counted == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (3, 2): 1}  # events beyond the watermark are left out
    for s in (q, w):
        s.stop()


def test_task_stream(spark, tmp_path):
    store = W.Collection(spark, f"{tmp_path}/chunks", ["id"], "id int, text string, task struct<status:string,result:string>")
    store.insert(spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id int, text string"))
    tasks, told = Registry(), []
    tasks.add("metric_questeval", lambda chunks, k: chunks.select("id", (F.length("text") * k).alias("result")), k=10)
    tasks.add("bad", lambda chunks: chunks.select("id", F.raise_error(F.lit("no model")).alias("result")))
    with pytest.raises(ValueError):
        tasks.get("unknown")
    schema, at = "id int, task string", f"{tmp_path}/requests"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    put([(1, "questeval"), (2, "questeval")])
    q = ST.run_tasks(spark.readStream.schema(schema).parquet(at), store, tasks, f"{tmp_path}/check", lambda keys, task, status: told.append((task, status)))
    q.processAllAvailable()
    for rows in ([(1, "questeval")], [(3, "bad")]):
        put(rows)
        q.processAllAvailable()
    q.stop()
    got = {r.id: tuple(r.task) for r in store.read().collect()}
    assert got[1] == ("completed", "10") and got[2] == ("completed", "20") and got[3][0] == "failed" and "no model" in got[3][1]
    assert told == [("questeval", "started"), ("questeval", "completed"), ("questeval", "failed"), ("bad", "started"), ("bad", "failed")]


def test_communities(spark):
    clique = lambda p, n: [(f"{p}{i}", "r", f"{p}{j}") for i in range(n) for j in range(i)]
    edges = spark.createDataFrame([*clique("a", 6), *clique("b", 6), *clique("c", 5), ("a0", "r", "b0"), ("b1", "r", "c1")], "start_node_id string, rel_type string, end_node_id string")
    nodes = spark.createDataFrame([(f"{p}{i}",) for p, n in (("a", 6), ("b", 6), ("c", 5), ("lone", 1)) for i in range(n)], "element_id string")
    found = C.detect(nodes, edges)
    assert {r.element_id: r.community_id for r in found.collect()} == {r.element_id: r.element_id[0] + "0" if r.element_id != "lone0" else "lone0" for r in nodes.collect()}
    assert C.modularity(edges, found) > 0.55
    levels = C.detect(nodes, edges, multi_level=True).collect()
    assert all(r.community_list[-1][0] == r.element_id[0] for r in levels)
    assert C.detect(nodes, edges.limit(0)).where("element_id <> community_id").count() == 0
    with pytest.raises(ValueError):
        C.detect(nodes, edges, "guess")


def test_narrative_and_scores(spark):
    t = spark.createDataFrame([("a", "GOES_TO", "b"), ("b", "SEES", "c"), ("x", "IS", "y")], "subject string, relation string, object string")
    assert [r.line for r in G.narrative(t, "path", "a").orderBy("place").collect()] == ["a goes to b.", "b sees c."]
    for bad in (lambda: G.narrative(t, "path"), lambda: G.narrative(t, "song")):
        with pytest.raises(ValueError):
            bad()
    pairs = spark.createDataFrame([(1, "the cat sat\non the mat", "the cat\nsat on mat"), (2, None, "x"), (3, "a b", "a b")], "i int, made string, gold string")
    got = {r.i: r for r in M.basic_scores(pairs, "i", "made", "gold").collect()}
    assert got[3].rouge_lsum == got[3].rouge_l == got[3].rouge1 == 1.0 and got[2].rouge_lsum == 0.0 and abs(got[1].rouge_lsum - 10 / 11) < 1e-9
    rows = K.sample(pairs, 2, ["i"], 7).collect()
    assert len({r.i for r in rows}) == 2 and rows == K.sample(pairs, 2, ["i"], 7).collect()
    assert K.accuracy(pairs.limit(0).select(F.lit(1.0).alias("accuracy"), F.lit(True).alias("is_correct"))).first().score == 0.0


def test_payloads_and_health(spark, tmp_path):
    held = W.Payloads(spark, str(tmp_path / "scores"))
    assert held.all().count() == 0 and held.get(0) is None and held.add() == []
    assert held.add('{"a": 1}', "[2]") == [0, 1] and held.add("3") == [2]
    with pytest.raises(ValueError):
        held.add("4", "no json")
    assert [r.payload for r in held.all().collect()] == ['{"a": 1}', "[2]", "3"] and held.get(1) == "[2]"
    assert W.healthy(spark)


def test_chart(spark):
    df = spark.createDataFrame([("a<b", 2.0), ("c", 4.0), ("d", None), ("e", 9.0)], "f string, v double")
    svg = K.chart(df, "f", "v", F.lit(4.0)).first()["svg"]
    assert svg.count("<rect") == 3 and svg.count('width="600"') == 2 and 'width="300"' in svg and "a&lt;b" in svg and svg.index(">e<") < svg.index(">c<")
    assert K.chart(df.limit(0), "f", "v").first()["svg"].endswith('height="0"></svg>')
