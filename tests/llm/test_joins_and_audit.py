"""Interval totals, substring dedup and the filter audit on odd rows and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fablework.llm import filter_audit, interval_join, substring_dedup

LONG = "long words here. " * 20_000
DOCS = "doc_id long, text string, source string, n_words int, mask int, part string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EPOCH = datetime(1970, 1, 1)


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def shop(spark, sales, lines, clicks):
    return (
        spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz, k string, n int, open string"),
        spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz, client_id string"),
        spark.createDataFrame(clicks, "client_id long, ts timestamp_ntz, kind string, slot int, bucket string"),
    )


def related(sales, lines, clicks):
    times = defaultdict(list)
    for client, ts, kind, *_ in clicks:
        if client is not None and ts is not None:
            times[client].append((ts, kind))
    met = defaultdict(list)
    for client, some in times.items():
        for ts, kind in sorted(some, key=lambda x: x[0]):
            if not met[client] or ts - met[client][-1][1] > timedelta(minutes=30):
                met[client].append([ts, ts, False])
            s = met[client][-1]
            s[2] = (s[2] and s[1] == ts) or kind == "error"
            s[1] = ts
    out, unit = Counter(), 6 * 3600 * 10**6
    for row, (sale, client, status, at, *_) in enumerate(sales):
        if client is None or at is None:
            continue
        ends = [at, *(t for s, t, *_ in lines if s is not None and s == sale and t is not None)]
        a, b = micros(at) // unit, float("inf") if status == "open" else micros(max(ends)) // unit
        found = defaultdict(list)
        for first, last, is_open in met[client]:
            s, e = micros(first) // unit, float("inf") if is_open else micros(last) // unit
            if s <= b and e >= a:
                when = ["earlier", "equally", "later"][(a > s) - (a < s) + 1]
                found[interval_join.RELATIONS[when][(b > e) - (b < e) + 1]].append((min(b, e) - max(a, s) + 1, zlib.crc32(str(micros(first)).encode())))
        for relation, some in found.items():
            slots = sum(x for x, _ in some)
            out[sale, relation, len(some), None if slots == float("inf") else int(slots), sum(c for _, c in some)] += 1
    return out


def test_interval_join_against_all_pairs(spark):
    rnd, start = random.Random(11), datetime(1969, 12, 20)  # before 1970, too
    at = lambda days: start + timedelta(seconds=rnd.randrange(int(days * 86_400)), microseconds=rnd.randrange(10**6))
    client = lambda: rnd.choice([1, 1, 1, 2, 3, None])
    sales = [(i // 2 if i < 20 else i, client(), rnd.choice(["open", "done", None]), rnd.choice([None, *[at(40)] * 9]), "x", 1, "x") for i in range(300)]
    lines = [(rnd.choice([None, *range(300)]), rnd.choice([None, at(60), at(45)]), "x") for _ in range(500)]
    clicks = [(client(), at(40), rnd.choice(["error", "view", "view", None]), 1, "x") for _ in range(1200)]
    clicks += [(1, start + timedelta(days=41, minutes=30 * i), "error" if i in (4, 9) else "view", 1, "x") for i in range(10)]  # half an hour apart: one session
    clicks += [(1, start + timedelta(days=42), k, 1, "x") for k in ("view", "error", "view")] + [(2, None, "error", 1, "x")]
    s, li, c = shop(spark, sales, lines, clicks)
    got = interval_join.relate(interval_join.intervals(s, li), interval_join.sessions(c, "client_id", "ts", F.col("kind") == "error"))
    want = related(sales, lines, clicks)
    assert Counter(map(tuple, got.collect())) == want and {k[1] for k in want} == {r for x in interval_join.RELATIONS.values() for r in x}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:  # times without a zone do not depend on the session's
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        z = interval_join.sessions(c, "client_id", "ts", F.col("kind") == "error").agg(F.sum("first"), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(z) == tuple(interval_join.sessions(c, "client_id", "ts", F.col("kind") == "error").agg(F.sum("first"), F.count("*")).first())


def test_interval_join_of_nothing(spark):
    sales = [(1, 1, "open", datetime(2024, 1, 1), "x", 1, "x")]
    clicks = [(1, datetime(2024, 1, 2), "view", 1, "x")]
    s, li, c = shop(spark, sales, [(1, None, "x")], clicks)
    found = lambda s, c: interval_join.relate(interval_join.intervals(s, li), interval_join.sessions(c, "client_id", "ts", F.col("kind") == "error")).collect()
    assert found(s.limit(0), c) == found(s, c.limit(0)) == found(s.limit(0), c.limit(0)) == []
    assert [tuple(r) for r in found(s, c)] == [(1, "contains", 1, 1, zlib.crc32(str(micros(datetime(2024, 1, 2))).encode()))]


def removed(docs, window, tie):
    """Brute force: (id, n_words, n_removed, kept text) of each row; rows of one id and text are one document."""
    seen, out = set(), Counter()
    for (doc, text), n in sorted(Counter((d, t) for d, t, *_ in docs).items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, tie[x[0][1]])):
        words = WORD.findall(text or "")
        lost = set()
        for j in range(len(words) - window + 1):
            w = tuple(words[j : j + window])
            if w in seen:
                lost.update(range(j, j + window))
            seen.add(w)
        kept = " ".join(x for j, x in enumerate(words) if j not in lost)
        out[doc, len(words), len(words) - len(WORD.findall(kept)), hashlib.sha256(kept.encode()).hexdigest()] += n
    return out


@pytest.mark.parametrize(("window", "bits", "plain"), [(20, 28, True), (5, 28, False), (3, 16, True), (3, 16, False)])
def test_substring_dedup_against_sets(spark, window, bits, plain):
    rnd = random.Random(window)
    text = lambda: "".join(rnd.choice(["a", "b", "c ", "é", "漢"]) + rnd.choice([" ", " ", "\n", "\t  ", "\x1c"]) for _ in range(rnd.randrange(60)))
    rows = [(i, text()) for i in range(120)] + [(200, " \n "), (201, LONG), (202, "x " + LONG), (203, None), (204, twice := text() * 3), (204, twice)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 120, 3)]
    if not plain:
        rows += [(None, None), (None, text()), (None, rows[9][1]), (None, rows[9][1]), (5, ""), (7, rows[20][1]), (7, "y " + rows[20][1])]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, "a", 1, 1, "x", "x") for r in rows], DOCS)
    tie = {r.text: r.tie for r in docs.select("text", F.xxhash64("text").alias("tie")).collect()}
    got = substring_dedup.remove_repeats(docs.repartition(5), window, bits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows, window, tie)
    assert all(r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.remove_repeats(docs.limit(0), window).count() == 0


def test_sketch_loses_no_window(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 400}" for j in range(80))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "a", 1, 1, "x", "x") for r in rows], DOCS).repartition(6)
    data = np.frombuffer(substring_dedup.repeated_cells(docs, 20, 18), "u1")
    words = substring_dedup.Words(pa.array([t for _, t in rows]))
    at, a, b = words.windows(20)
    times = Counter(zip(a.tolist(), b.tolist(), strict=True))
    truly = Counter(tuple(t.split()[j : j + 20]) for _, t in rows for j in range(61))
    assert sorted(times.values()) == sorted(truly.values())
    guessed = substring_dedup._estimated(data, a, b, 18)
    repeated = [times[x] > 1 for x in zip(a.tolist(), b.tolist(), strict=True)]
    assert all(g for g, r in zip(guessed, repeated, strict=True) if r)
    assert sum(guessed) < sum(repeated) + 20


def test_gaps_of_cells():
    rnd = random.Random(3)
    for _ in range(20):
        cells = np.array(sorted(rnd.randrange(3 << 16) for _ in range(rnd.randrange(1, 900))), np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], (cells[1:] >> 16) != (cells[:-1] >> 16)]))
        raw, sizes = substring_dedup._gaps(cells, starts)
        ends = np.add.reduceat(sizes, starts).cumsum()
        back = [substring_dedup._from_gaps(raw[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        assert [x.tolist() for x in back] == [(cells[cells >> 16 == b] & 0xFFFF).tolist() for b in sorted(set((cells >> 16).tolist()))]


def audited(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in range(2))
    out = defaultdict(Counter)
    fails = []
    for d, text, source, *_ in docs:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = any(d is not None and e is not None and e < d and (u or "") == t for e, u, *_ in docs)
        fails.append((source or "", d, {k for k, v in f.items() if v}))
    for order in map("".join, permutations("ABCDE")):
        for part, d, f in fails:
            for i, c in enumerate(order):
                x, gone = out[part, order, i + 1], bool(f & set(order[:i]))
                x["kept"] += not gone and c not in f
                x["removed"] += not gone and c in f
                x["redundant"] += gone and c in f
                x["unique_fails"] += f == {c}
                x["good_lost"] += not gone and c in f and d in good
                x["toxic_lost"] += not gone and c in f and d in toxic
    total = Counter()
    for (part, order, step), x in out.items():
        total[part, order[step - 1]] += x["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(*k, *(x[n] for n in names), total[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def audit_rows():
    rnd = random.Random(13)
    words = lambda n: " ".join(rnd.choice(["Alpha", "beta", "GAMMA", "#d", "e", "été", "漢", "x y"]) + str(rnd.randrange(3 + n)) for _ in range(n))
    texts = [None, "", "A", " \n", LONG, "X" + LONG, *(words(rnd.randrange(90)) for _ in range(60))]
    texts += [t + "same end" for t in texts[8:12]] + ["é" * 300 + "a", "é" * 300 + "b"]  # equal first blocks
    rows = [(rnd.choice([None, i, i, i]), rnd.choice(texts), rnd.choice([None, "", "s1", "s1", "s1", "s2"])) for i in range(150)]
    return rows + rows[:5], [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(100)] + [(3, 1, 1), (None, 1, 1), (3, 1, 1)]


def test_filter_audit_against_counting(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, 1, 1, "x", "x") for r in rows], DOCS).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, known)
    assert {tuple(r) for r in got.collect()} == audited(rows, labels) and got.count() == 3 * 600
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, known.limit(0)).collect()} == {0}


def test_filter_audit_when_hashes_meet(spark, monkeypatch):
    """All blocks hash alike: only the texts tell documents of one length apart."""
    monkeypatch.setattr(filter_audit, "block_hash", lambda text, number: F.lit(7).cast("long"))
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, 1, 1, "x", "x") for r in rows], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == audited(rows, labels)


def test_url_filter_of_an_empty_table_and_a_very_long_url(spark):
    from fablework.llm import url_filter

    rules = url_filter.rules_frame(spark, url_filter.RULES)
    long = "http://" + "sub." * 20_000 + "EXAMPLE.com/en/" + "x/" * 100_000 + "?q"
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "a" * 100_000 + ".net/es/")], "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict, len(r.host), len(r.path)) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == [(1, "example.com/en/", "block", 80_011, 200_004)] * 2 + [(2, "net/es/", "block", 100_004, 4)]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
