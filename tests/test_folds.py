"""Chunks of sequences that lie in many blocks against a plain loop."""

import random
import re

import pytest

from fablework.operators import folds, segments


def packed(rows, limit):
    """Plain loop over (key, pos, text)."""
    out = {}
    for key in sorted({k for k, *_ in rows}):
        chunks, open_, sep = [], None, None
        for _, _, text in sorted(r for r in rows if r[0] == key):
            units = [(text, "\n", False)] if len(text) <= limit else [(t, " ", i == 0) for i, t in enumerate(re.split(r"(?<=[.!?])\s+", text))]
            for t, s, fresh in units:
                if open_ is not None and s == sep and not fresh and len(open_) + 1 + len(t) <= limit:
                    open_ += s + t
                else:
                    chunks += [open_] if open_ is not None else []
                    open_, sep = t, s
        out |= {(key, i): c for i, c in enumerate([*chunks, open_])}
    return out


@pytest.mark.parametrize("limit", [1, 7, 30])
def test_pack_across_blocks(spark, limit):
    rnd = random.Random(limit)
    text = lambda: " ".join("x" * rnd.randrange(1, 6) + rnd.choice(["", "", "."]) for _ in range(rnd.choice([1, 1, 2, 9])))
    rows = [(k, i, text() if rnd.random() > 0.1 else "") for k, n in ((0, 1), (1, 900), (2, 3), (3, 1), (4, 400), (5, 70)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, pos int, text string").repartition(5)
    got = {(r.k, r.chunk): r.text for r in segments.pack(df, ["k"], limit, block=8).collect()}
    assert got == packed(rows, limit)


def test_paths_of_many_levels(spark):
    """Blocks of 8 joined in groups of 2: ten levels."""
    rnd = random.Random(2)
    sizes = [rnd.randrange(4) for _ in range(5000)]
    key = sorted(rnd.randrange(40) for _ in sizes)
    units = spark.createDataFrame([(i, s, " ", False, key[i], 0) for i, s in enumerate(sizes)], "pos long, size int, sep string, fresh boolean, key_a long, key_b long")
    want, length, number = [], 0, -1
    for i, s in enumerate(sizes):
        if i and key[i] == key[i - 1] and length + 1 + s <= 2:
            length += 1 + s
            continue
        length, number = s, number + 1 if i and key[i] == key[i - 1] else 0
        want.append((i, number))
    got = folds.beginnings(units, 2, block=8, fan=2).where("own").orderBy("start").collect()
    assert [(r.start, r.number) for r in got] == want
    assert folds.beginnings(units.limit(0), 2).count() == 0


def test_pack_odd_rows(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), (1, 1, None), (1, 2, ""), (1, 2, ""), (2, 1, "One two. Three four."), (2, 1, "One two. Three four.")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "k int, at int, text string, chunk string, number int")
    got = sorted((r.k is None, r.k, r.chunk, r.text, r.number) for r in segments.pack(df, ["k"], 9, "at", last=["number"]).collect())
    sentences = ["One two.", "Three four.", "One two.", "Three four."]
    assert got == [(False, 1, 0, "\n", 9), *((False, 2, i, t, 9) for i, t in enumerate(sentences)), (True, None, 0, "a\nb", 9)]
    assert segments.pack(df.limit(0), ["k"], 9, "at").count() == 0 and segments.pack(df, ["k"], 0, "at").count() == 3


def test_a_long_book_over_many_partitions(spark):
    df = spark.range(1_000_000, numPartitions=50).selectExpr("1 AS book", "id AS pos", "repeat('w', CAST(1 + pmod(hash(id), 90) AS INT)) AS text")
    made = segments.pack(df, ["book"], 300)
    sizes = [r.n for r in df.selectExpr("pos", "length(text) AS n").orderBy("pos").collect()]
    want, length = [], None
    for n in sizes:
        if length is not None and length + 1 + n <= 300:
            length += 1 + n
        else:
            want += [length] if length is not None else []
            length = n
    assert [r.n for r in made.selectExpr("chunk", "length(text) AS n").orderBy("chunk").collect()] == [*want, length]


@pytest.mark.parametrize("limit", [1, 7, 30])
def test_oversize_sentences_are_the_oversize_chunks(spark, limit):
    rnd = random.Random(limit)
    text = lambda: " ".join("x" * rnd.randrange(0, 40) + rnd.choice(["", ".", "!  ", "?\n"]) for _ in range(rnd.choice([1, 2, 9])))
    rows = [(k if k else None, i % 90, text() if i % 11 else None) for k in range(5) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, pos int, text string").repartition(5)
    got = segments.oversize_sentences(df, ["k"], limit)
    want = segments.oversize(segments.pack(df, ["k"], limit), limit).select("k", "text")
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(got) == key(want) != []
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Sort" not in plan
