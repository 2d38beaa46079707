"""Sentence ends learned from texts of our own; scores against plain counting."""

import math
import random
import re
from collections import Counter

from fablework.operators import segments as S
from fablework.operators import sentence_ends as E


def _corpus():
    rng = random.Random(5)
    names = ["Smith", "Lee", "Brown", "Carter", "Hill"]
    verbs = ["went home", "saw the old house", "took the long road", "left the room early", "bought some bread"]
    out = []
    for _ in range(300):
        title, name = rng.choice(["Mr.", "Dr.", "Mrs."]), rng.choice(names)
        out.append(f"The town was old. {title} {name} {rng.choice(verbs)}. He {rng.choice(verbs)}, e.g. in the town. The house was old! They {rng.choice(verbs)}.")
    return out


def test_titles_are_learned(spark):
    texts = _corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(7)
    ends = E.learn(df)
    short = {r.word for r in ends.abbreviations.collect()}
    assert {"mr", "dr", "mrs", "e.g"} <= short and not short & {"home", "house", "road", "early", "bread", "long", "town"}
    assert "he" in {r.word for r in ends.starters.collect()}
    got = E.sentence_rows(df, ["id"], ends).collect()
    for i in (0, 17, 299):
        mine = [r.text for r in sorted((r for r in got if r.id == i), key=lambda r: r.sentence)]
        assert mine[0] == 'The town was old.' and mine[1][:2] in ('Mr', 'Dr') and mine[3] == 'The house was old!'
        assert " ".join(mine) == texts[i] and [r.sentence for r in sorted((r for r in got if r.id == i), key=lambda r: r.sentence)] == list(range(5))
    assert len(got) == 1500


def test_abbreviations_equal_plain_counting(spark):
    texts = _corpus()
    rng = random.Random(6)
    texts += [" ".join(rng.choice(["ab.", "ab", "cde.", "fg", "x.y.", "long.", "word", "Big", "(tel.", "3.5", "7."]) for _ in range(40)) for _ in range(30)]
    n, stops = Counter(), Counter()
    for t in texts:
        for token in t.split():
            bare = re.sub(r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9.]+$", "", token)
            w = re.sub(r"\.+$", "", bare.lower())
            w = "##" if re.fullmatch(r"[0-9.,]*[0-9]", w) else w
            n[w] += 1
            stops[w] += bare.endswith(".")
    share = sum(stops.values()) / sum(n.values())
    want = set()
    for w, k in stops.items():
        plain, letters, inner = n[w] - k, len(w.replace(".", "")), w.count(".")
        if k and len(w) > 1 and w != "##":
            ratio = 2 * (k * math.log(0.99) + plain * math.log(0.01) - k * math.log(share) - plain * math.log(1 - share))
            if ratio * math.exp(-letters) * (inner + 1) * letters ** -plain >= 0.3:
                want.add(w)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert {r.word for r in E.learn(df).abbreviations.collect()} == want


def test_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, "  "), (3, "One. Two"), (3, "One. Two"), (4, "Wait!  What? Yes."), (5, "a " * 50_000 + "end. New")]
    df = spark.createDataFrame(rows, "id int, text string")
    ends = E.learn(spark.createDataFrame([(t,) for t in _corpus()], "text string"))
    got = sorted((r.id, r.sentence, r.text) for r in E.sentence_rows(df, ["id"], ends).collect())
    assert [g for g in got if g[0] < 5] == [(3, 0, "One."), (3, 0, "One."), (3, 1, "Two"), (3, 1, "Two"), (4, 0, "Wait!"), (4, 1, "What?"), (4, 2, "Yes.")]
    assert [len(g[2]) for g in got if g[0] == 5] == [100_004, 3]
    empty = df.limit(0)
    assert E.sentence_rows(empty, ["id"], E.learn(empty)).count() == 0
    assert S.sentence_rows(df.where("id = 4"), ["id"]).count() == 3


def test_patterns_run_once_for_each_different_token(spark):
    """No pattern of words stands below the first counting, and all counts equal those of single rows."""
    df = spark.createDataFrame([(t,) for t in [*_corpus(), None, "  ", "Mr. (A b) ... Q."]], "text string")
    pairs = E._pairs(df, "text")
    plan = E._words(pairs)._jdf.queryExecution().optimizedPlan().toString()
    # plans are written from the top; the counting of tokens is the last Aggregate
    assert r"\p{N}" in plan and r"\p{N}" not in plan[plan.rindex("Aggregate"):]
    each = pairs.select(E.word(pairs.token).alias("word"), E.stopped(pairs.token).alias("stop"), E._bare(pairs.token).rlike(r"^\p{Lu}").alias("large"),
                        ((pairs.before != "") & ~pairs.before.rlike(r"[.!?:]\P{L}*$")).alias("inside"), E.word(pairs.after).alias("next")).where("word <> ''").collect()
    n, both = {}, Counter()
    for r in each:
        n[r.word] = [a + b for a, b in zip(n.get(r.word, [0] * 4), [1, r.stop, not r.large, r.large and r.inside], strict=True)]
        both[r.word, r.next] += r.stop and r.next != ""
    assert {r.word: [r.n, r.stops, r.small, r.inside] for r in E._words(pairs).collect()} == n
    assert {(r.word, r.next): r.both for r in E._around(pairs).collect()} == {k: v for k, v in both.items() if v}
