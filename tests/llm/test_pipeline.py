"""The corpus pipeline's stages, one by one on what the one before kept, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from fablework.llm import byte_bpe
from fablework.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, copies int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: The rules' stock phrases and menu words that the fixture uses.
PHRASES = ("all rights reserved", "accept cookies")
JUNK = "Home | News | Contact | Help"


def made():
    rnd, rows, labels = random.Random(11), [], []
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "mu", "re") for b in ("lan", "dor", "vis", "nem") for c in ("", "a", "el", "os")]

    def prose(n):
        return "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(12)) + "." for _ in range(n))

    def add(text, source="s1", toxic=None):
        rows.append((len(rows) + 1, text, "en", source, len(text or ""), "x", "y", 7))
        if toxic is not None:
            labels.append((rows[-1][0], 1, toxic))

    for i in range(300):  # plain and toxic prose of three sources, one null
        bad = i % 6 == 0
        text = prose(rnd.randrange(5, 12))
        add(text.replace(".", " vilescum.", 3) if bad else text, ("s1", "s1", "s2", None)[i % 4], int(bad))
    for _ in range(12):  # groups of near copies
        base = prose(12)
        for _ in range(rnd.randrange(2, 5)):
            words = base.split(" ")
            words[rnd.randrange(len(words))] = "changed"
            add(" ".join(words), "s2")
    add(prose(8) + "\n" + JUNK)  # loses a line
    add("\n".join([JUNK] * 30))  # loses all
    add(prose(1))  # too short
    add(" ".join(["again and again"] * 40) + ".")  # repeats
    add(prose(6) + "\n\n" + "Please accept cookies.", None)
    for text in (None, "", " \n\t "):
        add(text)
    rows += [rows[1], rows[1]]  # repeated rows
    rows.append((None, prose(7), None, None, None, None, None, None))
    labels += [(3, 1, 0), (None, 1, 1), (4, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at, (rows, labels) = tmp_path_factory.mktemp("corpus"), made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows of documents and of what each stage made of its predecessor's."""
    out = {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    docs = out["documents"]
    for name, stage in P.STAGES:
        docs = out[name] = materialise(stage(spark, docs, sf_dir), name)
    return {k: v.collect() for k, v in out.items()} | {"columns": {k: v.columns for k, v in out.items()}}


def line_fails(line):
    words = SPACE.findall(line)
    if not words:
        return False
    few = len(words) < 4 and not re.search(r"[.!?…:;,\"')»”][\x20\x09-\x0D]*$", line)
    return (10 * len(re.findall(r"[#*$%&|<>]", line)) > len(words) or len(re.findall("[|>»›•·]", line)) >= 3
            or any(p in line.lower() for p in PHRASES) or few)


def cleaned(text):
    """The cleaned text, or None where the document goes."""
    words = SPACE.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeat = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})
    if len(words) < 50 or 2 * repeat > len(words):
        return None
    size = lambda lines: sum(len(w) for x in lines for w in SPACE.findall(x))
    lines = text.split("\n")
    bad = [x for x in lines if line_fails(x)]
    return "\n".join(x for x in lines if x not in bad) if 100 * size(bad) <= 40 * size(lines) else None


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages["columns"][name] == P.COLUMNS, name


def test_quality(stages):
    want = Counter((r.doc_id, c, r.source, len(c)) for r in stages["documents"] if (c := cleaned(r.text)) is not None)
    assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in stages["quality_rules"]) == want
    assert 0 < want.total() < len(stages["documents"]) and any(JUNK in (r.text or "") for r in stages["documents"])


def test_toxicity(stages):
    want = Counter((r.doc_id, r.text) for r in stages["quality_rules"] if "vilescum" not in r.text)
    assert Counter((r.doc_id, r.text) for r in stages["toxicity"]) == want


def test_near_dedup(stages):
    rows = list({(r.doc_id, r.text) for r in stages["toxicity"]})
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, t in rows for w in [t.lower().split()]]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        groups[top(i)].append(name)
    want = Counter(min(g, key=lambda x: (x is None, x or 0)) for g in groups.values())
    assert Counter(r.doc_id for r in stages["near_dedup"]) == want
    assert len(groups) < len(rows)


def test_mixing(stages):
    size = lambda t: len(SPACE.findall(t))
    kept, taken = stages["near_dedup"], Counter(r.doc_id for r in stages["mixing"])
    assert max(taken.values()) <= 2 and set(taken) <= {r.doc_id for r in kept}
    assert {(r.doc_id, r.text) for r in stages["mixing"]} <= {(r.doc_id, r.text) for r in kept}
    have, got = Counter(), Counter()
    for r in kept:
        have[r.source] += size(r.text)
    for r in stages["mixing"]:
        got[r.source] += size(r.text)
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1) * len(order)))
    left, fixed, total = set(order), {}, 1.5 * sum(have.values())
    while True:  # cap what is over, share the rest again
        level = (total - sum(fixed.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * have[s]}
        if not over:
            break
        fixed |= {s: 2 * have[s] for s in over}
        left -= over
        if not left:
            break
    want = fixed | {s: weight[s] * level for s in left}
    most = max(size(r.text) for r in kept)
    for s in order:
        assert abs(got[s] - want[s]) <= most, s


def test_byte_bpe(stages):
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in stages["mixing"]:
        ids = lib.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["byte_bpe"]) == want


def test_run_and_empty(spark, sf_dir, stages, tmp_path):
    again = Counter((r.doc_id, r.ids_sha256) for r in P.run(spark, sf_dir).select("doc_id", "ids_sha256").collect())
    assert again == Counter((r.doc_id, r.ids_sha256) for r in stages["byte_bpe"])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_repeated_ids(spark, tmp_path):
    text = lambda g: " ".join(f"{g}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e")), (4, text("e")), (None, text("f")), (None, text("f") + " x"), (None, text("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicate(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text[0]) for r in got) == Counter([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (None, "f")])
