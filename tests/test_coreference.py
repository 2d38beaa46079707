"""Clauses with linked mentions on passages of our own."""

from fablework.operators import coreference as C
from fablework.operators import tagger as T

SPLIT = {
    "The man who saw the dog left the house.": [("man", "saw", "dog"), ("man", "left", "house")],
    "Ann saw Bob, who reads the letter.": [("Ann", "saw", "Bob"), ("Bob", "reads", "letter")],
    "Ann saw the house and Carl left the room.": [("Ann", "saw", "house"), ("Carl", "left", "room")],
    "When the king left, the queen opened the door.": [("queen", "opened", "door")],
    "Ann went to London with Bob and bought a house.": [("Ann", "went to", "London"), ("Ann", "went with", "Bob"), ("Ann", "bought", "house")],
    "The man who saw the dog that took the key left the house.": [("man", "saw", "dog"), ("dog", "took", "key"), ("man", "left", "house")],
    "Ann arrived.": [], "": [], "...": [],
}
LINKED = {
    "pronouns": (["Ann saw Bob. She gave him the letter.", "She opened it because it was big."],
                 [("Ann", "saw", "Bob"), ("Ann", "gave", "Bob"), ("Ann", "gave", "letter"), ("Ann", "opened", "letter")]),
    "persons": (["The king saw the queen. She left the castle.", "He followed her to the garden."],
                [("king", "saw", "queen"), ("queen", "left", "castle"), ("king", "followed", "queen"), ("king", "followed to", "garden")]),
    "names": (["Ann Lee saw Carl Lee. Lee opened the door. Ann closed it."],
              [("Ann Lee", "saw", "Carl Lee"), ("Carl Lee", "opened", "door"), ("Ann Lee", "closed", "door")]),
    "many": (["The king and the queen left the castle.", "They saw themselves."],
             [("king", "left", "castle"), ("queen", "left", "castle"), ("king and queen", "saw", "king and queen")]),
    "none": (["She opened it.", None, ""], [("She", "opened", "it")]),
    "reflexive": (["The queen saw the girl. The girl killed herself."], [("queen", "saw", "girl"), ("girl", "killed", "girl")]),
}


def _split(text):
    words = T.tokens(text)
    path = T.best_paths(T.Model.prior(), [[T.word_class(w) for w in words]])[0]
    return [(s, r, o) for subjects, _, facts in C.split(words, [T.TAGS[t] for t in path]) for s in subjects for r, os in facts for o in os]


def test_clauses_of_sentences():
    for text, want in SPLIT.items():
        assert sorted(_split(text)) == sorted(want), text


def test_mentions_are_linked(spark):
    rows = [(name, i, t, "x") for name, (texts, _) in LINKED.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc string, pos int, text string, s string").repartition(5)
    got = C.clause_triples(df, ["doc"], ["pos"], "text", T.Model.prior())
    assert got.columns == ["doc", "pos", "sentence", "clause", "s", "r", "o"]
    found = got.collect()
    for name, (_, want) in LINKED.items():
        assert sorted((r.s, r.r, r.o) for r in found if r.doc == name) == sorted(want), name
    assert C.clause_triples(df.limit(0), ["doc"], ["pos"], "text", T.Model.prior()).count() == 0


def test_texts_do_not_meet_and_long_ones_are_whole(spark):
    long = " ".join(f"The king saw the house. He left it with Carl{i}." for i in range(2000))
    df = spark.createDataFrame([(0, 0, "The queen saw Ann."), (1, 0, "She left the castle."), (2, 0, long)], "doc int, pos int, text string")
    got = C.clause_triples(df, ["doc"], ["pos"], "text", T.Model.prior()).collect()
    assert [(r.s, r.r, r.o) for r in got if r.doc == 1] == [("She", "left", "castle")]
    assert sum((r.s, r.r, r.o) == ("king", "left", "house") for r in got) == 2000


def test_sentences_are_read_once(spark):
    """What is asked for twice is written: the result reads tables, and no Python runs for it again."""
    df = spark.createDataFrame([(0, 0, "The queen saw Ann Lee. She left Ann.")], "doc int, pos int, text string")
    got = C.clause_triples(df, ["doc"], ["pos"], "text", T.Model.prior())
    assert "MapInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 1


def test_a_text_is_read_once_in_order(spark, monkeypatch):
    """Clauses meet by text and nothing more; windows and two more tables were made of them before."""
    written = []
    monkeypatch.setattr(C, "cut", lambda df, cut=C.cut: written.append(df) or cut(df))
    df = spark.createDataFrame([(0, 0, "The queen saw Ann Lee."), (0, 1, "She saw Ann.")], "doc int, pos int, text string")
    assert [(r.s, r.r, r.o) for r in C.clause_triples(df, ["doc"], ["pos"], "text", T.Model.prior()).collect()] == [("queen", "saw", "Ann Lee")] * 2
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and "Window" not in plan and plan.count("Repartition") == 2


def test_places_may_be_missing_repeated_or_no_numbers(spark):
    """Equal segments at one place are read clause by clause; places and keys come back as they are."""
    nan = float("nan")
    rows = [(None, nan, "He left it."), (None, None, "Bob Lee saw the house."), (2**60 + 1, 0.0, "She left. Ann Lee saw the man."), (2**60 + 1, 0.0, "She left. Ann Lee saw the man."),
            (2**60 + 1, 1.0, "She saw Ann."), (2**60 + 3, 1.0, "She saw Ann.")]
    df = spark.createDataFrame(rows, "doc long, pos double, text string").repartition(3)
    got = C.clause_triples(df, ["doc"], ["pos"], "text", T.Model.prior()).collect()
    assert sorted((str(r.doc), str(r.pos), r.s, r.r, r.o) for r in got) == sorted([
        ("None", "None", "Bob Lee", "saw", "house"), ("None", "nan", "Bob Lee", "left", "house"), (str(2**60 + 1), "0.0", "Ann Lee", "saw", "man"), (str(2**60 + 1), "0.0", "Ann Lee", "saw", "man"),
        (str(2**60 + 1), "1.0", "Ann Lee", "saw", "Ann Lee"), (str(2**60 + 3), "1.0", "She", "saw", "Ann")])


def test_clauses_that_nothing_asks_for_are_left_out():
    """A mention that another replaces before a pronoun asks is not kept; one that a clause itself asks for is."""
    said = ["The man walked.", "The boy walked.", "He saw the dog.", "The dog arrived.", "It saw the girl."]
    words = [T.tokens(t) for t in said]
    paths = T.best_paths(T.Model.prior(), [[T.word_class(w) for w in ws] for ws in words])
    found = [(n, k, *c) for n, (ws, path) in enumerate(zip(words, paths, strict=True)) for k, c in enumerate(C.split(ws, [T.TAGS[t] for t in path]))]
    assert [n for n, *_ in found] == [0, 1, 2, 3, 4]
    assert [(n, c[-1]) for n, *c in C._needed(found)[0]] == [(1, False), (2, True), (3, False), (4, True)]
    text = C._Text()
    assert [t for _, _, *c in C._needed(found)[0] for t in text.meet(*c)] == [("boy", "saw", "dog"), ("dog", "saw", "girl")]
