"""Triples of sentences; groups of tags against a walk over all stretches."""

import random

from fablework.operators import clauses as C
from fablework.operators import tagger as T

CASES = {
    "The old dog sees a very big house.": [("old dog", "sees", "very big house")],
    "He opens the door and leaves the house.": [("He", "opens", "door"), ("He", "leaves", "house")],
    "My brother and the king will not read the long letter in the garden.": [("brother", "will not read", "long letter"), ("king", "will not read", "long letter")],
    "The man in the house has watched the dogs and cats. She is a teacher!": [("man", "has watched", "dogs"), ("man", "has watched", "cats"), ("She", "is", "teacher")],
    "She gives the door and he takes the key": [("She", "gives", "door"), ("he", "takes", "key")],
    "They walk to school.": [], "The king's daughter wants to enter the castle": [("king 's daughter", "wants to enter", "castle")],
    "": [], "...": [], "Give it": [],
}


def test_triples_of_sentences(spark):
    model = T.Model.prior()
    rows = [(i, text, "x", "y") for i, text in enumerate(CASES)] + [(99, None, "x", "y"), (0, next(iter(CASES)), "x", "y")]
    got = C.subject_verb_object(spark.createDataFrame(rows, "id int, text string, s string, other string"), "text", model)
    assert got.columns == ["id", "other", "s", "r", "o"]
    found = [(r.id, r.s, r.r, r.o) for r in got.collect()]
    for i, (text, want) in enumerate(CASES.items()):
        assert [f[1:] for f in found if f[0] == i] == want * (2 if i == 0 else 1), text
    assert C.subject_verb_object(got.limit(0).withColumnRenamed("o", "text"), "text", model).count() == 0


def is_nouns(s):
    """A run of nouns with what may stand before it; walks the letters."""
    i, seen = 0, False
    while i < len(s):
        if s[i] == "r" and not seen:
            i += 1
            if i == len(s) or s[i] != "a":
                return False
        if s[i] in "am" and not seen:
            i += 1
        elif s[i] == "n":
            seen, i = True, i + 1
        else:
            return False
    return seen


def is_noun_group(s):
    if s in ("p", "d"):
        return True
    rest = s[1:] if s[:1] in ("d", "p") else s
    return all(is_nouns(x) for x in rest.split("t")) if rest else False


def test_noun_groups_are_the_longest(spark):
    rnd = random.Random(8)
    for _ in range(3000):
        s = "".join(rnd.choice("dpranmtnvx") for _ in range(rnd.randrange(1, 9)))
        at = 0
        for m in C.GROUPS.finditer(s):
            assert m.start() == at
            at = m.end()
            longest = max((j for j in range(at - (at - m.start()) + 1, len(s) + 1) if is_noun_group(s[m.start() : j])), default=None)
            if m.lastgroup == "N":
                assert m.end() == longest, (s, m)
            else:
                assert longest is None or s[m.start()] in "rt", (s, m)
        assert at == len(s)
