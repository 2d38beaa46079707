"""Clauses of running text as triples, with pronouns and short names linked to what they stand for.

Each sentence is split into clauses by patterns over its groups (``clauses``): first relative clauses, whose
subject is the noun group before them, then what is left once they are taken out. A clause has subjects, a verb,
its object, and further objects with their prepositions: ``(Ann, went to, London)``. Verbs joined by a conjunction share
their subjects; a conjunction before a noun group with a verb of its own begins another clause.

Links are made inside a text, whose segments may lie in many rows. Tasks that split sentences note each segment's clauses in
a row; these meet by text and in order, and are read once, with what the pronouns and names seen so far stand for:

* A pronoun of the third person stands for the latest subject of an earlier clause that agrees with it, without one
  for the latest object that does; an object does not stand for a subject of its own clause. Names agree with *he*, *she* and, if nothing plural came before, *they* alike, as a name does
  not tell; *it* takes what is neither a person nor a name. A reflexive stands for the subject of its clause.
* A name of one word stands for the latest longer name of which it is a word, its own clause's included.

What finds nothing stays as it is written; so do *I*, *you* and *we*. Null and empty texts give no row. Repeated segments
with equal keys and order are taken one after the other, by their text; equal ones clause by clause.
"""

from __future__ import annotations

import marshal
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .clauses import ENDS, GROUPS, LETTERS
from .tagger import TAGS, Model, Paths, dealt, flat_classes, tokens, uncollected

#: Words that begin a dependent or a relative clause, pronouns by what they agree with, words for persons.
SUBORDINATORS = {"because", "although", "though", "while", "when", "where", "if", "unless", "whereas", "whether"}
RELATIVES = {"who", "which", "that"}
PRONOUNS = {"he": "he him", "she": "she her", "it": "it", "they": "they them"}
REFLEXIVES = ["himself", "herself", "itself", "themselves"]
OTHERS = "i me you we us myself yourself ourselves yourselves mine yours his hers its ours theirs this that these those who which what".split()
PERSONS = {
    "he": "man boy king father brother son husband uncle prince sir gentleman lord",
    "she": "woman girl queen mother sister daughter wife aunt princess madam lady",
    "both": "person child friend teacher doctor soldier stranger captain servant neighbour student writer",
}
_OBJECTS = "N(?!(?:PN)*V)(?:CN(?!(?:PN)*V))*"
_VERB = f"V(?:{_OBJECTS}){{0,2}}(?:P{_OBJECTS})*"
#: In a relative clause also the noun group before the main verb is an object.
_INNER = "N(?:CN(?!(?:PN)*V))*"
_INNER = f"V(?:{_INNER}){{0,2}}(?:P{_INNER})*"
RELATIVE = re.compile(rf"(?P<s>N)(?:PN)*U?(?P<whole>W(?P<rest>{_INNER}(?:U?C{_INNER})*)U?)")
MAIN = re.compile(rf"(?P<s>N(?:CN)*)(?:PN)*(?P<rest>{_VERB}(?:U?C{_VERB})*)")
VERB = re.compile(rf"V(?P<o>(?:{_OBJECTS}){{0,2}})(?P<p>(?:P{_OBJECTS})*)")
AFTER_PREPOSITION = re.compile(rf"P(?P<o>{_OBJECTS})")

#: Shapes of sentences and words that a task keeps, the longest such sentence, characters read at once, and triples of a batch of the result.
SHAPES, HEADS, LONGEST, CHARACTERS, ROWS = 20_000, 50_000, 40, 4_000_000, 50_000
_TAG_LETTERS = bytes(ord(LETTERS[t]) for t in TAGS).ljust(256, b"?")


class _Marks(dict):
    """1 for words that begin a dependent clause, 2 for those that may begin a relative one, 3 for marks that end a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HEADS:
            self.clear()
        w = word.lower()
        made = self[word] = 1 if w in SUBORDINATORS else 2 if w in RELATIVES else 3 if w in ENDS else 0
        return made


_mark = _Marks().__getitem__


def _marked(line: str, marks: list[int]) -> str:
    """Letters of a sentence's tags with ``b`` for words that begin a dependent clause and ``w`` a relative one."""
    letters = list(line)
    for i, mark in enumerate(marks):
        if mark == 1:
            letters[i] = "b"
        elif mark == 2 and 0 < i < len(letters) - 1 and letters[i - 1] in "nmu" and letters[i + 1] in "vxr":
            letters[i] = "w"
    return "".join(letters)


def _clauses_of(kinds: str) -> list[tuple[list[int], list[tuple[int, int, list[int]]]]]:
    """The clauses of a sentence by the numbers of its groups: subjects, and facts of a verb, a preposition or -1, and objects."""
    out = []

    def read(kinds: str, at: list[int], subject: tuple[int, int], rest: tuple[int, int]) -> None:
        listed = lambda span: [at[g] for g in range(*span) if kinds[g] == "N"]
        facts = []
        for part in VERB.finditer(kinds, *rest):
            verb = at[part.start()]
            if part["o"]:
                facts.append((verb, -1, listed(part.span("o"))))
            if part["p"]:
                facts += [(verb, at[p.start()], listed(p.span("o"))) for p in AFTER_PREPOSITION.finditer(kinds, *part.span("p"))]
        out.append((listed(subject), facts))

    whole, at = kinds, list(range(len(kinds)))
    left, start = [], 0
    while m := "W" in kinds and RELATIVE.search(kinds, start):
        read(kinds, at, m.span("s"), m.span("rest"))
        left += range(start, m.start("whole"))
        # the last object of a relative clause may be the subject of the next one
        start = m.end("whole")
        inner = RELATIVE.match(kinds, last) if (last := kinds.rfind("N", m.start("rest"), start)) >= 0 else None
        while inner:
            read(kinds, at, inner.span("s"), inner.span("rest"))
            start = inner.end("whole")
            last = kinds.rfind("N", inner.start("rest"), start)
            inner = RELATIVE.match(kinds, last) if last >= 0 else None
    left += range(start, len(kinds))
    kinds, at = "".join(whole[g] for g in left), left
    for m in MAIN.finditer(kinds):
        read(kinds, at, m.span("s"), m.span("rest"))
    return sorted(out, key=lambda c: c[0][0])


def _shape(line: str) -> list[tuple[list, bool, list[tuple]]]:
    """The clauses of a sentence by the places of their words: subjects, whether the first begins the sentence, and facts."""
    groups = [(m.lastgroup, m.span()) for m in GROUPS.finditer(line)]
    kinds = "".join([k for k, _ in groups]) if "w" not in line else "".join([k if line[i] != "w" else "W" for k, (i, _) in groups])

    def at(g: int) -> slice | list[int]:
        kind, (i, j) = groups[g]
        if kind == "V":
            return [k for k in range(i, j) if line[k] != "r"] if "r" in line[i:j] else slice(i, j)
        return slice(i + 1 if line[i] in "dp" and j - i > 1 else i, j)

    return [([at(g) for g in subjects], subjects[0] == 0, [(at(v), at(p) if p >= 0 else None, [at(g) for g in objects]) for v, p, objects in facts])
            for subjects, facts in _clauses_of(kinds)]


_known_shape = lru_cache(SHAPES)(_shape)


def _read(words: list[str], line: str) -> list[tuple[list[str], bool, list[tuple[str, list[str]]]]]:
    """The clauses of one sentence, of which ``line`` has the words' letters."""
    if "v" not in line and "x" not in line:
        return []
    text = lambda at: " ".join(words[at] if type(at) is slice else [words[k] for k in at])
    return [([text(x) for x in subjects], initial, [(text(v) if p is None else f"{text(v)} {text(p)}", [text(x) for x in objects]) for v, p, objects in facts])
            for subjects, initial, facts in (_known_shape if len(line) <= LONGEST else _shape)(line)]


def split(words: list[str], tags: list[str]) -> list[tuple[list[str], bool, list[tuple[str, list[str]]]]]:
    """The clauses of one sentence: subjects, whether the first begins the sentence, and facts (relation, objects), none without objects."""
    return _read(words, _marked("".join(LETTERS[t] for t in tags), [*map(_mark, words)]))


def clauses(segments: DataFrame, keys: list[str], order: list[str], column: str, model: Model) -> DataFrame:
    """(keys, order, __tie, __at, __told) of every segment that has clauses.

    Of a segment's rows that with ``__at`` 1 tells its clauses, as (sentence, clause, subjects, initial, facts, asks), that with 0 the last
    words of subjects that it has in small letters: all of a text's are asked for before its first clause. Clauses without facts whose
    mentions are replaced by others' before any is asked for are left out.
    """
    kept = [*keys, *order, "__tie"]

    def read(batch: pa.RecordBatch, paths: Paths) -> pa.RecordBatch:
        texts = [tokens(t) for t in batch.column("__text").to_pylist()]
        words, classes, text_ends = flat_classes(texts)
        marks = np.fromiter(map(_mark, words), np.int8, len(words))
        last = marks == 3
        last[text_ends - 1] = True
        ends = np.flatnonzero(last) + 1
        rows = np.flatnonzero([bool(t) for t in texts])[np.searchsorted(text_ends, ends)]
        first = np.searchsorted(rows, rows)
        line = paths.of(classes, ends).translate(_TAG_LETTERS).decode("ascii")
        marked = {*np.searchsorted(ends, np.flatnonzero((marks == 1) | (marks == 2)), "right").tolist()}
        told: dict[int, list] = {}
        start = 0
        for n, (row, end, before) in enumerate(zip(rows.tolist(), ends.tolist(), first.tolist(), strict=True)):
            own = line[start:end]
            if n in marked:
                own = _marked(own, marks[start:end].tolist())
            if found := _read(words[start:end], own):
                told.setdefault(row, []).extend([(n - before, k, *c) for k, c in enumerate(found)])
            start = end
        made = []
        for row, found in told.items():
            needed, small = _needed(found)
            made += [(row, 0, marshal.dumps([*small]))] if small else []
            made += [(row, 1, marshal.dumps(needed))] if needed else []
        own = batch.select(kept).take(pa.array([row for row, _, _ in made], pa.int32()))
        columns = [*own.columns, pa.array([at for _, at, _ in made], pa.int32()), pa.array([b for _, _, b in made], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "__at", "__told"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(model)
        with uncollected():
            for batch in batches:
                size = np.cumsum(pc.utf8_length(batch.column("__text")).to_numpy(zero_copy_only=False)) // CHARACTERS
                cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    yield read(batch.slice(i, j - i), paths)

    texts = segments.select(*keys, *order, F.xxhash64(column).alias("__tie"), F.col(column).alias("__text")).where("__text <> ''")
    return dealt(texts).mapInArrow(run, texts.select(*kept, F.lit(0).alias("__at"), F.lit(b"").alias("__told")).schema)


@lru_cache(HEADS)
def _upper(word: str) -> bool:
    return category(word[0]) == "Lu"


_NO_NOUNS = {p for ps in PRONOUNS.values() for p in ps.split()} | {*REFLEXIVES, *OTHERS}
_HE, _SHE, _BOTH = ({*PERSONS[k].split()} for k in ("he", "she", "both"))
_ASKED = {p for ps in PRONOUNS.values() for p in ps.split()} | {*REFLEXIVES}
#: A bit for each pronoun that a mention may stand for, and one for persons that *they* may stand for.
SLOTS, ONE = {"he": 1, "she": 2, "it": 4, "they": 8}, 16
_PRONOUN = {word: p for p, listed in PRONOUNS.items() for word in listed.split()}


@lru_cache(HEADS)
def _agrees(head: str, name: bool, alone: bool) -> tuple[str, ...]:
    """The pronouns that a mention with this last word agrees with; a pronoun agrees with none."""
    head = head.lower()
    if alone and head in _NO_NOUNS:
        return ()
    if not name and (head.endswith("s") and not head.endswith("ss") or head in ("men", "women", "people", "children")):
        return ("they",)
    he, she = (name or head in _BOTH or head in _own for _own in (_HE, _SHE))
    return (("he",) if he else ()) + (("she",) if she else ()) or ("it",)


@lru_cache(HEADS)
def _subject_slots(head: str, alone: bool, initial: bool) -> tuple[int, str | None]:
    """What a subject is the latest mention for, a bit each, 0 if that is open; and its last word if that is in small letters."""
    if _upper(head):
        return 0 if initial and alone else sum(SLOTS[p] for p in _agrees(head, True, alone)) | (ONE if _agrees(head, True, alone) else 0), None
    fits = _agrees(head, False, alone)
    return sum(SLOTS[p] for p in fits) | (ONE if "he" in fits or "she" in fits else 0), head.lower()


@lru_cache(HEADS)
def _object_slots(head: str, alone: bool) -> int:
    return sum(SLOTS[p] for p in _agrees(head, _upper(head), alone)) << 5


def _needed(found: list[tuple]) -> tuple[list[tuple], set[str]]:
    """A segment's clauses without those whose mentions nothing can stand for, with whether they ask for any; and the last words
    of all subjects in small letters."""
    out, small, later = [], set(), 0
    for n, k, subjects, initial, facts in reversed(found):
        s = subjects[0]
        head, alone = s.rsplit(" ", 1)[-1], " " not in s
        made, word = _subject_slots(head, alone, initial)
        if word:
            small.add(word)
        if len(subjects) > 1:
            made = SLOTS["they"]
        if facts:
            asks = any(m.lower() in _ASKED for m in subjects) or any(m.lower() in _ASKED for _, o in facts for m in o)
            out.append((n, k, subjects, initial, facts, asks))
            last = facts[-1][1][-1]
            # a clause asks before its own mentions count
            later = 0 if asks else later | made | _object_slots(last.rsplit(" ", 1)[-1], " " not in last)
        elif made & ~later or not made and initial and alone and _upper(head):
            out.append((n, k, subjects, initial, facts, False))
            later |= made
    return out[::-1], small


@lru_cache(HEADS)
def _name_words(mention: str) -> tuple[str, ...]:
    """The words of a name of several words, none of what is no such name."""
    words = mention.split(" ")
    return tuple(words) if len(words) > 1 and all(map(_upper, words)) else ()


class _Text:
    """What the mentions of one text stand for, clause by clause."""

    def __init__(self) -> None:
        self.small: set[str] = set()
        # of each pronoun the mentions that it may stand for, best first
        self.stands: dict[str, list[str | None]] = {"he": [None, None], "she": [None, None], "it": [None, None], "they": [None, None, None]}
        self.names: tuple[dict[str, str], dict[str, str]] = {}, {}

    def resolved(self, mention: str, but: tuple | list = ()) -> str:
        p = _PRONOUN.get(mention.lower())
        return mention if p is None else next((x for x in self.stands[p] if x is not None and x not in but), mention)

    def meet(self, subjects: list[str], initial: bool, facts: list[tuple[str, list[str]]], asks: bool) -> list[tuple[str, str, str]]:
        """The clause's triples, by what came before it."""
        out, stands = [], self.stands
        if asks:
            own = [self.resolved(m) for m in subjects]
            whole = " and ".join(own)
            but = [*own, whole]
            out = [(s, r, whole if o.lower() in REFLEXIVES else self.resolved(o, but)) for r, objects in facts for o in objects for s in own]
        elif facts:
            out = [(s, r, o) for r, objects in facts for o in objects for s in subjects]
        s = subjects[0]
        head, alone = s.rsplit(" ", 1)[-1], " " not in s
        name = _upper(head)
        # a first word is written large in any case: it is no name if the text has it small, or if it is a plural
        if name and initial and alone and (head.lower() in self.small or head.lower().endswith("s")):
            name = False
        if len(subjects) > 1:
            stands["they"][0] = " and ".join(subjects)
        else:
            for p in (fits := _agrees(head, name, alone)):
                stands[p][0] = s
            if "he" in fits or "she" in fits:
                stands["they"][2] = s
        if facts:
            last = facts[-1][1][-1]
            head = last.rsplit(" ", 1)[-1]
            for p in _agrees(head, _upper(head), " " not in last):
                stands[p][1] = last
        return out

    def named(self, triples: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        """Names of one word become the latest longer name of the text that has this word: subjects first, then objects."""
        for column, names in ((0, self.names[0]), (2, self.names[1])):
            for name in sorted({x for t in triples for x in (t[0], t[2]) if " " in x and _name_words(x)}):
                names.update(dict.fromkeys(_name_words(name), name))
            if names:
                triples = [(*t[:column], names.get(t[column], t[column]), *t[column + 1 :]) for t in triples]
        return triples


def linked(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, sentence, clause, s, r, o): the facts of ``clauses`` with their mentions linked, one row a triple.

    A text is read in one task, in order; the task holds the words of its names and of its subjects in small letters.
    """
    kept, place = [*keys, *order], [*order, "__tie"]
    columns = {"sentence": pa.int32(), "clause": pa.int32(), "s": pa.string(), "r": pa.string(), "o": pa.string()}

    def equal(a: tuple, b: tuple) -> bool:
        return all(x == y or x != x and y != y for x, y in zip(a, b, strict=True))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(batch, row, key, at, told, copies): equal segments at one place are one; the bytes of equal ones may differ."""
        held = had = None
        for batch in batches:
            told, ats = batch.column("__told").to_pylist(), batch.column("__at").to_pylist()
            values = [batch.column(c).to_pylist() for c in (*keys, *place)]
            for i, (at, bits, all_) in enumerate(zip(ats, told, zip(*values, strict=True), strict=True)):
                if held and held[3] == at and equal(had, all_) and marshal.loads(held[4]) == marshal.loads(bits):
                    held[5] += 1
                    continue
                if held:
                    yield held
                held, had = [batch, i, all_[: len(keys)], at, bits, 1], all_
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = key = source = None
        rows, made = [], []

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), columns.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*source.select(kept).take(pa.array(rows, pa.int32())).columns, *arrays], names=[*kept, *columns])

        with uncollected():
            for batch, i, own, at, bits, copies in runs(batches):
                if made and (batch is not source or len(made) >= ROWS):
                    yield batch_of()
                    rows, made = [], []
                source = batch
                if text is None or not equal(key, own):
                    text, key = _Text(), own
                if at == 0:
                    text.small.update(marshal.loads(bits))
                    continue
                for sentence, clause, subjects, initial, facts, asks in marshal.loads(bits):
                    triples = [t for _ in range(copies) for t in text.meet(subjects, initial, facts, asks)]
                    if triples:
                        triples = text.named(triples)
                        rows += [i] * len(triples)
                        made += [(sentence, clause, *t) for t in triples]
            if made:
                yield batch_of()

    parts = 4 * found.sparkSession.sparkContext.defaultParallelism
    texts = (found.repartition(parts, *keys) if keys else found.repartition(1)).sortWithinPartitions(*keys, "__at", *place)
    word, number = F.lit(""), F.lit(0)
    return texts.mapInArrow(run, texts.select(*kept, number.alias("sentence"), number.alias("clause"), word.alias("s"), word.alias("r"), word.alias("o")).schema)


def clause_triples(segments: DataFrame, keys: list[str], order: list[str], column: str, model: Model) -> DataFrame:
    """(keys, order, sentence, clause, s, r, o) of all texts: ``clauses``, then ``linked``."""
    return cut(linked(clauses(segments, keys, order, column, model), keys, order))
