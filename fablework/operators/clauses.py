"""Subject-verb-object triples by a cascade of finite-state chunkers over tags.

A token's tag is a letter, so a pattern over a sentence's letters is one over its tokens. The first patterns make
noun and verb groups of tags; groups are letters again, and the next pattern reads clauses off them:
subject, prepositional phrases, verb, object, and further verbs with their objects that share the subject.
Groups joined by a conjunction stand for each of their members.

Of a noun group its determiners and possessive pronouns are left out, of a verb group its adverbs. An object is a group
right after its verb: one that follows a preposition is none. Null and empty texts give no triple.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import TAGS, Model, best_paths, dealt, tokens, word_classes

LETTERS = dict(zip(TAGS, "dptixcvarnmu", strict=True))
_NOUNS = "(?:ra|a|m)*n+"
GROUPS = re.compile(
    rf"(?P<N>(?:d|p(?=r?[amn]))?{_NOUNS}(?:t{_NOUNS})*|p|d)"
    r"|(?P<V>(?:[xr]|t(?=[xrv]))*v(?:r*t?v)*r*|r*x(?:[xr]|t)*)|(?P<P>i)|(?P<C>c)|(?P<U>u)|(?P<O>.)")
_LIST = "N(?:CN(?!(?:PN)*V))*"
#: A subject, what stands between, and verbs with their objects.
CLAUSE = re.compile(rf"(?P<s>N(?:CN)*)(?:PN)*(?P<rest>V{_LIST}(?:PN)*(?:CV{_LIST}(?:PN)*)*)")
PREDICATE = re.compile(rf"(?P<v>V)(?P<o>{_LIST})(?:PN)*C?")
ENDS = {".", "!", "?", ";", ":"}


def sentences(words: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of words up to and with a mark that ends a sentence."""
    start = 0
    for i, w in enumerate(words):
        if w in ENDS:
            yield start, i + 1
            start = i + 1
    if start < len(words):
        yield start, len(words)


def triples(words: list[str], tags: list[str]) -> list[tuple[str, str, str]]:
    """(s, r, o) of one sentence."""
    letters = "".join(LETTERS[t] for t in tags)
    groups = [(m.lastgroup, m.start(), m.end()) for m in GROUPS.finditer(letters)]
    kinds = "".join(k for k, *_ in groups)

    def text(group: int) -> str:
        kind, i, j = groups[group]
        if kind == "N" and letters[i] in "dp" and j - i > 1:
            i += 1
        return " ".join(w for w, x in zip(words[i:j], letters[i:j], strict=True) if kind != "V" or x != "r")

    listed = lambda i, j: [text(g) for g in range(i, j) if kinds[g] == "N"]
    out = []
    for clause in CLAUSE.finditer(kinds):
        subjects = listed(*clause.span("s"))
        for part in PREDICATE.finditer(kinds, *clause.span("rest")):
            out += product(subjects, [text(part.start("v"))], listed(*part.span("o")))
    return out


def subject_verb_object(df: DataFrame, column: str, model: Model) -> DataFrame:
    """Rows of ``df`` without ``column``, times the (s, r, o) of its text."""
    kept = [c for c in df.columns if c not in (column, "s", "r", "o")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [tokens(t) for t in frame[column]]
            spans = [(row, i, j) for row, words in enumerate(texts) for i, j in sentences(words)]
            paths = best_paths(model, [word_classes(texts[row][i:j]) for row, i, j in spans])
            found = [(row, *t) for (row, i, j), path in zip(spans, paths, strict=True) for t in triples(texts[row][i:j], [TAGS[k] for k in path])]
            made = pd.DataFrame(found, columns=["__row", "s", "r", "o"])
            yield frame[kept].iloc[made["__row"].to_numpy(int)].reset_index(drop=True).assign(**{c: made[c] for c in "sro"})

    text = F.lit("")
    return dealt(df.select(*kept, column)).mapInPandas(run, df.select(*kept, text.alias("s"), text.alias("r"), text.alias("o")).schema)
