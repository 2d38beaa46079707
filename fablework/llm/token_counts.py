"""Token counts of every prefix of a text, by dynamic programming, without re-encoding.

A piece's encoding is the only sequence of tokens whose neighbours are compatible: a pair (u, t) is
compatible if merging the letters of both gives just u, t. So the encoding of a prefix is that of a
shorter prefix followed by its one compatible last token, and a table of (last token, count) over the
prefixes gives each count from earlier ones. The last token of a counted prefix carries the
word-end mark, those before it don't, so the table has an inner and a closed column.

All pieces of a batch are tabled side by side: every token that stands anywhere in them is found by
one walk down the vocabulary's trie, then the table grows by one byte of all pieces a step. Words
that differ in case and closing signs only share the table of their stem.

What is stored for a text is the change of the count at every prefix, one byte a code point (four,
where a change needs them), and the count before every 256th: ``StoredCounts`` answers truncation and
budget questions from that, without the tokenizer.

Positions are code points of the normalised words, white space left out. Special tokens' strings
count as one token once complete, as ordinary text before that.

Defined results: null text has no tokens; repeated rows and null ids each keep their row; other
columns are ignored. Whole texts are counted, of any length.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .word_tokens import LETTERS, load, numbered, parts, split_words

LIMIT = 2048
EVERY = 256
#: Pieces of more bytes are tabled one at a time.
LONG = 64
CACHE_WORDS = 100_000
PLAIN = re.compile(f"[{LETTERS}]+")
BYTES_AT_ONCE = 3_000_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: visible Latin-1 as it is, the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(seen)))}


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _by_points(raw: bytes, counts: np.ndarray) -> np.ndarray:
    """Counts by byte as counts by code point: those at the last byte of each."""
    if raw.isascii():
        return counts
    return counts[np.append(np.frombuffer(raw, np.uint8)[1:] & 0xC0 != 0x80, True)]


class _Lookup:
    """Values of integer keys; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.append(values[order], -1).astype(np.int32)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, asked)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == asked, self.values[at], -1)


class _Trie:
    """Trie over byte strings; inner and closed: the token of each node, or -1."""

    def __init__(self, inner: dict[bytes, int], closed: dict[bytes, int]):
        node, edges = {b"": 0}, []
        for t in sorted(set(inner) | set(closed)):
            for k in range(1, len(t) + 1):
                if t[:k] not in node:
                    node[t[:k]] = len(node)
                    edges.append((node[t[: k - 1]] << 8 | t[k - 1], len(node) - 1))
        self.inner, self.closed = (np.full(len(node), -1, np.int32) for _ in range(2))
        for of, out in ((inner, self.inner), (closed, self.closed)):
            for t, i in of.items():
                out[node[t]] = i
        self.next = _Lookup(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, node) of every token in ``data``; ``ends``: where the piece of each byte ends."""
        start, node, found = np.arange(len(data)), np.zeros(len(data), np.int64), []
        for length in range(len(data)):
            inside = start + length < ends[start]
            start, node = start[inside], node[inside]
            node = self.next(node << 8 | data[start + length]).astype(np.int64)
            start, node = start[node >= 0], node[node >= 0]
            if not len(start):
                break
            token = (self.inner[node] >= 0) | (self.closed[node] >= 0)
            found.append((start[token], start[token] + length + 1, node[token]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class PrefixCounts:
    """Exact counts of all prefixes for a byte-level BPE vocabulary with a word-end suffix."""

    def __init__(self, path: str):
        import json

        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        end, vocabulary = said["model"]["end_of_word_suffix"], said["model"]["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in said["model"]["merges"]]
        of_letter = byte_letters()
        as_bytes = lambda t: bytes(map(of_letter.__getitem__, t))
        ordinary = {t: i for t, i in vocabulary.items() if all(c in of_letter for c in t.removesuffix(end))}
        self.trie = _Trie(
            {as_bytes(t): i for t, i in ordinary.items() if not t.endswith(end)},
            {as_bytes(t.removesuffix(end)): i for t, i in ordinary.items() if t.endswith(end)},
        )
        self.base = len(vocabulary)
        self.left, self.right, self.made_at = (np.full(self.base, -1, np.int64) for _ in range(3))
        pairs = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64)
        self.left[pairs[:, 2]], self.right[pairs[:, 2]], self.made_at[pairs[:, 2]] = pairs[:, 0], pairs[:, 1], np.arange(len(pairs))
        self.rank = _Lookup(pairs[:, 0] * self.base + pairs[:, 1], np.arange(len(pairs)))
        self.specials = [t["content"] for t in said["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words: dict[str, np.ndarray] = {}

    def compatible(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging the letters of both tokens leaves them apart, pair by pair (-1: nothing before, so yes).

        Their merges are undone, the latest first (of equal ones the right one): a pair that meets
        at the seam would have merged if its rank comes before the merge just undone.
        """
        out = np.ones(len(u), bool)
        row = np.flatnonzero(u >= 0)
        key, back = np.unique(u[row].astype(np.int64) * self.base + t[row], return_inverse=True)
        u, t = key // self.base, key % self.base
        ok, at = np.ones(len(key), bool), np.arange(len(key))
        limit = np.full(len(key), 1 << 30)
        while len(at):
            met = self.rank(u * self.base + t)
            bad = (met >= 0) & (met < limit)
            ok[at[bad]] = False
            a, b = self.made_at[u], self.made_at[t]
            of_left = a > b
            go = ~bad & (of_left | (b >= 0))
            limit = np.where(of_left, a, b + 1)[go]
            u, t, at = np.where(of_left, self.right[u], u)[go], np.where(of_left, t, self.left[t])[go], at[go]
        out[row] = ok[back]
        return out

    def pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Counts of the closed prefixes of all pieces, one after the other: one for each length in bytes from 1."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, long = np.zeros(lengths.sum(), np.int64), lengths > LONG
        out[np.repeat(~long, lengths)] = self._side_by_side([p for p in pieces if len(p) <= LONG])
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(long).tolist():
            out[ends[i] - lengths[i] : ends[i]] = self._side_by_side([pieces[i]])
        return out

    def _side_by_side(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        firsts = ends - lengths
        start, end, node = self.trie.matches(data, np.repeat(ends, lengths))
        depth = end - np.repeat(firsts, lengths)[start]  # the prefix that this token ends
        order = np.lexsort((start, depth))
        start, end, node = start[order], end[order], node[order]
        bounds = np.searchsorted(depth[order], np.arange(1, int(lengths.max(initial=0)) + 2))
        # of the prefix that ends with each byte: its last token, its number of tokens, and that of the closed prefix
        last, count, closed = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        opens = np.zeros(len(data) + 1, bool)
        opens[firsts] = True
        if len(pieces) == 1 and len(data) > LONG:
            self._one_by_one(start, end, node, last, count, closed)
        else:
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                s, e, n = start[i:j], end[i:j] - 1, node[i:j]
                new = opens[s]
                before, so_far = np.where(new, -1, last[s - 1]), np.where(new, 0, count[s - 1])
                for tokens, closes in ((self.trie.inner[n], False), (self.trie.closed[n], True)):
                    # a prefix before without a last token can't be extended
                    k = np.flatnonzero((tokens >= 0) & (new | (so_far > 0)))
                    k = k[self.compatible(before[k], tokens[k])]
                    if closes:
                        closed[e[k]] = so_far[k] + 1
                    else:
                        last[e[k]], count[e[k]] = tokens[k], so_far[k] + 1
        return closed

    def _one_by_one(self, start, end, node, last, count, closed) -> None:
        """The same for one long piece, token by token: steps of a few tokens would be slow side by side."""
        known: dict[tuple[int, int], bool] = {}

        def fits(u: int, t: int) -> bool:
            if u < 0:
                return True
            if (u, t) not in known:
                known[u, t] = bool(self.compatible(np.array([u]), np.array([t]))[0])
            return known[u, t]

        tokens = zip(start.tolist(), (end - 1).tolist(), self.trie.inner[node].tolist(), self.trie.closed[node].tolist(), strict=True)
        lasts, counts, done = last.tolist(), count.tolist(), closed.tolist()
        for s, e, inner, closing in tokens:  # by end, so all shorter prefixes are settled
            u, n = (lasts[s - 1], counts[s - 1]) if s else (-1, 0)
            if s and not n:
                continue
            if inner >= 0 and not counts[e] and fits(u, inner):
                lasts[e], counts[e] = inner, n + 1
            if closing >= 0 and not done[e] and fits(u, closing):
                done[e] = n + 1
        closed[:] = done

    def _counted(self, words: list[str]) -> list[np.ndarray]:
        """Counts of the prefixes of normalised words without special tokens, by code point."""
        cut = [[w[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(w)] for w in words]
        every = {p for c in cut for p in c}
        short = [p for p in every if p[0] == "'" and len(p) == 3 and p[1].isalpha()]
        listed = sorted(every.union("'", (p[1] for p in short)))
        raw = list(map(_raw, listed))
        counts = dict(zip(listed, np.split(_by_points(b"".join(raw), self.pieces(raw)), np.cumsum([len(p) for p in listed])[:-1]), strict=True))
        for p in short:  # cut inside, a contraction is an apostrophe and a letter
            one = counts["'"][0]
            counts[p] = np.array([one, one + counts[p[1]][0], counts[p][2]])
        out = []
        for c in cut:
            total, parts = 0, [np.zeros(0, np.int64)]
            for p in c:
                parts.append(counts[p] + total)
                total = parts[-1][-1]
            out.append(np.concatenate(parts))
        return out

    def _with_specials(self, word: str) -> np.ndarray:
        normal, out, total, at = self.tokenizer.normalizer.normalize_str, [], 0, 0
        for m in self.special.finditer(word):
            plain = normal(word[at : m.start()])
            begun, before = self._counted([plain + normal(m[0]), plain])
            out.append(total + np.append(begun[:-1], (before[-1] if len(before) else 0) + 1))
            total, at = out[-1][-1], m.end()
        return np.concatenate([*out, total + self._counted([normal(word[at:])])[0]])

    def tables(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the prefixes of stems, signs and other words, as the tokenizer normalises them.

        All in one array, with the place and the length of each key's.
        """
        easy = np.fromiter((PLAIN.fullmatch(k) is not None for k in keys), bool, len(keys))
        stems = [k.lower().encode() for k, plain in zip(keys, easy.tolist(), strict=True) if plain]
        own = {i: self.words.get(keys[i]) for i in np.flatnonzero(~easy).tolist()}
        new = [i for i, counts in own.items() if counts is None]
        special = {i for i in new if self.special is not None and self.special.search(keys[i])}
        plain = [i for i in new if i not in special]
        counted = self._counted([self.tokenizer.normalizer.normalize_str(keys[i]) for i in plain])
        own |= dict(zip(plain, counted, strict=True)) | {i: self._with_specials(keys[i]) for i in special}
        for i in new:
            if len(self.words) < CACHE_WORDS and len(keys[i]) <= LONG:
                self.words[keys[i]] = own[i]
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        lengths[~easy] = [len(c) for c in own.values()]
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        firsts = np.empty(len(keys), np.int64)
        firsts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate([_by_points(b"".join(stems), self.pieces(stems)), *own.values()]), firsts, lengths

    def stored(self, texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """(number of tokens of each text, its ``StoredCounts``)."""
        numbers, keys, bounds = numbered(texts, True)
        flat, firsts, lengths = self.tables(keys)
        change = np.diff(flat, prepend=0)
        starts = firsts[lengths > 0]
        change[starts] = flat[starts]
        width = 1 if np.abs(change).max(initial=0) < 128 else 4
        each = lengths[numbers]
        at = np.concatenate([[0], np.cumsum(each)])
        changes = change.astype(f"<i{width}")[np.repeat(firsts[numbers] - at[:-1], each) + np.arange(at[-1])]
        before = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
        first = at[bounds]
        data, out = changes.tobytes(), []
        for i, j in pairwise(first.tolist()):
            samples = (before[i + EVERY : j : EVERY] - before[i]).astype("<u4").tobytes()
            out.append(StoredCounts.HEAD.pack(j - i, width) + samples + data[i * width : j * width])
        return np.diff(before[first]), out

    def counts(self, text: str) -> np.ndarray:
        """Token count of every prefix."""
        return StoredCounts(self.stored([text])[1][0]).counts()

    def normalise(self, word: str) -> str:
        """A word as the tokenizer sees it; special tokens stay as they are."""
        normal, out, at = self.tokenizer.normalizer.normalize_str, [], 0
        for m in self.special.finditer(word) if self.special else ():
            out += [normal(word[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, normal(word[at:])])

    def truncate(self, text: str, budget: int, stored: bytes | None = None) -> str:
        """The longest prefix of the normalised words, joined by single spaces, within ``budget`` tokens.

        ``stored``: the text's stored counts, if there are any; nothing is counted then.
        """
        left, out = StoredCounts(stored or self.stored([text])[1][0]).longest(budget), []
        for w in map(self.normalise, split_words(text)):
            if left <= 0:
                break
            out.append(w[:left])
            left -= len(w)
        return " ".join(out)


class StoredCounts:
    """Token counts of a text's prefixes: u32 code points, u8 width, u32 counts before every 256th, and each one's change."""

    HEAD = struct.Struct("<IB")

    def __init__(self, data: bytes):
        self.n, width = self.HEAD.unpack_from(data)
        samples = max(0, (self.n - 1) // EVERY)
        self.samples = np.frombuffer(data, "<u4", samples, self.HEAD.size)
        self.changes = np.frombuffer(data, f"<i{width}", self.n, self.HEAD.size + 4 * samples)

    def count(self, points: int) -> int:
        """Tokens of the first ``points`` code points: a sample and at most 256 changes."""
        k = min(points // EVERY, len(self.samples))
        return (int(self.samples[k - 1]) if k else 0) + int(self.changes[k * EVERY : points].sum(dtype=np.int64))

    def counts(self) -> np.ndarray:
        return np.cumsum(self.changes, dtype=np.int64)

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        fits = np.flatnonzero(self.counts() <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=4)
def prefix_counts(path: str) -> PrefixCounts:
    """One a Python worker, so that its tables outlive a task."""
    return PrefixCounts(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit and prefix_counts, the stored counts of all prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(tokenizer)
        for batch in batches:
            for part in parts(batch, BYTES_AT_ONCE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                totals, stored = counter.stored(texts)
                cols = [part.column("doc_id"), pa.array([len(_raw(t)) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array(totals > limit), pa.array(stored, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_counts"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, prefix_counts binary")


def truncated(counted: DataFrame, tokenizer: str, budget: int, text_col: str = "text") -> DataFrame:
    """``counted`` (text, prefix_counts) with the text's longest prefix of ``budget`` tokens, from the stored counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(tokenizer)
        for batch in batches:
            both = zip(batch.column(text_col).to_pylist(), batch.column("prefix_counts").to_pylist(), strict=True)
            out = [t if t is None or c is None else counter.truncate(t, budget, c) for t, c in both]
            rest = [c for c in batch.schema.names if c != "truncated"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(out, pa.string())], [*rest, "truncated"])

    counted = counted.drop("truncated")
    return counted.mapInArrow(run, counted.withColumn("truncated", F.lit(None).cast("string")).schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
