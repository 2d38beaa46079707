"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

A batch of texts becomes one array of code points. A class array (letter, number, space, other
white space, apostrophe that opens a contraction of one or two letters, other) gives every
position a transition function over the states of the pattern's automaton. The functions that
can arise form a small monoid, so their composition is one table look-up, and a blocked
associative scan finds the state before every position; state changes are the boundaries. The
slices between boundaries are numbered by Arrow and go to pair merging by rank, once for each distinct
slice of a batch that the cache does not hold.

Every token's byte offset is kept with the ids. Decoding is a gather: the offsets say where each token's
bytes go, and which tokens a range of bytes needs, so part of a text is decoded without the rest.

Classes come from the tokenizer library's own engine, so that its version of Unicode holds.

Defined results: null text is empty and has no ids; repeated rows each keep theirs; null ids of
documents are kept. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .word_tokens import parts

# classes
LETTER, NUMBER, OTHER, SPACE, WHITE, OPEN1, OPEN2 = range(7)
CLASSES = 7
# states: what the last character was
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, WANT2, WANT1, CLOSED = range(9)
STATES = 9
#: Contractions that the pattern splits off.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
BLOCK = 256
BYTES_AT_ONCE = 1_000_000
CACHE_SLICES = 150_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: the letters, numbers and white space that the library's patterns find."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    ranks = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = bytes(tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[ord(" ")] = SPACE
    return out


def _step(state: int, kind: int) -> int:
    if state == WANT2:
        return WANT1
    if state == WANT1:
        return CLOSED
    if kind in (OPEN1, OPEN2):  # an apostrophe after other signs or one space belongs to them
        return IN_OTHER if state in (IN_OTHER, AFTER_SPACE) else WANT1 if kind == OPEN1 else WANT2
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, WHITE: IN_WHITE}[kind]


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class and of each class at a text's start, product table, state after START under each element)."""
    step = [tuple(_step(s, k) for s in range(STATES)) for k in range(CLASSES)]
    first = [(f[START],) * STATES for f in step]
    elements = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *step, *first]))}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in step + first:
            if (h := tuple(g[s] for s in f)) not in elements:
                elements[h] = len(elements)
                todo.append(h)
    listed = list(elements)
    product = np.array([[elements[tuple(g[s] for s in f)] if tuple(g[s] for s in f) in elements else 0 for g in listed] for f in listed], np.uint16)
    return np.array([elements[f] for f in step + first], np.uint16), product, np.array([f[START] for f in listed], np.uint8)


def scan(elements: np.ndarray) -> np.ndarray:
    """Inclusive products of monoid elements from the left: blocks side by side, then the blocks' totals, then both."""
    _, product, _ = monoid()
    m, flat, n = len(product), monoid()[1].ravel(), len(elements)
    if n <= BLOCK:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    width = -(-n // BLOCK)
    rows = np.zeros(BLOCK * width, np.uint16)  # element 0 changes nothing
    rows[:n] = elements
    rows = np.ascontiguousarray(rows.reshape(width, BLOCK).T)
    for i in range(1, BLOCK):
        np.take(flat, rows[i - 1].astype(np.int32) * m + rows[i], out=rows[i])
    before = np.zeros(width, np.uint16)
    before[1:] = scan(rows[-1])[:-1]
    return np.take(flat, before.astype(np.int32) * m + rows).T.ravel()[:n]


def _no_break() -> np.ndarray:
    """[state before, state after]: True where a token goes on (white space is settled apart)."""
    t = np.zeros((STATES, STATES), bool)
    for run in (IN_LETTERS, IN_NUMBERS, IN_OTHER):
        t[run, run] = t[AFTER_SPACE, run] = True
    t[WANT2, WANT1] = t[WANT1, CLOSED] = True
    for a in (AFTER_SPACE, IN_WHITE):
        for b in (AFTER_SPACE, IN_WHITE):
            t[a, b] = True
    return t


GOES_ON = _no_break()


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all texts as one in UTF-8, bounds in it of the slices, first slice of each text and their number)."""
    classes = class_table()
    whole = "".join(texts)
    n = len(whole)
    lengths = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(lengths) - lengths
    if not n:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    raw = whole.encode("utf-8", "replace")  # a lone surrogate is a question mark
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    kind = classes[points]
    starts = np.zeros(n + 1, bool)
    starts[firsts[lengths > 0]] = starts[n] = True
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[marks + 1], padded[marks + 2]
        inside = ~starts[marks + 1]  # the next character is of the same text
        both = inside & ~starts[np.minimum(marks + 2, n)]
        kind[marks[inside & np.isin(one, [ord(c) for c in ONE_LETTER])]] = OPEN1
        long = np.zeros(len(marks), bool)
        for a, b in TWO_LETTERS:
            long |= (one == ord(a)) & (two == ord(b))
        kind[marks[both & long]] = OPEN2
    of_class, _, after_start = monoid()
    state = after_start[scan(of_class[kind + CLASSES * starts[:n].astype(np.uint8)])]
    cut = np.ones(n, bool)
    cut[1:] = ~GOES_ON[state[:-1], state[1:]]
    # the last of several white-space characters stands apart if the text goes on after them
    white = (state == AFTER_SPACE) | (state == IN_WHITE)
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~starts[1:]
    cut[1:] |= last[1:] & white[:-1]
    cut |= starts[:n]
    at = np.flatnonzero(cut)
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    bounds = np.append(np.cumsum(sizes)[at] - sizes[at], len(raw))
    return raw, bounds, np.searchsorted(at, np.concatenate([firsts, [n]]))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pair merging by least rank, leftmost first; a heap of pairs, so long pieces take n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 32:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # by first byte of a part: its end, the part before
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        k = end[i]
        if not alive[i] or k >= n or end[k] != j:
            continue
        end[i], alive[k] = j, False
        if j < n:
            left[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if (p := left[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
            heapq.heappush(heap, (r, p, j))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class ByteBpe:
    """Encoder and decoder over a rank file; slices are cached up to a bound."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            pieces[i] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, slices: list[bytes]) -> list[bytes]:
        """The ids of distinct slices."""
        found = list(map(self.cache.get, slices))
        new = {s: np.array(merge(s, self.ranks), "<u4").tobytes() for s, v in zip(slices, found, strict=True) if v is None}
        if len(self.cache) + len(new) > CACHE_SLICES:  # the frequent ones stay
            self.cache = {s: v for s, v in zip(slices, found, strict=True) if v is not None}
        self.cache.update((s, v) for s, v in new.items() if len(s) <= 64)
        return [v if v is not None else new[s] for s, v in zip(slices, found, strict=True)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and their number)."""
        raw, bounds, first = boundaries(texts)
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        coded = slices.dictionary_encode()
        found, numbers = self._ids(coded.dictionary.to_pylist()), np.asarray(coded.indices)
        ids = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids[np.repeat((np.cumsum(lengths) - lengths)[numbers] - ends[:-1], each) + np.arange(ends[-1])], ends[first]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, first = self.encode_all(texts)
        return [ids[i:j].tobytes() for i, j in pairwise(first.tolist())]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every token in the decoded text, and its length at the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray, first: int = 0, last: int | None = None) -> bytes:
        """Bytes ``first`` to ``last`` of the text, from the tokens whose offsets meet that range."""
        last = int(offsets[-1]) if last is None else min(last, int(offsets[-1]))
        if first >= last:
            return b""
        i, j = np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, last, "left")
        at = offsets[i : j + 1].astype(np.int64)
        places = np.repeat(self.firsts[ids[i:j]] - at[:-1], np.diff(at)) + np.arange(at[0], at[-1])
        return self.bytes[places[first - at[0] : last - at[0]]].tobytes()


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One a Python worker, so that its cache outlives a task."""
    return ByteBpe(path)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, digests of ids and of the bytes decoded by the offsets, ids and offsets (both u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            for part in parts(batch, BYTES_AT_ONCE):
                ids, first = bpe.encode_all([t or "" for t in part.column("text").to_pylist()])
                offsets = bpe.offsets(ids)
                text, spans = bpe.decode(ids, offsets), list(pairwise(first.tolist()))
                own = [ids[a:b].tobytes() for a, b in spans]
                decoded = [hashlib.sha256(text[offsets[a] : offsets[b]]).hexdigest() for a, b in spans]
                kept = [(offsets[a : b + 1] - offsets[a]).astype("<u4").tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()),
                     pa.array(decoded, pa.string()), pa.array(own, pa.binary()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"],
                )

    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (ids, offsets) with the column ``bytes``, the decoded text; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            both = zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist(), strict=True)
            out = [None if x is None or y is None else bpe.decode(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in both]
            rest = [c for c in batch.schema.names if c != "bytes"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(out, pa.binary())], [*rest, "bytes"])

    encoded = encoded.drop("bytes")
    return encoded.mapInArrow(run, encoded.selectExpr("*", "cast(null as binary) as bytes").schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
