"""Token ids of white-space separated words, by the tokenizers library, with a bounded cache.

For vocabularies whose pre-tokenizer never lets a piece cross white space (word_bpe_49k.json), a
text's ids are the ids of its words in order, so each distinct word is encoded once; words that differ
in case and closing signs only share the encoding of their stem.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

#: The separators C0 28-31 split for str.split() but are no white space to the tokenizer.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: The White_Space property.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

CACHE_WORDS = 600_000
#: Letters of Latin-1, which have one-letter lower cases, and the signs of ASCII.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
ALL_LETTERS = "".join(re.findall(f"[{LETTERS}]", "".join(map(chr, range(256)))))
SIGNS = string.punctuation
#: Words that are one piece, or one and a closing sign.
EASY = re.compile(f"[{LETTERS}]+[.,;:!?]?")
STEM = re.compile(f"[{LETTERS}]+")
STEMS_AT_ONCE = 2000


def split_words(text: str) -> list[str]:
    """Maximal runs without white space."""
    if NOT_SPACE.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def numbered(texts: list[str], stems: bool) -> tuple:
    """The texts' words as numbers of distinct keys, the keys, and where each text begins and ends in the numbers.

    With ``stems`` a word of Latin-1 letters and closing signs has two keys, its lower-case stem and
    its signs (maybe none), so that words that differ in case and signs share a stem; others have one.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if any(map(NOT_SPACE.search, texts)):
        words = pa.array(list(map(split_words, texts)), pa.large_list(pa.large_string()))
    else:
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))  # its white space is that of str.split
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(words)), dtype=np.int64)])
    coded = pc.dictionary_encode(words.flatten())
    numbers, words = np.asarray(coded.indices), coded.dictionary
    if stems:
        stem = pc.utf8_rtrim(words, SIGNS)
        easy = pc.match_substring_regex(stem, f"^[{LETTERS}]+$")
        signs = pc.if_else(easy, pc.utf8_ltrim(words, ALL_LETTERS), "")
        coded = pc.dictionary_encode(pa.concat_arrays([pc.if_else(easy, pc.utf8_lower(stem), words), signs]))
        numbers, words = np.asarray(coded.indices).reshape(2, -1).T[numbers].ravel(), coded.dictionary
        bounds = bounds * 2
    return numbers, words.to_numpy(zero_copy_only=False).tolist(), bounds


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def plain(path: str):
    """The same model for text that is normal already: pieces are parted by spaces, nothing else is done to them."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    said |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
    return Tokenizer.from_str(json.dumps(said))


class WordIds:
    """Maps stems, signs and other words to their ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        import numpy as np

        self.tokenizer, self.dtype = load(path), dtype
        self.cache: dict[str, bytes] = {}
        self.batch = self.tokenizer.encode_batch_fast  # ids without offsets
        self.plain = plain(path)
        # which tokens end a piece, where the vocabulary marks that
        mark = self.tokenizer.model.end_of_word_suffix
        self.ends = None
        if mark:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True

    def values(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct stems, signs and other words; lower-case stems are encoded many at once."""
        import numpy as np

        found = list(map(self.cache.get, keys))
        new = [k for k, v in zip(keys, found, strict=True) if v is None]
        if not new:
            return found
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {k: v for k, v in zip(keys, found, strict=True) if v is not None}  # the frequent ones stay
        stems = [k for k in new if STEM.fullmatch(k)] if self.ends is not None else []
        lines = [stems[i : i + STEMS_AT_ONCE] for i in range(0, len(stems), STEMS_AT_ONCE)]
        for line, e in zip(lines, self.plain.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()  # parted at the tokens that end a piece
            data = ids.tobytes()
            self.cache.update(zip(line, (data[i:j] for i, j in pairwise([0, *at])), strict=True))
        rest = [k for k in new if k not in self.cache]
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            self.cache.update(zip(part, (np.array(e.ids, self.dtype).tobytes() for e in self.batch(part, add_special_tokens=False)), strict=True))
        return list(map(self.cache.__getitem__, keys))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: keys are numbered, looked up once each, and their ids laid out by number."""
        import numpy as np

        numbers, keys, bounds = numbered(texts, self.ends is not None)
        found = self.values(keys)
        ids = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        firsts, each = (np.cumsum(lengths) - lengths)[numbers], lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(each)])
        data = ids[np.repeat(firsts - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        at = (ends[bounds] * ids.itemsize).tolist()
        return [data[i:j] for i, j in pairwise(at)]


@lru_cache(maxsize=4)
def word_ids(path: str, dtype: str = "<u4") -> WordIds:
    """One a Python worker, so that its cache outlives a task."""
    return WordIds(path, dtype)


def parts(batch, size: int, column: str = "text") -> Iterator:
    """Consecutive parts of an Arrow batch with about ``size`` bytes in ``column``; a longer value stands alone.

    Memory that Arrow holds in reserve goes back after the last, as workers live on between tasks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.take(pa.array(np.arange(first, last)))  # a copy: some kernels misread text that is a slice of a batch
        first = last
    pa.default_memory_pool().release_unused()
