"""Token ids of whole texts by a byte-level BPE vocabulary file, the same ids the tokenizers library gives.

A batch is split into words by code point classes in numpy (the split rule of the vocabulary as boundary masks), each
distinct word is merged once by tiktoken, and ids are gathered from the distinct words. Texts that contain one of the
file's added tokens go to the tokenizers library whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from tideline.llm.common import ranges

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Bytes of text split at once, and distinct words a worker remembers.
BATCH, REMEMBERED = 1 << 20, 1 << 18

OTHER, LETTER, NUMBER, SPACE = range(4)

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, points):
            table[np.frombuffer(run.group().encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = SPACE
    return table


def word_starts(points: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a word begins; documents: mask of those at which a text begins."""
    kind = _classes()[points]
    begins = documents.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last white space before a word is a word of its own, or part of that word if it is a blank.
    after = np.flatnonzero(begins[1:] & ~documents[1:] & (kind[:-1] == SPACE)) + 1
    begins[after - 1] = True
    begins[after] = points[after - 1] != 0x20
    # A lone apostrophe takes s, t, m, d, re, ve or ll after it.
    quote = np.flatnonzero((points == 0x27) & begins)
    n = len(points)
    if len(quote):
        padded = np.append(points, [0, 0, 0]).astype(np.uint32)
        inside = np.append(~documents, [False] * 3)
        quote = quote[inside[quote + 1]]
        one, two = padded[quote + 1], np.where(inside[quote + 2], padded[quote + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quote[short | long] + 1] = False
        begins = np.append(begins, [False] * 3)
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
        begins = begins[:n]
    return begins


class ByteBpe:
    """The ids of texts; one instance per worker and file (see load)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if all(c in byte_of for c in word)}
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        for token in self.added:
            ranks.pop(token, None)
        self.merge = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.path, self.whole = path, None
        self.words: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as bytes of uint32, which the garbage collector need not visit."""
        known = list(map(self.words.get, words))
        for i, ids in enumerate(known):
            if ids is None:
                known[i] = ids = array("I", self.merge(words[i])).tobytes()
                if len(self.words) < REMEMBERED and len(ids) < 128:
                    self.words[words[i]] = ids
        return known

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number per text of a binary array without nulls."""
        offsets = np.asarray(pc.binary_length(texts), np.int64)
        ends = np.cumsum(offsets)
        starts = ends - offsets
        data = b"".join(texts.to_pylist())
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            place = None
        else:
            width = np.ones(len(points) + 1, np.int32)
            width[0] = 0
            for least in (0x80, 0x800, 0x10000):
                width[1:] += points >= least
            place = np.cumsum(width, dtype=np.int32)
        first = starts[offsets > 0] if place is None else np.searchsorted(place, starts[offsets > 0])
        documents = np.zeros(len(points), bool)
        documents[first] = True
        at = np.flatnonzero(word_starts(points, documents))
        at = at if place is None else place[at]
        words = pa.BinaryArray.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, distinct), np.int32, len(distinct)) // 4
        flat, codes = np.frombuffer(b"".join(distinct), np.uint32), words.indices.to_numpy()
        length = sizes[codes]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[codes], length)]
        before = np.append(0, np.cumsum(length))
        return ids, np.diff(before[np.append(np.searchsorted(at, starts), len(at))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) and the number of ids of each text of a binary array without nulls."""
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= np.asarray(pc.count_substring(texts, token)).astype(bool)
        plain = texts if not odd.any() else pc.if_else(pa.array(odd), pa.scalar(b"", texts.type), texts)
        ids, lengths = self._split(plain)
        if odd.any():
            self.whole = self.whole or Tokenizer.from_file(self.path)
            ends = np.cumsum(lengths)
            parts = [self.whole.encode(texts[i].as_py().decode(), add_special_tokens=False).ids if odd[i] else ids[ends[i] - lengths[i]: ends[i]]
                     for i in range(len(texts))]
            ids = np.concatenate([np.asarray(p, np.uint32) for p in parts])
            lengths = np.array([len(p) for p in parts], np.int64)
        return ids, lengths


@lru_cache(4)
def load(path: str = VOCABULARY) -> ByteBpe:
    return ByteBpe(path)
