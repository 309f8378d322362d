"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

No merge of the vocabulary crosses a blank that follows another symbol, nor a character the vocabulary lacks, so a text
falls into words that merge on their own and each distinct word is merged once. The words of a batch lie in one flat
symbol array. A round finds each word's best pair (a segmented minimum of ranks), merges its leftmost place in all words
at once, looks up the two pairs that changed, and closes the gaps; words without a pair leave the array. Words of more
than LONG symbols, for which rounds would be many, are merged one by one with a heap in the same order.

Null counts as empty; the empty text has the end id alone. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ranges, slices, text_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = 0x2581
BATCH, REMEMBERED, LONG = 1 << 22, 1 << 18, 200
NONE = np.int32(2**31 - 1)


class PieceBpe:
    """Vocabulary tables, and encoding and decoding with them; one instance per worker and file (see load)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i]]
        if any("▁" in pieces[i].lstrip("▁") for i in normal):
            raise ValueError("pieces with a blank inside are not supported")
        self.end = model.eos_id()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        # Symbols: the ids, then characters that only occur inside pieces, then (base + code point) all other characters.
        symbol = {pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in pieces[i]} - set(symbol)):
            symbol[c] = n + len([s for s in symbol.values() if s >= n])
        self.base = max(n, max(symbol.values()) + 1)
        self.of_point = np.arange(0x110000, dtype=np.int32) + self.base
        self.point_of = {s: ord(c) for c, s in symbol.items() if s >= n}
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_point[ord(c)] = s
        self.of_point[0x20] = self.of_point[BLANK]
        order = {i: rank for rank, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        pairs = sorted(
            (symbol[pieces[i][:k]] * self.base + symbol[pieces[i][k:]], order[i], i)
            for i in normal for k in range(1, len(pieces[i])) if pieces[i][:k] in symbol and pieces[i][k:] in symbol)
        keys, ranks, merged = (np.array(x) for x in zip(*pairs, strict=True))
        self.keys, self.ranks, self.merged = keys.astype(np.int64), ranks.astype(np.int32), merged.astype(np.int32)
        self.n = n
        self.decoded = [b"" if model.is_control(i) else pieces[i].replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        self.decoded[model.unk_id()] = " ⁇ ".encode()
        self.words: dict[bytes, bytes] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where the vocabulary has no such piece."""
        key = left.astype(np.int64) * self.base + right
        key[(left >= self.base) | (right >= self.base)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def merge_words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each word of a flat symbol array until no pair remains: flat symbols and length per word."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        out_symbols, out_words = [], []
        rank, merged = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)
        joined = np.flatnonzero(word[:-1] == word[1:])
        rank[joined], merged[joined] = self._pairs(symbols[joined], symbols[joined + 1])
        while len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():  # compaction
                leave = np.repeat(done, sizes)
                out_symbols.append(symbols[leave])
                out_words.append(word[leave])
                stay = ~leave
                symbols, word, rank, merged = symbols[stay], word[stay], rank[stay], merged[stay]
                sizes, best = sizes[~done], best[~done]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            symbols[hit] = merged[hit]
            stay = np.ones(len(word), bool)
            stay[hit + 1] = False
            symbols, word, rank, merged = symbols[stay], word[stay], rank[stay], merged[stay]
            hit -= np.arange(len(hit))
            changed = np.unique(np.concatenate([hit, hit - 1]))
            changed = changed[changed >= 0]
            last = changed == len(word) - 1
            inside = ~last
            inside[inside] = word[changed[inside]] == word[changed[inside] + 1]
            rank[changed[~inside]] = NONE
            look = changed[inside]
            rank[look], merged[look] = self._pairs(symbols[look], symbols[look + 1])
        if not out_words:
            return symbols, lengths
        words = np.concatenate(out_words)
        order = np.argsort(words, kind="stable")
        return np.concatenate(out_symbols)[order], np.bincount(words, minlength=len(lengths))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word, with a heap of pairs."""
        symbol, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self._pairs(symbols[:-1], symbols[1:])
        heap = [(int(rank[i]), int(i), symbol[i], symbol[i + 1], int(merged[i])) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            rank, merged = self._pairs(np.array([symbol[i]]), np.array([symbol[j]]))
            if rank[0] != NONE:
                heapq.heappush(heap, (int(rank[0]), i, symbol[i], symbol[j], int(merged[0])))

        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([s for s in symbol if s >= 0], np.int32)

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each distinct word, as bytes of uint32."""
        known = list(map(self.words.get, words))
        new = [i for i, ids in enumerate(known) if ids is None]
        if new:
            texts = [words[i].decode() for i in new]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            symbols = self.of_point[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
            ends = np.cumsum(lengths)
            long = np.flatnonzero(lengths > LONG)
            if len(long):
                merged = {int(i): self.merge_long(symbols[ends[i] - lengths[i]: ends[i]]) for i in long}
                short = lengths <= LONG
                flat, sizes = self.merge_words(symbols[np.repeat(short, lengths)], lengths[short])
                at = np.cumsum(sizes) - sizes
                parts = iter(flat[a: a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True))
                parts = [merged[i] if i in merged else next(parts) for i in range(len(new))]
                flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            else:
                flat, sizes = self.merge_words(symbols, lengths)
            ids, sizes = self._fallback(flat, sizes)
            data, ends = ids.tobytes(), np.cumsum(sizes) * 4
            for i, e, n in zip(new, ends.tolist(), (sizes * 4).tolist(), strict=True):
                known[i] = found = data[e - n: e]
                if len(self.words) < REMEMBERED and n <= 128:
                    self.words[words[i]] = found
        return known

    def _fallback(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids; a character without an id becomes the ids of its UTF-8 bytes."""
        odd = np.flatnonzero(flat >= self.n)
        if not len(odd):
            return flat.astype(np.uint32), sizes
        count = np.ones(len(flat), np.int64)
        spelled = [self.byte_ids[list(chr(self.point_of.get(s, s - self.base)).encode())] for s in flat[odd].tolist()]
        count[odd] = [len(x) for x in spelled]
        out = np.repeat(flat, count).astype(np.uint32)
        at = np.cumsum(count) - count
        out[ranges(at[odd], count[odd])] = np.concatenate(spelled)
        before = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(sizes))]
        return out, np.diff(before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32, without end ids) and number per text of a binary array without nulls."""
        filled = [b" " + t if t else b"" for t in texts.to_pylist()]  # the blank that begins every text
        data = b"".join(filled)
        bytes_of = np.fromiter(map(len, filled), np.int64, len(filled))
        starts = np.cumsum(bytes_of) - bytes_of
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(filled), np.int64)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        width = np.ones(len(points) + 1, np.int32)
        width[0] = 0
        for least in (0x80, 0x800, 0x10000):
            width[1:] += points >= least
        place = np.cumsum(width, dtype=np.int32)
        blank, odd = (points == 0x20) | (points == BLANK), self.of_point[points] >= self.base
        begins = odd.copy()
        begins[1:] |= odd[:-1] | (blank[1:] & ~blank[:-1])
        begins[np.searchsorted(place, starts[bytes_of > 0])] = True
        at = place[:-1][begins]
        words = pa.BinaryArray.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = self._encoded(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        flat, codes = np.frombuffer(b"".join(distinct), np.uint32), words.indices.to_numpy()
        length = sizes[codes]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[codes], length)]
        before = np.append(0, np.cumsum(length))
        return ids, np.diff(before[np.append(np.searchsorted(at, starts), len(at))])

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text the ids stand for; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.decoded.__getitem__, ids))
        if data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace").encode()


@lru_cache(4)
def load(path: str = MODEL) -> PieceBpe:
    return PieceBpe(path)


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            ids, lengths = model.encode(batch.column("text"))
            ends = np.cumsum(lengths + 1)
            closed = np.full(int(ends[-1]), model.end, np.int32)
            inside = np.ones(len(closed), bool)
            inside[ends - 1] = False
            closed[inside] = ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(closed))], ["doc_id", "ids"])


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in batches:
        texts = [model.decode(ids.values.to_numpy().tolist()) for ids in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    decimal = [str(i).encode() for i in range(model.n)]
    for batch in _encoded(path, batches):
        counts, shas, texts = [], [], []
        for ids in batch.column("ids"):
            row = ids.values.to_numpy().tolist()
            counts.append(len(row))
            shas.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, row))).hexdigest())
            texts.append(hashlib.sha256(model.decode(row)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(texts)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_bytes())


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (array, end id included) of every text."""
    return _input(docs).mapInArrow(partial(_encoded, model), "doc_id bigint, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of every row of ids."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, model), "doc_id bigint, text string")


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding, then decoding of those ids, in one pass."""
    return _input(docs).mapInArrow(partial(_digests, model), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
