"""Removal of repeated passages by sorted suffixes (deep-shallow), exact to the byte.

A byte goes when a SPAN-byte string that covers it also starts anywhere else. Sorting every suffix of the corpus is not
needed to find them: of the grams in each SPAN-byte string the one of least hash is its anchor, equal strings have equal
anchors at equal places, so equal strings meet where anchors with the same gram are brought together.

1. Anchors (about one per 185 bytes) with the range of strings they stand for. Texts that are equal as a whole are taken
   once; with SPAN bytes or more they go entirely.
2. Anchors whose gram occurs once are dropped; the others get their context, the bytes that their strings cover.
3. The suffixes at the anchors of one gram are sorted to the right of it and, mirrored, to the left: multikey quicksort
   (symbols of eight bytes, three-way splits, all segments of a round at once) to a shallow depth, then a blind trie for
   each group that is still equal, which also gives the common prefix of neighbours. At every distance d from start to anchor, strings are equal exactly if they share the class of
   common prefixes SPAN - d to the right and d to the left.
4. Spans per text are merged and cut.

Grams shared by more than CROWD anchors are set apart before anything is joined on the gram and are not gathered: their
strings are counted by digest instead (blake2b, 128 bits). There are fewer of them than anchors / CROWD; the list is
broadcast up to CROWDED_MOST and joined by shuffle beyond.

With a least number of words the same search also runs over texts in which each word (what white space parts) is its
WORD-byte hash: strings of that many words that also start elsewhere go too, however few bytes they have and whatever white
space lies between their words. A shared string that begins inside a hash is cut to the whole words in it.

Null counts as empty. Repeated rows are copies of each other. A text with long runs of one byte has an anchor per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stages, column, ranges, run_starts, slices, text_bytes, unwrapped, whole_groups, wrapped

SPAN, GRAM = 400, 32
WORD = 8  #: bytes of a word's hash
SHALLOW = 16  #: bytes ordered by multikey quicksort
CROWD = 50_000
CROWDED_MOST = 200_000  #: grams in a broadcast list
BATCH = 1 << 20

ANCHOR_SCHEMA = "doc_id bigint, digest binary, n_bytes bigint, long boolean, wordy boolean, anchors array<struct<gram:bigint,at:int,low:int,high:int>>"
CONTEXT_SCHEMA = "gram bigint, digest binary, at int, low int, high int, left binary, right binary"
FOUND_SCHEMA = "digest binary, start int, stop int"
CUT_SCHEMA = "digest binary, text binary, spans array<struct<start:int,stop:int>>"
EMPTY = hashlib.sha256(b"").digest()
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        h, base, width = data.astype(np.uint64) + np.uint64(0x9E37), np.uint64(0x9E3779B97F4A7C15), 1
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            base, width = base * base, width * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values (running minima from both ends of blocks)."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For joined texts (a line feed between two): the bytes, first byte and end of each word, and number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.append(0, edge)
    first, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, first, end, np.diff(np.searchsorted(first, np.append(0, ends)))


def word_hashes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """WORD bytes for each word of all texts, and the bytes of each text: a polynomial of the word's bytes, mixed."""
    data, first, end, many = word_places(texts)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        power = np.full(len(data) + 1, _ODD)
        np.cumprod(power, out=power)
        total[1:] = data
        total[1:] += np.uint64(0x1F3)
        total[1:] *= power[:-1]
        np.cumsum(total, out=total)
        h = total[end] - total[first]
        # Sums of powers from the word's place on, brought to place 0 by the inverse powers.
        power[:] = _ODD_INVERSE
        np.cumprod(power, out=power)
        h = h * power[first] + (end - first).astype(np.uint64)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
    return h.astype("<u8").tobytes(), many * WORD


def anchors(data: bytes, lengths: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """For joined texts: text number, gram hash, place in the text, and the least and greatest distance from the start
    of the span-byte strings that the place is the anchor of."""
    none = np.empty(0, np.int64)
    if len(data) < span:
        return none, none, none, none, none
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    least = window_least((hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64), span - GRAM + 1)
    ends = np.cumsum(lengths)
    strings = np.maximum(0, lengths - span + 1)
    start = ranges(ends - lengths, strings)
    text = np.repeat(np.arange(len(lengths)), strings)
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none, none, none
    runs = run_starts(at, text)
    first, last = runs[:-1], runs[1:] - 1
    text, at = text[first], at[first]
    begin = (ends - lengths)[text]
    return text, hashes[at].view(np.int64), at - begin, at - start[last], at - start[first]


def _anchored(batches: Iterator[pa.RecordBatch], words: int | None, span: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            texts = batch.column("text").to_pylist()
            n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
            joined, lengths = word_hashes(texts) if words else (b"".join(texts), n_bytes)
            trimmed = np.fromiter((len(t.strip()) for t in texts), np.int64, len(texts)) if words else n_bytes
            text, gram, at, low, high = anchors(joined, lengths, span)
            fields = pa.StructArray.from_arrays(
                [pa.array(gram), *(pa.array(x.astype(np.int32)) for x in (at, low, high))], ["gram", "at", "low", "high"])
            offsets = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(trimmed),
                 pa.array((n_bytes >= SPAN) | (lengths >= span)), pa.array(lengths >= span), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)],
                ["doc_id", "digest", "n_bytes", "long", "wordy", "anchors"])


def _contexts(batches: Iterator[pa.RecordBatch], words: int | None, span: int) -> Iterator[pa.RecordBatch]:
    names = ["gram", "digest", "at", "low", "high", "left", "right"]
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            lists = batch.column("anchors")
            many = np.asarray(pa.compute.list_value_length(lists))
            row = np.repeat(np.arange(batch.num_rows), many)
            fields = lists.flatten()
            gram, at, low, high = (fields.field(n).to_numpy() for n in ("gram", "at", "low", "high"))
            texts = batch.column("text").to_pylist()
            if words:
                joined, lengths = word_hashes(texts)
                ends = np.cumsum(lengths).tolist()
                texts = [joined[b - n: b] for b, n in zip(ends, lengths.tolist(), strict=True)]
            left = [texts[r][a - h: a][::-1] for r, a, h in zip(row.tolist(), at.tolist(), high.tolist(), strict=True)]
            right = [texts[r][a + GRAM: a - d + span] for r, a, d in zip(row.tolist(), at.tolist(), low.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), batch.column("digest").take(pa.array(row)), pa.array(at), pa.array(low), pa.array(high),
                 pa.array(left, pa.binary()), pa.array(right, pa.binary())], names)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings, and the common prefix of each with the one before it (the first: 0).

    Inner nodes hold a depth and children by the byte at that depth (-1: the string ends there). A string goes down
    blindly to some leaf, is compared with that one string only, and is hung in where the two part.
    """
    leaves: list[tuple[bytes, list[int]]] = [(strings[0], [0])]
    root: list | int = 0  # inner node [depth, {byte: node}] or number of a leaf
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while not isinstance(node, int):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1, next(iter(children.values())))
        other, members = leaves[node]
        common = _common(s, other)
        if common == len(s) == len(other):
            members.append(i)
            continue
        leaves.append((s, [i]))
        leaf, parent, node = len(leaves) - 1, None, root
        while not isinstance(node, int) and node[0] < common:
            parent, node = node, node[1][s[node[0]]]
        byte = s[common] if common < len(s) else -1
        if not isinstance(node, int) and node[0] == common:
            node[1][byte] = leaf
            continue
        inner = [common, {byte: leaf, (other[common] if common < len(other) else -1): node}]
        if parent is None:
            root = inner
        else:
            parent[1][s[parent[0]]] = inner
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, int):
            text, members = leaves[node]
            order += members
            common += [shared] + [len(text)] * (len(members) - 1)
        else:
            depth, children = node
            ordered = sorted(children)
            stack += [(children[b], depth) for b in ordered[:0:-1]]
            stack.append((children[ordered[0]], shared))
    return order, common


def multikey_order(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Order of the rows of symbols within ascending groups, by multikey quicksort.

    A segment is split around its middle row's symbol at the segment's depth into less, equal and greater; only the
    equal part goes one symbol deeper. Every round splits all open segments at once.
    """
    n, depth_end = symbols.shape
    order = np.arange(n)
    starts = run_starts(group)
    first, size = starts[:-1], np.diff(starts)
    depth = np.zeros(len(first), np.int64)
    while True:
        open_ = (size > 1) & (depth < depth_end)
        first, size, depth = first[open_], size[open_], depth[open_]
        if not len(first):
            return order
        places, segment = ranges(first, size), np.repeat(np.arange(len(first)), size)
        key = symbols[order[places], depth[segment]]
        pivot = symbols[order[first + size // 2], depth][segment]
        code = segment * 3 + (key >= pivot) + (key > pivot)
        by = np.argsort(code, kind="stable")
        order[places] = order[places][by]
        cuts = run_starts(code[by])
        part = code[by][cuts[:-1]]
        depth = depth[part // 3] + (part % 3 == 1)
        first, size = places[cuts[:-1]], np.diff(cuts)


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within ascending groups, and the common prefix with the string before (-1: a new group)."""
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(-1, SHALLOW // 8).astype(np.uint64)
    order = multikey_order(group, head)
    common = np.full(len(order), -1, np.int64)
    starts = run_starts(group[order], *head[order].T)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if a and group[order[a]] == group[order[a - 1]]:
            common[a] = _common(strings[order[a]][:SHALLOW], strings[order[a - 1]][:SHALLOW])
        if b - a > 1:  # still equal at the shallow depth
            members = order[a:b]
            inner, shared = blind_trie_order([strings[i] for i in members])
            order[a:b] = members[inner]
            common[a + 1: b] = shared[1:]
    return order, common


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray,
             span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance at which a context's string is another context's too; least > greatest: none."""
    n = len(group)
    least, most = np.full(n, span), np.full(n, -1)
    right_order, right_common = deep_shallow(group, right)
    left_order, left_common = deep_shallow(group, left)
    starts = run_starts(group)
    sizes = np.diff(starts)
    pair = starts[:-1][sizes == 2]
    if len(pair):  # two contexts: every distance that both common prefixes allow
        a_right, a_left = np.empty(n, np.int64), np.empty(n, np.int64)
        a_right[right_order], a_left[left_order] = right_common, left_common
        reach = np.maximum(a_right[pair], a_right[pair + 1]) + GRAM
        back = np.maximum(a_left[pair], a_left[pair + 1])
        for i in (pair, pair + 1):
            least[i] = np.maximum(low[i], span - reach)
            most[i] = np.minimum(high[i], back)
    larger = np.repeat(sizes > 2, sizes)
    if larger.any():
        chosen = np.flatnonzero(larger)  # from here on only members of groups of three or more, by their own numbers
        number, m = np.cumsum(larger) - 1, len(chosen)
        from_right, from_left = larger[right_order], larger[left_order]
        right_order, right_common = number[right_order[from_right]], right_common[from_right]
        left_order, left_common = number[left_order[from_left]], left_common[from_left]
        to_right, to_left = np.empty(m, np.int64), np.empty(m, np.int64)
        for d in range(int(low[chosen].min()), int(high[chosen].max()) + 1):
            own = np.flatnonzero((low[chosen] <= d) & (d <= high[chosen]))
            if len(own) < 2:
                continue
            here = chosen[own]
            to_right[right_order] = np.cumsum(right_common < span - d - GRAM)
            to_left[left_order] = np.cumsum(left_common < d)
            code = to_right[own] * (m + 1) + to_left[own]
            order = np.argsort(code, kind="stable")
            same = code[order][1:] == code[order][:-1]
            twice = np.zeros(len(here), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = here[twice]
            least[hit] = np.minimum(least[hit], d)
            most[hit] = d
    return least, most


def _found(digest, at: np.ndarray, least: np.ndarray, most: np.ndarray, span: int) -> pa.RecordBatch:
    some = np.flatnonzero(least <= most)
    digest = digest.take(pa.array(some))
    digest = digest.combine_chunks() if isinstance(digest, pa.ChunkedArray) else digest
    return pa.RecordBatch.from_arrays(
        [digest, pa.array((at[some] - most[some]).astype(np.int32)), pa.array((at[some] - least[some] + span).astype(np.int32))],
        ["digest", "start", "stop"])


def _sorted(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["gram"]):
        gram, at, low, high = (column(table, n).astype(np.int64) for n in ("gram", "at", "low", "high"))
        runs = run_starts(gram)
        group = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
        least, most = repeated(group, table.column("left").to_pylist(), table.column("right").to_pylist(), low, high, span)
        yield _found(table.column("digest"), at, least, most, span)


def _strings(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Every string of a context by its digest."""
    for batch in batches:
        grams, digests, at, low, high = (batch.column(n).to_pylist() for n in ("gram", "digest", "at", "low", "high"))
        for i, (a, b) in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)):
            text, gram = a[::-1], grams[i].to_bytes(8, "big", signed=True)
            rows = [(hashlib.blake2b(gram + text[high[i] - d:] + b"|" + b[: span - GRAM - d], digest_size=16, salt=d.to_bytes(2, "big")).digest(), d)
                    for d in range(low[i], high[i] + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([digests[i]] * len(rows), pa.binary()),
                 pa.array([at[i] - r[1] for r in rows], pa.int32())], ["string", "digest", "start"])


def _in_bytes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Spans over word hashes as spans of the text, from the first to the last whole word; shorter ones go."""
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            texts = batch.column("text").to_pylist()
            _, first, end, many = word_places(texts)
            text_at = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
            lists = batch.column("spans")
            row = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
            start, stop = (lists.flatten().field(n).to_numpy() for n in ("start", "stop"))
            a, b = -(-start // WORD), stop // WORD  # whole words
            keep = b - a >= words
            row, a, b = row[keep], a[keep], b[keep]
            word_at = (np.cumsum(many) - many)[row]
            fields = [pa.array((x - text_at[row]).astype(np.int32)) for x in (first[word_at + a], end[word_at + b - 1])]
            offsets = np.searchsorted(row, np.arange(len(texts) + 1))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("text"), spans], ["digest", "text", "spans"])


def repeated_spans(docs: DataFrame, stages: Stages, words: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: doc_id, digest, n_bytes (by words: without white space at the ends), long (whole copies go), wordy (of
    the least length or more) of every row; digest, copies, rep (a doc_id) of every distinct text;
    digest, text, spans (unmerged start and stop) of the texts in which something is repeated: SPAN bytes or, where words
    is given, so many words instead."""
    span = words * WORD if words else SPAN
    rows = stages.cut(docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(partial(_anchored, words=words, span=span), ANCHOR_SCHEMA)).df
    texts = stages.cut(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))).df
    own = rows.join(texts.select(F.col("digest").alias("d"), "rep"), F.expr("digest = d and doc_id <=> rep")).dropDuplicates(["digest"])
    each = stages.cut(own.select("digest", "rep", F.explode("anchors").alias("a")).select("digest", "rep", "a.*"))
    counts = stages.cut(each.df.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    crowds = counts.df.filter(F.col("n") > CROWD).select("gram")
    crowded = crowds.count()
    if crowded:
        crowds = F.broadcast(crowds) if crowded <= CROWDED_MOST else crowds
    several = counts.df.filter(F.col("n") <= CROWD).select("gram")
    shared = (each.df.join(crowds, "gram", "left_anti") if crowded else each.df).join(several, "gram", "left_semi")
    if crowded:
        shared = shared.unionByName(each.df.join(crowds, "gram", "left_semi"))
    wanted = shared.groupBy("digest", "rep").agg(F.collect_list(F.struct("gram", "at", "low", "high")).alias("anchors"))
    whole = docs.select(F.col("doc_id").cast("bigint").alias("rep"), text_bytes())
    whole = whole.withColumn("digest", F.unhex(F.sha2("text", 256)))
    found = whole.join(wanted.withColumnRenamed("rep", "r"), (whole.digest == wanted.digest) & whole.rep.eqNullSafe(F.col("r"))).select(
        whole.digest, "text", "anchors")
    texts_wanted = stages.cut(found)
    each.drop()
    contexts = texts_wanted.df.mapInArrow(partial(_contexts, words=words, span=span), CONTEXT_SCHEMA)
    few = contexts.join(crowds, "gram", "left_anti") if crowded else contexts
    spans = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(partial(_sorted, span=span), FOUND_SCHEMA)
    if crowded:
        strings = stages.cut(contexts.join(crowds, "gram", "left_semi").mapInArrow(partial(_strings, span=span), "string binary, digest binary, start int")).df
        twice = stages.cut(strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1")).df
        hot = twice.filter(F.col("n") > CROWD).select("string")  # fewer than strings / CROWD
        many = hot.count()
        hot = F.broadcast(hot) if many <= CROWDED_MOST else hot
        few = twice.filter(F.col("n") <= CROWD).select("string")
        again = (strings.join(hot, "string", "left_anti") if many else strings).join(few, "string", "left_semi")
        if many:
            again = again.unionByName(strings.join(hot, "string", "left_semi"))
        spans = spans.unionByName(again.select("digest", "start", (F.col("start") + span).alias("stop")))
    per_text = stages.cut(spans.groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    found = texts_wanted.df.select("digest", "text").join(per_text.df, "digest")
    cut = stages.cut(found.mapInArrow(partial(_in_bytes, words=words), CUT_SCHEMA) if words else found).df
    texts_wanted.drop()
    per_text.drop()
    return rows.select("doc_id", "digest", "n_bytes", "long", "wordy"), texts, cut


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = merged(spans)
            kept = without(text, spans)
            out.append((len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        removed, n, sha, kept = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            ["digest", "n_removed", "n_spans", "kept_sha256", "kept"])


REMOVED_SCHEMA = "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _per_row(rows: DataFrame, texts: DataFrame, removed: DataFrame) -> DataFrame:
    """Every row with what became of it: whole copies of SPAN bytes (or the words) or more go, others lose their spans."""
    gone = (F.col("copies") > 1) & F.col("long")
    removed = removed.dropDuplicates(["digest"])  # repeated rows have given theirs twice
    joined = rows.join(texts.select("digest", "copies"), "digest").join(removed, "digest", "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({
        "gone": gone,
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)),
        "n_spans": F.when(gone, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)),
        "kept_sha256": F.when(gone, F.lit(EMPTY.hex())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))),
    })


def repeat_report(docs: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. With words also n_passage and n_passages: bytes and
    number of the passages of so many words or more that start elsewhere too, each from its first to its last word."""
    stages = Stages(docs.sparkSession, "suffix")
    rows, texts, cut = repeated_spans(docs, stages)
    removed = cut.mapInArrow(_removed, REMOVED_SCHEMA).drop("kept")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    report = _per_row(rows, texts, removed)
    if not words:
        return report.select(*columns)
    by_bytes = stages.cut(report.select("digest", *columns))
    stages.only(by_bytes)
    rows, _, cut = repeated_spans(docs, stages, words)
    # Equal texts are one: their copies are passages from end to end where they have the words.
    one = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("whole"), F.max("wordy").alias("wordy"))
    found = cut.mapInArrow(_removed, REMOVED_SCHEMA).dropDuplicates(["digest"]).select("digest", "n_removed", "n_spans")
    one = one.join(found, "digest", "left")
    copy, zero = (F.col("copies") > 1) & F.col("wordy"), F.lit(0).cast("bigint")
    per_text = stages.cut(one.select(
        "digest", F.when(copy, F.col("whole")).otherwise(F.coalesce("n_removed", zero)).alias("n_passage"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_passages")))
    stages.only(by_bytes, per_text)
    return by_bytes.df.join(per_text.df, "digest").select(*columns, "n_passage", "n_passages")


def remove_repeats(docs: DataFrame, words: int | None = None) -> DataFrame:
    """The documents with what is repeated, SPAN bytes or (where given) so many words, cut from their texts; a document of
    which nothing is left goes, one that was empty before stays. n_chars, where it is a column, follows the text. Halves of a character at a cut go too."""
    stages = Stages(docs.sparkSession, "suffix")
    rows, texts, cut = repeated_spans(docs, stages)
    if words:
        rows, texts, by_words = repeated_spans(docs, stages, words)
        both = cut.unionByName(by_words).groupBy("digest")
        cut = both.agg(F.first("text").alias("text"), F.flatten(F.collect_list("spans")).alias("spans"))
    removed = stages.cut(cut.mapInArrow(_removed, REMOVED_SCHEMA)).df
    known = _per_row(rows.dropDuplicates(["digest"]), texts, removed).filter("n_removed > 0").select("digest", "gone", "kept")
    source = wrapped(docs).withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)))
    joined = source.join(known, "digest", "left").filter("gone is null or (not gone and length(kept) > 0)")
    whole = F.replace(F.expr("make_valid_utf8(cast(kept as string))"), F.lit("\uFFFD"), F.lit(""))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(whole)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("bigint"))
    return unwrapped(joined, docs.columns, changed)
