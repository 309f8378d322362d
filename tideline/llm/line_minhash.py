"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find; one line per component stays.

1. Lines (split at line feeds) are hashed where they are read; a line's signature has BANDS x DEPTH minima over its
   WIDTH-character shingles. At similarity LIKE = 0.8 a pair meets in some band with probability 1 - (1 - 0.8^5)^16 = 0.998.
   Equal lines become one node, with one of their places (doc_id, text mark, line number) to read its text from.
2. In each band bucket the nodes are paired with one of them, and the pairs' exact Jaccard similarity is taken.
   This joins most groups at linear cost, however large they are.
3. Buckets whose other nodes are still of several components are searched whole, so no link that banding offers is lost. In those of
   up to PAIRED nodes the pairs of different components are listed, and each distinct pair is checked once. In larger ones: shingles in
   hash order, an index of prefixes (two sets this alike share one of the first shingles), exact similarity for what meets.
   Buckets of more than CROWD nodes are dealt again by prefix shingle.
4. Components of all links; the line with the smallest place of each component stays, other lines go.

Only texts of lines in some shared bucket are gathered. Lines of fewer than LEAST characters without the white space around
them (blank lines) are left alone. Null counts as empty. Rows with the same doc_id and text are treated alike; null doc_ids come first.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stages, column, ranges, run_starts, slices, small_batches, text_bytes, unwrapped, whole_groups, wrapped
from tideline.llm.components import components

WIDTH, BANDS, DEPTH, LIKE, LEAST = 6, 16, 5, 0.8, 1
PAIRED, CROWD = 128, 20_000
BATCH, CACHED, PAIR_BATCH = 1 << 21, 1 << 16, 1 << 19
#: Nodes of one bucket that are held until all are seen; band keys of a part, and those dealt to the parts at once.
HELD, PART, DEALT = 1 << 20, 1 << 17, 1 << 19

LINE_SCHEMA = "doc_id bigint, mark bigint, line int, digest binary, bands binary"
_MULTIPLIERS = (np.random.default_rng(7).integers(1, 2**31, BANDS * DEPTH).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat 64-bit hashes of the shingles of each line, and how many each has; a short line is one shingle."""
    padded = [x.ljust(WIDTH, "\0") for x in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points.astype(np.uint64), lengths
    hashes = np.empty(len(points) - WIDTH + 1, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), CACHED // 4):  # parts that stay in the processor's cache
            part = points[a: a + CACHED // 4 + WIDTH - 1].astype(np.uint64)
            n = len(part) - WIDTH + 1
            h = part[:n] + np.uint64(1)
            for j in range(1, WIDTH):
                h *= np.uint64(0x100000001B3)
                h += part[j: j + n]
            hashes[a: a + n] = _mixed(h)
    inside = np.ones(len(hashes), bool)  # not across two lines
    ends = np.cumsum(lengths)[:-1]
    for j in range(1, WIDTH):
        inside[ends - j] = False
    return hashes[inside], lengths - WIDTH + 1


def bands(lines: list[str]) -> np.ndarray:
    """Band keys, one row per line."""
    out = np.empty((len(lines), BANDS), np.int64)
    if not lines:
        return out
    hashes, count = shingle_hashes(lines)
    ends = np.cumsum(count)
    part = (ends - count) // CACHED
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lines)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # parts that stay in the processor's cache
        begin = ends[a] - count[a]
        h, start = (hashes[begin: ends[b - 1]] >> np.uint64(32)).astype(np.uint32), ends[a:b] - count[a:b] - begin
        buffer, least = np.empty_like(h), np.empty((BANDS * DEPTH, b - a), np.uint32)
        for k in range(BANDS * DEPTH):
            np.multiply(h, _MULTIPLIERS[k], out=buffer)
            np.minimum.reduceat(buffer, start, out=least[k])
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], b - a, axis=1)
        with np.errstate(over="ignore"):
            for k in range(DEPTH):
                key = _mixed(key * np.uint64(0x2545F4914F6CDD1D) + least[k::DEPTH])
        out[a:b] = key.view(np.int64).T
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            texts = batch.column("text").to_pylist()
            split = [t.decode("utf-8").split("\n") for t in texts]
            count = np.fromiter(map(len, split), np.int64, len(split))
            flat = [x for lines in split for x in lines]
            eligible = np.flatnonzero(np.fromiter((len(x.strip()) >= LEAST for x in flat), bool, len(flat)))
            row = np.repeat(np.arange(len(texts)), count)[eligible]
            number = ranges(np.zeros(len(count)), count)[eligible]
            places: dict[str, int] = {}
            codes = pa.array([places.setdefault(flat[i], len(places)) for i in eligible.tolist()], pa.int64())
            distinct = [*places]
            keys = bands(distinct)
            digests = pa.array([hashlib.blake2b(x.encode("utf-8"), digest_size=16).digest() for x in distinct], pa.binary())
            marks = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)
            packed = _packed(keys, np.arange(len(distinct) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(marks[row]), pa.array(number.astype(np.int32)), digests.take(codes), packed.take(codes)],
                ["doc_id", "mark", "line", "digest", "bands"])


def _packed(rows: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of rows[at[i]: at[i + 1]] for each i."""
    offsets = (at * rows.itemsize * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(bucket, id) of every band key of the nodes, packed by the part that the bucket belongs to."""
    held: list[np.ndarray] = []

    def given() -> pa.RecordBatch:
        rows = np.concatenate(held)
        held.clear()
        part = (rows[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part)
        at = run_starts(part[order])
        return pa.RecordBatch.from_arrays([pa.array(part[order[at[:-1]]]), _packed(rows[order], at)], ["part", "rows"])

    for batch in batches:
        keys = _unpacked(batch.column("bands"), BANDS)
        held.append(np.stack([keys.ravel(), np.repeat(column(batch, "id"), BANDS)], axis=1))
        if sum(map(len, held)) >= DEALT:
            yield given()
    if sum(map(len, held)):
        yield given()


def _sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, id sorted by bucket, part by part, from packed rows sorted by part."""
    for table in whole_groups(batches, ["part"]):
        at = run_starts(column(table, "part"))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = _unpacked(table.column("rows").slice(a, b - a), 2)
            rows = rows[np.argsort(rows[:, 0])]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["bucket", "id"])


def similarity(a: set[str], b: set[str]) -> float:
    same = len(a & b)
    return same / (len(a) + len(b) - same) if a or b else 1.0


def shingles(line: str) -> set[str]:
    return {line[i: i + WIDTH] for i in range(max(1, len(line) - WIDTH + 1))}


def alike(a: set[int], b: set[int], a_text: str, b_text: str) -> bool:
    """Exact similarity of LIKE or more; sets of shingle hashes turn most pairs down before strings are compared."""
    if min(len(a), len(b)) < LIKE * max(len(a), len(b)) - 1e-9 or similarity(a, b) < LIKE:
        return False
    return similarity(shingles(a_text), shingles(b_text)) >= LIKE


def _numbered(number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sorted keys of (a number below 65,536, 48 bits of a hash)."""
    key = (number.astype(np.uint64) << np.uint64(48)) | hashes
    key.sort()
    return key


def _distinct(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat distinct 48-bit hashes of each text, and how many each has."""
    values, sizes, ends = [], [], np.append(0, np.cumsum(count))
    for a in range(0, len(count), 1 << 16):
        n = count[a: a + (1 << 16)]
        key = _numbered(np.repeat(np.arange(len(n)), n), hashes[ends[a]: ends[a + len(n)]] >> np.uint64(16))
        key = key[np.append(True, key[1:] != key[:-1])]
        values.append(key & np.uint64((1 << 48) - 1))
        sizes.append(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(n)))
    return np.concatenate(values), np.concatenate(sizes)


def alike_pairs(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether texts a[i] and b[i] have a similarity of LIKE or more.

    Shared shingle hashes are counted for many pairs in one sort. Where one more or less would change the answer, the strings decide.
    """
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    values, sizes = _distinct(*shingle_hashes(texts))
    begin = np.cumsum(sizes) - sizes
    possible = np.flatnonzero(np.minimum(sizes[a], sizes[b]) + 1 >= LIKE * np.maximum(sizes[a], sizes[b]) - 1e-9)
    for c in range(0, len(possible), 1 << 16):
        chosen = possible[c: c + (1 << 16)]
        i, j = a[chosen], b[chosen]
        n, m = sizes[i], sizes[j]
        number = np.arange(len(chosen))
        key = _numbered(np.append(np.repeat(number, n), np.repeat(number, m)), values[np.append(ranges(begin[i], n), ranges(begin[j], m))])
        same = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(chosen))
        out[chosen] = same - 1 >= LIKE * (n + m - same + 1)
        close = ~out[chosen] & (same + 1 >= LIKE * (n + m - same - 1) - 1e-9)
        for x in chosen[close].tolist():
            out[x] = similarity(shingles(texts[a[x]]), shingles(texts[b[x]])) >= LIKE
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole, "a_text", PAIR_BATCH):
            for batch in slices(part, "b_text", PAIR_BATCH):
                a_texts, b_texts = batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()
                number = {t: i for i, t in enumerate(dict.fromkeys(a_texts + b_texts))}
                at = [np.fromiter((number[t] for t in x), np.int64, len(x)) for x in (a_texts, b_texts)]
                yield batch.select(["u", "v"]).filter(pa.array(alike_pairs([*number], *at)))


def _prefix(hashes: np.ndarray) -> np.ndarray:
    """The first shingle hashes, of which two sets with a similarity of LIKE share one."""
    ordered = np.unique(hashes)
    return ordered[: len(ordered) - int(np.ceil(LIKE * len(ordered) - 1e-9)) + 1]


class Bucket:
    """The nodes of a bucket, with sets and prefixes computed when they are asked for."""

    def __init__(self, roots: list[int], texts: list[str]):
        self.roots, self.texts = roots, texts
        hashes, count = shingle_hashes(texts)
        self.parts = np.split(hashes, np.cumsum(count)[:-1])
        self.sets: dict[int, set[int]] = {}
        self.prefixes: dict[int, list[int]] = {}

    def prefix(self, i: int) -> list[int]:
        if i not in self.prefixes:
            self.prefixes[i] = _prefix(self.parts[i]).tolist()
        return self.prefixes[i]

    def alike(self, i: int, j: int) -> bool:
        for k in (i, j):
            if k not in self.sets:
                self.sets[k] = set(self.parts[k].tolist())
        return alike(self.sets[i], self.sets[j], self.texts[i], self.texts[j])

    def links(self) -> list[tuple[int, int]]:
        """Links between the components, by position.

        Nodes outside the largest component are indexed by their prefixes as they come. Nodes of the largest one only
        look for those that are not yet in it, so a bucket that soon is one component soon ends.
        """
        joined: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        index: dict[int, list[int]] = defaultdict(list)

        def root(x: int) -> int:
            while x in joined:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        def look(i: int) -> None:
            own = root(self.roots[i])
            for j in sorted({j for h in self.prefix(i) if h in index for j in index[h] if root(self.roots[j]) != own}):
                other = root(self.roots[j])
                if other != own and self.alike(i, j):
                    joined[other] = own
                    found.append((i, j))

        largest = Counter(self.roots).most_common(1)[0][0]
        few = [i for i, r in enumerate(self.roots) if r != largest]
        for i in few:
            look(i)
            for h in self.prefix(i):
                index[h].append(i)
        apart = {root(self.roots[i]) for i in few} - {root(largest)}
        for i in (i for i, r in enumerate(self.roots) if r == largest):
            if not apart:
                break
            before = len(found)
            look(i)
            if len(found) > before:
                apart = {root(x) for x in apart} - {root(largest)}
                for h in list(index):
                    index[h] = [j for j in index[h] if root(self.roots[j]) != root(largest)]
        return found


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["bucket", "part"]):
        at = run_starts(column(table, "bucket"), column(table, "part"))
        ids, roots, texts = column(table, "id"), column(table, "root"), table.column("text").to_pylist()
        pairs = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            pairs += [(ids[a + i], ids[a + j]) for i, j in Bucket(roots[a:b].tolist(), texts[a:b]).links()]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A crowded bucket's nodes once per prefix shingle."""
    for batch in batches:
        hashes, count = shingle_hashes(batch.column("text").to_pylist())
        ends = np.cumsum(count)
        parts = [_prefix(hashes[e - n: e]).view(np.int64) for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
        row = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket").take(row), pa.array(np.concatenate([np.empty(0, np.int64), *parts])), batch.column("id").take(row),
             batch.column("root").take(row), batch.column("text").take(row)], ["bucket", "part", "id", "root", "text"])


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows have more than one root, with the number of rows."""
    return rows.groupBy(*keys).agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter(
        "least <> most").select(*keys, "n")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, id and the bucket's least id for buckets of two nodes or more, from rows sorted by bucket.

    Of a bucket of more than HELD nodes, the least of those that were held first stands for the least.
    """
    bucket, ids, gone = np.empty(0, np.int64), np.empty(0, np.int64), (None, 0)  # gone: a bucket of which rows were given, and its least id

    def given(stop: int) -> pa.RecordBatch:
        nonlocal bucket, ids, gone
        at = run_starts(bucket[:stop])
        least, sizes = np.minimum.reduceat(ids[:stop], at[:-1]), np.diff(at)
        many = sizes > 1
        if bucket[0] == gone[0]:
            least[0], many[0] = gone[1], True
        gone, take = (bucket[stop - 1], least[-1]), np.repeat(many, sizes)
        out = [pa.array(x[take]) for x in (bucket[:stop], ids[:stop], np.repeat(least, sizes))]
        bucket, ids = bucket[stop:], ids[stop:]
        return pa.RecordBatch.from_arrays(out, ["bucket", "id", "least"])

    for batch in batches:
        bucket, ids = np.append(bucket, column(batch, "bucket")), np.append(ids, column(batch, "id"))
        if len(bucket):
            last = int(run_starts(bucket)[-2])
            if last or len(bucket) > HELD:
                yield given(last if len(bucket) - last <= HELD else len(bucket))
    if len(bucket):
        yield given(len(bucket))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket's nodes that are of different components, from rows sorted by bucket."""
    for table in whole_groups(batches, ["bucket"]):
        bucket, ids, root = (column(table, c) for c in ("bucket", "id", "root"))
        order = np.lexsort((root, bucket))
        bucket, ids, root = bucket[order], ids[order], root[order]
        at, own = run_starts(bucket), run_starts(bucket, root)
        after = np.repeat(own[1:], np.diff(own))  # the next component of the bucket begins here
        count = np.repeat(at[1:], np.diff(at)) - after
        u, v = np.repeat(ids, count), ids[ranges(after, count)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = text.split(b"\n")
            ids += [w["id"] for w in wanted]
            texts += [lines[w["line"]].decode("utf-8") for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def _marked(docs: DataFrame) -> DataFrame:
    """docs with the mark of the text, as in the line table."""
    return docs.withColumn("own_mark", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def _same_text(left: DataFrame, right: DataFrame) -> Column:
    return (left.own_mark == right.mark) & left.doc_id.cast("bigint").eqNullSafe(right.of_doc)


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose texts are alike."""
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a_text")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("text").alias("b_text")), "v")
    return both.select("u", "v", "a_text", "b_text").mapInArrow(_alike, "u bigint, v bigint")


def _crowded(held: DataFrame) -> DataFrame:
    """Links of buckets of many nodes (bucket, id, root, n, text)."""
    once = held.filter(F.col("n") <= CROWD).select("bucket", F.lit(0).cast("bigint").alias("part"), "id", "root", "text")
    schema = "bucket bigint, part bigint, id bigint, root bigint, text string"
    dealt = held.filter(F.col("n") > CROWD).select("bucket", "id", "root", "text").mapInArrow(_prefixes, schema)
    once = once.unionByName(dealt.join(_several(dealt.drop("text"), ["bucket", "part"]).drop("n"), ["bucket", "part"]))
    return once.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_searched, "u bigint, v bigint")


def dropped_lines(docs: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, mark (of the text), line of every line that does not stay."""
    source = docs.select(F.col("doc_id").cast("bigint"), text_bytes())
    hashed = stages.cut(source.mapInArrow(_lines, LINE_SCHEMA))
    nodes = stages.cut(hashed.df.groupBy("digest").agg(
        F.any_value(F.struct("doc_id", "mark", "line")).alias("place"), F.any_value("bands").alias("bands"), F.count("*").alias("n")).select(
        "digest", "place.*", "bands", "n", F.monotonically_increasing_id().alias("id"))).df
    lines = stages.cut(hashed.df.select("doc_id", "mark", "line", "digest")).df
    hashed.drop()

    parts = nodes.count() * BANDS // PART + 1
    spread = nodes.select("id", "bands").mapInArrow(lambda batches: _dealt(batches, parts), "part bigint, rows binary")
    members = stages.cut(spread.repartition("part").sortWithinPartitions("part").mapInArrow(
        lambda batches: _members(_sorted_parts(batches)), "bucket bigint, id bigint, least bigint")).df

    wanted = nodes.join(members.select("id").distinct(), "id").groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("id", "line")).alias("wanted")).withColumnRenamed("doc_id", "of_doc")
    marked = _marked(source)
    texts = stages.cut(marked.join(wanted, _same_text(marked, wanted)).select("text", "wanted").mapInArrow(
        _picked, "id bigint, text string").dropDuplicates(["id"])).df

    pairs = members.filter("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v")).distinct()
    united = components(stages, stages.cut(_checked(pairs, texts)).df).df

    # Pairs with the node that stands for a bucket are done, so that node takes no part.
    rooted = members.filter("id <> least").select("bucket", "id").join(united.withColumnRenamed("u", "id"), "id", "left").select(
        "bucket", "id", F.coalesce("v", "id").alias("root"))
    rooted = stages.cut(rooted).df
    open_buckets = stages.cut(_several(rooted, ["bucket"])).df
    held, most = rooted.join(open_buckets, "bucket"), min(PAIRED, CROWD)
    crossing = held.filter(F.col("n") <= most).select("bucket", "id", "root").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _crossing, "u bigint, v bigint").distinct()
    more = _checked(crossing, texts)
    if not open_buckets.filter(F.col("n") > most).isEmpty():
        more = more.unionByName(_crowded(held.filter(F.col("n") > most).join(texts, "id")))
    more = stages.cut(more).df
    if not more.isEmpty():
        united = components(stages, united.unionByName(more)).df

    named = united.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        united.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    several = nodes.select("digest", "id", "n").join(named, "id", "left").filter("n > 1 or component is not null").select(
        "digest", F.coalesce("component", "id").alias("component"))
    place = F.struct("doc_id", "mark", "line")
    placed = stages.cut(lines.join(several, "digest").drop("digest")).df
    first = placed.groupBy("component").agg(F.min(place).alias("first"))
    return placed.join(first, "component").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "mark", "line")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            text, dropped = batch.column("text"), batch.column("dropped")
            changed = np.asarray(dropped.is_valid())
            new = []
            for lines, gone in zip(text.filter(pa.array(changed)).to_pylist(), dropped.filter(pa.array(changed)).to_pylist(), strict=True):
                gone = set(gone)
                new.append("\n".join(x for i, x in enumerate((lines or "").split("\n")) if i not in gone))
            if new:
                text = pc.replace_with_mask(text, pa.array(changed), pa.array(new, text.type))
            count = pc.add(pc.fill_null(pc.count_substring(batch.column("text"), "\n"), 0).cast(pa.int64()), 1)
            columns = {"text": text, "n_lines": count}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)


def cut_lines(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """docs (doc_id, text and others) with the lines that do not stay cut from text, and n_lines, n_removed added."""
    stages = stages or Stages(docs.sparkSession, "lines")
    small_batches(docs.sparkSession)
    dropped = stages.cut(dropped_lines(docs, stages).groupBy("doc_id", "mark").agg(F.collect_set("line").alias("dropped"))
                         .withColumnRenamed("doc_id", "of_doc")).df
    marked = _marked(docs)
    joined = marked.join(dropped, _same_text(marked, dropped), "left").select(
        *(marked[c] for c in docs.columns), "dropped", F.lit(0).cast("bigint").alias("n_lines"),  # counted with the cut
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_removed"))
    return joined.mapInArrow(_without, joined.schema).drop("dropped")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the remaining text, for every row of docs."""
    return cut_lines(docs.select(F.col("doc_id").cast("bigint"), "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that do not stay; a document that loses all it had goes. n_chars, where it is a
    column, follows a text that changed."""
    out = cut_lines(wrapped(docs)).filter("n_removed = 0 or length(trim(text)) > 0")
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return unwrapped(out, docs.columns, changed)
