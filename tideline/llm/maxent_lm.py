"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

p(token | before) = p(class | before) * p(token | class). The classes cut the training tokens, ordered by their first two
bytes, into CLASSES pieces of about equal mass; the end of a text is a class of its own. The first factor is log-linear
in hashed features of the tokens before: unigram (bias), bigram, trigram, a skip over one word, and the classes of the
last three words (the second and third are skips). The second is log-linear in one feature per token, for which the
add-one-smoothed maximum has a closed form; each class keeps one slot for tokens that training did not have.

1. Texts become blocks: one row with the distinct words of some BATCH bytes of text and the tokens as numbers of them.
2. Counts of every word over all training texts come back to each block that has the word, so no task and no broadcast
   holds the vocabulary.
3. In each of ROUNDS rounds every task starts from the shared weights, makes AdaGrad steps over its own training texts of
   that round and hands on the change per feature, weighted by how often it saw the feature; the changes are summed in
   two levels. A training text is used in one round. Weights are as large as FEATURES and CLASSES say.
4. Blocks are scored in numpy batches.

Null counts as empty. A null doc_id counts as the empty text where the fold is drawn. Repeated rows count each. Without
training texts every token is new and the model is uniform.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Stages, ranges, slices, text_bytes

CLASSES, FEATURES, ROUNDS = 63, 1 << 15, 2  # with the end 64 classes; all rows fit 16 bits
BATCH, STEP, RATE = 1 << 23, 4096, 0.3
FOLDS, HELD = 7, 2

#: Rows of the weight table: hashed features, then the classes of the last three words, then the bias.
HASHED = 3
ROWS = FEATURES + 3 * (CLASSES + 1) + 1
CHUNK, SALTS = 2048, 16

BLOCK_SCHEMA = ("block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, codes binary, words array<binary>, "
                "train array<bigint>, leads array<int>, lead_counts array<bigint>")
SCORE_SCHEMA = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def is_held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary array, and start and length of each value."""
    if not len(words):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _leads(words: pa.Array) -> np.ndarray:
    """The first two bytes of each word as a number."""
    data, start, length = word_bytes(words)
    if not len(start):
        return np.empty(0, np.int32)
    second = np.where(length > 1, data[np.minimum(start + 1, len(data) - 1)], 0)
    return (data[start].astype(np.int32) << 8) | second


def _prints(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    data, start, length = word_bytes(words)
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(length.max()), np.uint64(0x100000001B3))))
        inside = data[start[0]: start[-1] + length[-1]].astype(np.uint64) + np.uint64(1)
        return np.add.reduceat(inside * powers[ranges(np.zeros(len(start)), length)], start - start[0])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 24
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").cast(pa.string())))
            flat = split.flatten()
            real = pc.greater(pc.binary_length(flat), 0)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(split)))
            lengths = np.bincount(row[np.asarray(real)], minlength=batch.num_rows)
            coded = flat.filter(real).cast(pa.binary()).dictionary_encode()
            codes, words = coded.indices.to_numpy(), coded.dictionary
            ids = batch.column("doc_id").to_pylist()
            held = np.array([is_held(i) for i in ids], bool)
            train = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(words))
            leads = np.bincount(_leads(words.cast(pa.binary())), weights=train).astype(np.int64) if len(words) else np.empty(0, np.int64)
            some = np.flatnonzero(leads)

            def one(values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            yield pa.RecordBatch.from_arrays([
                pa.array([block]), one(pa.array(ids, pa.int64())), one(pa.array(held)), one(pa.array(lengths)),
                pa.array([codes.astype("<i4").tobytes()], pa.binary()), one(words.cast(pa.binary())), one(pa.array(train)),
                one(pa.array(some.astype(np.int32))), one(pa.array(leads[some]))],
                ["block", "doc_ids", "held", "lengths", "codes", "words", "train", "leads", "lead_counts"])
            block += 1


def class_of_leads(leads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of every two leading bytes: pieces of about equal mass in byte order."""
    mass = np.zeros(1 << 16, np.float64)
    mass[leads] = counts
    middle = np.cumsum(mass) - mass / 2
    return np.minimum(CLASSES - 1, middle / max(1.0, mass.sum()) * CLASSES).astype(np.int64)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class Tokens:
    """The tokens of some texts of a block, ends included, with their classes and feature rows."""

    def __init__(self, block: dict, classes: np.ndarray, chosen: np.ndarray):
        lengths = block["lengths"]
        first = np.cumsum(lengths) - lengths
        words = block["codes"][ranges(first[chosen], lengths[chosen])]
        self.sizes = lengths[chosen] + 1
        ends = np.cumsum(self.sizes)
        n = int(ends[-1]) if len(ends) else 0
        self.word = np.full(n, -1, np.int64)  # -1: the end
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        self.word[inside] = words
        self.place = ranges(np.zeros(len(self.sizes)), self.sizes)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        of_word = classes[block["leads"]]
        self.target = np.where(self.word < 0, CLASSES, of_word[self.word] if len(of_word) else CLASSES)
        prints = np.append(block["prints"], np.uint64(0))
        begin = np.uint64(0xABCDEF)

        def back(k: int, values: np.ndarray, start) -> np.ndarray:
            out = np.full(n, start, values.dtype)
            out[k:] = np.where(self.place[k:] >= k, values[:-k] if k else values, start)
            return out

        print_of = prints[self.word]
        one, two = back(1, print_of, begin), back(2, print_of, begin)
        rows = [_mix(one, 1), _mix(_mix(two, 2) ^ one, 3), _mix(two, 4)]
        rows = [(r % np.uint64(FEATURES)).astype(np.int64) for r in rows]
        for k in (1, 2, 3):  # beyond the start: like after an end
            rows.append(FEATURES + (k - 1) * (CLASSES + 1) + back(k, self.target, CLASSES))
        self.rows = np.stack(rows).astype(np.uint16)  # without the bias, which every token has


def read_block(batch: pa.RecordBatch, i: int) -> dict:
    words = batch.column("words")[i].values
    return {
        "lengths": batch.column("lengths")[i].values.to_numpy().astype(np.int64),
        "held": batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool),
        "codes": np.frombuffer(batch.column("codes")[i].as_py(), "<i4"),
        "leads": _leads(words),
        "prints": _prints(words),
    }


def logits(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the classes less their greatest, exp of them, and the sums of those, one row per token. The last row of
    the weights is the bias."""
    z = np.take(weights, rows[0], axis=0, mode="clip")
    z += weights[-1]
    part = np.empty_like(z)
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=part, mode="clip")
        z += part
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=part)
    return z, part, part @ np.ones(part.shape[1], part.dtype)


def log_odds(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | features) of each token."""
    z, _, total = logits(weights, rows)
    return z[np.arange(len(target)), target] - np.log(total)


def learn(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, tokens: Tokens) -> None:
    """AdaGrad steps over the tokens, in place; squares and seen are per feature row."""
    for a in range(0, len(tokens.target), STEP):
        rows, target = tokens.rows[:, a: a + STEP], tokens.target[a: a + STEP]
        _, gradient, total = logits(weights, rows)
        gradient *= (-1.0 / total)[:, None]
        gradient[np.arange(len(target)), target] += 1.0
        ordered = np.empty_like(gradient)
        for r in rows:
            order = np.argsort(r, kind="stable")  # 16 bits: by radix
            r = r[order]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            touched, times = r[first], np.diff(np.append(first, len(r)))
            np.take(gradient, order, axis=0, out=ordered, mode="clip")
            step(weights, squares, seen, touched, run_sums(ordered, first, times), times)
        step(weights, squares, seen, np.array([ROWS - 1]), gradient.sum(axis=0, keepdims=True), len(target))


def run_sums(x: np.ndarray, first: np.ndarray, lengths: np.ndarray, few: int = 256, long: int = 16) -> np.ndarray:
    """Sums of the runs of rows of x, which is spent. numpy walks short runs value by value; here all of them are halved
    together, whole rows at a time. Long runs, and a few runs, are summed as they are."""
    if len(first) <= few:
        return np.add.reduceat(x, first, axis=0)
    far = np.flatnonzero(lengths > long)
    sums = [x[a:b].sum(axis=0) for a, b in zip(first[far].tolist(), (first + lengths)[far].tolist(), strict=True)]
    some = (lengths > 1) & (lengths <= long)
    start, left = first[some], lengths[some]
    while len(start):
        half = left >> 1
        into = ranges(start, half)
        left = left - half
        x[into] += x[into + np.repeat(left, half)]
        start, left = start[left > 1], left[left > 1]
    out = x[first]
    if sums:
        out[far] = sums
    return out


def step(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, touched: np.ndarray, change: np.ndarray, times) -> None:
    size = squares[touched] + np.einsum("ij,ij->i", change, change) / np.float32(change.shape[1])
    squares[touched] = size
    seen[touched] += times
    change *= (np.float32(RATE) / np.sqrt(size + np.float32(1e-6)))[:, None]
    weights[touched] += change


def _round(shared, classes, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        weights, squares, seen = start.copy(), np.full(ROWS, 1.0, np.float32), np.zeros(ROWS, np.float32)
        for batch in batches:
            for i in range(batch.num_rows):
                block = read_block(batch, i)
                mine = np.arange(len(block["held"])) % ROUNDS == number
                learn(weights, squares, seen, Tokens(block, classes.value, np.flatnonzero(~block["held"] & mine)))
        change = (weights - start) * seen[:, None]
        salt = TaskContext.get().partitionId() % SALTS
        for a in range(0, ROWS, CHUNK):
            if seen[a: a + CHUNK].any():
                yield _sums(a // CHUNK, salt, change[a: a + CHUNK], seen[a: a + CHUNK])

    return run


SUM_SCHEMA = "chunk int, salt int, change binary, seen binary"


def _sums(chunk: int, salt: int, change: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([change.astype("<f4").tobytes()], pa.binary()),
         pa.array([seen.astype("<f4").tobytes()], pa.binary())], ["chunk", "salt", "change", "seen"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum per chunk of whatever arrives; holds one table of weights at most."""
    totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = batch.column("chunk")[i].as_py()
            change, seen = (np.frombuffer(batch.column(c)[i].as_py(), "<f4") for c in ("change", "seen"))
            if chunk in totals:
                totals[chunk][0][:] += change
                totals[chunk][1][:] += seen
            else:
                totals[chunk] = (change.copy(), seen.copy())
    for chunk, (change, seen) in totals.items():
        yield _sums(chunk, 0, change, seen)


def train(stages: Stages, blocks: DataFrame, classes, mass: np.ndarray) -> np.ndarray:
    """The weight table after ROUNDS rounds; the bias starts at the frequencies of the classes."""
    context = blocks.sparkSession.sparkContext
    weights = np.zeros((ROWS, CLASSES + 1), np.float32)
    weights[-1] = np.log((mass + 1.0) / (mass.sum() + len(mass)))
    for number in range(ROUNDS):
        changes = blocks.select("lengths", "held", "codes", "words").mapInArrow(
            _round(context.broadcast(weights), classes, number), SUM_SCHEMA)
        summed = changes.repartition("chunk", "salt").mapInArrow(_added, SUM_SCHEMA)
        total = stages.cut(summed.repartition("chunk").mapInArrow(_added, SUM_SCHEMA))
        for row in total.df.collect():  # ROWS / CHUNK rows
            a = row["chunk"] * CHUNK
            seen = np.frombuffer(row["seen"], "<f4")
            change = np.frombuffer(row["change"], "<f4").reshape(len(seen), -1)
            weights[a: a + len(seen)] += change / np.maximum(seen, 1.0)[:, None]
        total.drop()
    return weights


def _scored(weights, classes, totals: dict):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: one block; right: at, count of its words."""
        batch = left.combine_chunks().to_batches()[0]
        block = read_block(batch, 0)
        counts = np.zeros(len(block["leads"]) + 1, np.int64)
        counts[right.column("at").to_numpy()] = right.column("count").to_numpy()
        counts[-1] = totals["texts"]
        many = len(block["lengths"])
        tokens = Tokens(block, classes.value, np.arange(many))
        logs = np.empty(len(tokens.target))
        for a in range(0, len(logs), STEP):
            target = tokens.target[a: a + STEP]
            logs[a: a + STEP] = log_odds(weights.value, tokens.rows[:, a: a + STEP], target)
        count = counts[tokens.word]
        inside = np.log((count + 1.0) / (totals["mass"] + totals["types"] + 1.0)[tokens.target])
        inside[tokens.word < 0] = 0.0
        base = np.log10((count + 1.0) / (totals["n"] + totals["v"] + 1.0))

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(tokens.text, weights=values, minlength=many)

        return pa.table({
            "doc_id": batch.column("doc_ids")[0].values, "held_out": batch.column("held")[0].values, "n_tokens": pa.array(tokens.sizes),
            "n_known": pa.array(per_text(count > 0).astype(np.int64)), "train_tokens": pa.array(np.full(many, totals["n"])),
            "base_score": pa.array(per_text(base)), "score": pa.array(per_text((logs + inside) / np.log(10.0)))})

    return run


def model_scores(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    stages = stages or Stages(spark, "lm")
    blocks = stages.cut(docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(_blocks, BLOCK_SCHEMA)).df

    leads = blocks.select(F.explode(F.arrays_zip("leads", "lead_counts")).alias("x")).groupBy("x.leads").agg(
        F.sum("x.lead_counts").alias("n")).collect()  # at most 65,536 rows
    of_lead = class_of_leads(np.array([r["leads"] for r in leads], np.int64), np.array([r["n"] for r in leads], np.float64))
    classes = spark.sparkContext.broadcast(of_lead)

    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("at", "x")).select(
        "block", "at", F.col("x.words").alias("word"), F.col("x.train").alias("n"))
    same = Window.partitionBy("word")
    counted = stages.cut(each.select(
        "block", "at", "n", F.sum("n").over(same).alias("count"),
        (F.col("block") == F.min("block").over(same)).alias("first"),
        F.conv(F.hex(F.rpad(F.substring("word", 1, 2), 2, b"\0")), 16, 10).cast("int").alias("lead"))).df
    by_lead = counted.groupBy("lead").agg(
        F.sum("n").alias("mass"), F.count_if(F.col("first") & (F.col("count") > 0)).alias("types")).collect()  # at most 65,536 rows
    mass, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in by_lead:
        mass[of_lead[r["lead"]]] += r["mass"]
        types[of_lead[r["lead"]]] += r["types"]
    texts = int(blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0)
    totals = {"texts": texts, "n": int(mass.sum()) + texts, "v": int(types.sum()) + (texts > 0), "mass": mass, "types": types}

    weights = spark.sparkContext.broadcast(train(stages, blocks, classes, np.append(mass[:-1], texts)))  # ROWS x 64 floats
    asked = blocks.select("block", "doc_ids", "held", "lengths", "codes", "words").groupBy("block")
    return asked.cogroup(counted.select("block", "at", "count").groupBy("block")).applyInArrow(_scored(weights, classes, totals), SCORE_SCHEMA)
