"""Language of texts by a linear-chain conditional random field over words.

Each word of a chain has a language as its label. What stands between white space is a word; if it is longer than LONGEST
characters (scripts without blanks), each LONGEST characters of it are a word of their own. A word's features are the word itself, its prefixes and suffixes, its
character n-grams and the block of its code points, hashed to FEATURES rows of weights, and the lexicon: the share of each language among
the sampled training texts that hold the word. Transitions between neighbours are learned with them. Training chains
splice pieces of texts of different languages, so that code-switching is seen. Forward-backward gives each word's
distribution, and a text's language is the one with the largest sum over its words; the score is that sum's share.

The field is fitted in numpy on a bounded sample: per language the SAMPLE labelled texts that come first by a hash of
doc_id and text; of texts over SAMPLE_BYTES bytes each piece of that size counts as a text. Every text is then labelled whole, in chains of up to CHAIN words; a word's features are
computed once per batch. Labels are whatever non-null values the training rows have, in sorted order.

A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned. A null doc_id
counts as the empty text where the fold is drawn. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import ranges, slices, small_batches, text_bytes

FOLDS, HELD = 3, 1
FEATURES = 1 << 17
SAMPLE, SAMPLE_BYTES = 400, 20_000
CHAIN, EPOCHS, RATE = 64, 4, 0.3
AFFIX, LONGEST = 4, 40
BATCH = 1 << 22
UNKNOWN = "und"

OUT_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def is_held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _hashed(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(FEATURES)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature rows of the words, one word after the other, and how many each has.

    Of a word in lower case between two marks: all of it, the block of code points its first character is in, prefixes and
    suffixes of one to AFFIX characters, and all pairs and triples of neighbouring characters.
    """
    marked = [f"<{w.lower()}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(lengths) - lengths
    base = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        place = ranges(np.zeros(len(words)), lengths)
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(lengths.max(initial=1)), base)))
        fixed = [_hashed(np.add.reduceat(points * powers[place], start), 1), _hashed(points[start + 1] >> np.uint64(7), 2)]
        head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for k in range(1, AFFIX + 1):
            inside = k < lengths - 1
            head = np.where(inside, head * base + points[np.minimum(start + k, len(points) - 1)], head)
            tail = np.where(inside, tail * base + points[np.maximum(start + lengths - 1 - k, 0)], tail)
            fixed += [_hashed(head, 10 + k), _hashed(tail, 20 + k)]
        pairs = points[:-1] * base + points[1:]
        triples = pairs[:-1] * base + points[2:]
    grams = [(2, _hashed(pairs, 30)), (3, _hashed(triples, 31))]
    counts = len(fixed) + sum(np.maximum(0, lengths - n + 1) for n, _ in grams)
    rows, at = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
    for i, values in enumerate(fixed):
        rows[at + i] = values
    at = at + len(fixed)
    for n, values in grams:
        many = np.maximum(0, lengths - n + 1)
        rows[ranges(at, many)] = values[ranges(start, many)]
        at = at + many
    return rows, counts


def _cut(word: str) -> list[str]:
    """A word in consecutive parts of up to LONGEST characters."""
    return [word[a: a + LONGEST] for a in range(0, len(word), LONGEST)]


def _words(text: str) -> list[str]:
    return [part for w in text.split() for part in _cut(w)]


class Field:
    """Weights of the field: features x labels, transitions, the lexicon with its weight, and the starting scores."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((FEATURES, k), np.float32)
        self.moves = np.zeros((k, k))
        self.first = np.zeros(k)
        self.lexicon: dict[str, np.ndarray] = {}
        self.trust = np.zeros(1)

    def states(self, words: list[str]) -> np.ndarray:
        """State scores of each word."""
        flat, sizes = word_features(words)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] * 8.0 + self.listed(words) * self.trust

    def listed(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for i, w in enumerate(words):
            shares = self.lexicon.get(w.lower())
            if shares is not None:
                out[i] = shares
        return out


def marginals(states: np.ndarray, moves: np.ndarray, first: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    states: steps x chains x labels; mask: steps x chains, true where a chain has a word (chains are filled from step 0).
    Returns the word distributions, and the sums over all neighbours of their joint distributions.
    """
    steps, chains, k = states.shape
    e = np.exp(states - states.max(axis=2, keepdims=True))
    t, forward = np.exp(moves - moves.max()), np.empty_like(e)
    a = np.exp(first - first.max()) * e[0]
    forward[0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, steps):
        a = (forward[i - 1] @ t) * e[i]
        forward[i] = a / a.sum(axis=1, keepdims=True)
    out, back, joint = np.empty_like(e), np.full((chains, k), 1.0 / k), np.zeros((k, k))
    for i in range(steps - 1, -1, -1):
        if i + 1 < steps:  # beyond a chain's end the message stays uniform
            into = e[i + 1] * back
            message = into @ t.T
            message /= message.sum(axis=1, keepdims=True)
            inside = mask[i + 1]
            pair = forward[i][inside][:, :, None] * t * into[inside][:, None, :]
            joint += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = np.where(inside[:, None], message, 1.0 / k)
        p = forward[i] * back
        out[i] = p / p.sum(axis=1, keepdims=True)
    return out, joint


def _chained(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat start and length of the chains that texts of these many words are cut into."""
    count = -(-lengths // CHAIN)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + ranges(np.zeros(len(count)), count) * CHAIN
    end = np.repeat(np.cumsum(lengths), count)
    return begin, np.minimum(CHAIN, end - begin)


def fit(samples: list[tuple[str, bytes]], seed: int = 11) -> Field:
    """The field learned from (label, text) samples by AdaGrad on the conditional likelihood."""
    labels = sorted({label for label, _ in samples})
    field, number = Field(labels), {label: i for i, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    texts = [(number[label], _words(text.decode("utf-8", "replace"))) for label, text in samples]
    texts = [(y, words) for y, words in texts if words]
    k = len(labels)
    holds: dict[str, Counter] = defaultdict(Counter)
    for y, words in texts:
        for w in {w.lower() for w in words}:
            holds[w][y] += 1
    for w, by in holds.items():
        if sum(by.values()) > 1:
            field.lexicon[w] = (np.array([by[i] for i in range(k)]) + 0.5 / k) / (sum(by.values()) + 0.5)
    pieces = [(y, words[a: a + CHAIN // 2]) for y, words in texts for a in range(0, len(words), CHAIN // 2)]
    squares, move_squares = np.full(FEATURES, 1.0, np.float32), np.ones((k, k))
    first_squares, trust_square = np.ones(k), np.ones(1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), 128):
            chosen = [pieces[i] for i in order[a: a + 128]]
            chains = [(chosen[i], chosen[i + 1] if i + 1 < len(chosen) else chosen[0]) for i in range(0, len(chosen), 2)]
            words = [w for pair in chains for _, part in pair for w in part]
            gold = np.concatenate([np.full(len(part), y) for pair in chains for y, part in pair])
            sizes = np.array([sum(len(part) for _, part in pair) for pair in chains])
            distinct, of = np.unique(np.array(words, object), return_inverse=True)
            (flat, counts), listed = word_features(list(distinct)), field.listed(list(distinct))
            per = np.add.reduceat(field.weights[flat], np.cumsum(counts) - counts, axis=0) / counts[:, None] * 8.0 + listed * field.trust
            mask = np.arange(int(sizes.max()))[:, None] < sizes
            states, spots = np.zeros((*mask.shape, k)), np.zeros(mask.shape, np.int64)
            start = np.cumsum(sizes) - sizes
            spots[mask] = (start + np.arange(mask.shape[0])[:, None])[mask]
            states[mask] = per[of[spots[mask]]]
            p, joint = marginals(states, field.moves, field.first, mask)
            miss = -p[mask]
            order_of = spots[mask]
            miss[np.arange(len(miss)), gold[order_of]] += 1.0
            error = np.zeros((len(distinct), k))
            np.add.at(error, of[order_of], miss)
            target, spread = np.unique(flat, return_inverse=True)
            share = np.repeat(error / counts[:, None] * 8.0, counts, axis=0)
            gradient = np.zeros((len(target), k))
            np.add.at(gradient, spread, share)
            squares[target] += (gradient**2).mean(axis=1)
            field.weights[target] += RATE * gradient / np.sqrt(squares[target])[:, None]
            seen = np.zeros((k, k))
            inside = np.ones(len(gold), bool)
            inside[start] = False
            at = np.flatnonzero(inside)
            np.add.at(seen, (gold[at - 1], gold[at]), 1.0)
            step = seen - joint
            move_squares += step**2
            field.moves += RATE * step / np.sqrt(move_squares)
            step = np.bincount(gold[start], minlength=k) - p[0].sum(axis=0)
            first_squares += step**2
            field.first += RATE * step / np.sqrt(first_squares)
            step = (error * listed).sum()
            trust_square += step**2
            field.trust += RATE * step / np.sqrt(trust_square)
    return field


def labelled(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best label (a number) and score of each text; -1 where a text has no letter. texts: binary, null allowed."""
    n, k = len(texts), len(field.labels)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, b"").cast(pa.string()))
    flat = split.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    owner, flat = np.repeat(np.arange(n), np.asarray(pc.list_value_length(split)))[real], flat.filter(pa.array(real))
    parts = -(-np.asarray(pc.utf8_length(flat)) // LONGEST)
    if (parts > 1).any():
        owner, flat = np.repeat(owner, parts), pa.array([part for w in flat.to_pylist() for part in _cut(w)], pa.string())
    lengths = np.bincount(owner, minlength=n)
    coded = flat.dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    letters = np.fromiter((any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
    best, score = np.full(n, -1), np.zeros(n)
    if not len(codes) or not k or not letters.any():
        return best, score
    states = np.concatenate([field.states(distinct[a: a + 20_000]) for a in range(0, len(distinct), 20_000)])
    begin, size = _chained(lengths)
    votes = np.zeros((len(codes), k))
    for a in range(0, len(begin), 4096):
        b, s = begin[a: a + 4096], size[a: a + 4096]
        mask = np.arange(int(s.max()))[:, None] < s
        spots = (b + np.arange(mask.shape[0])[:, None])[mask]
        grid = np.zeros((*mask.shape, k))
        grid[mask] = states[codes[spots]]
        votes[spots] = _only_marginals(grid, field, mask)[mask]
    votes[~letters[codes]] = 0.0
    text = np.repeat(np.arange(n), lengths)
    total = np.stack([np.bincount(text, weights=votes[:, j], minlength=n) for j in range(k)], axis=1)
    mass = total.sum(axis=1)
    some = mass > 0
    best[some] = total[some].argmax(axis=1)
    score[some] = np.clip(total[some].max(axis=1) / mass[some], 0.0, 1.0)
    return best, score


def _only_marginals(states: np.ndarray, field: Field, mask: np.ndarray) -> np.ndarray:
    """marginals() without the joint sums."""
    steps, chains, k = states.shape
    e = np.exp(states - states.max(axis=2, keepdims=True))
    t = np.exp(field.moves - field.moves.max())
    forward = np.empty_like(e)
    a = np.exp(field.first - field.first.max()) * e[0]
    forward[0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, steps):
        a = (forward[i - 1] @ t) * e[i]
        forward[i] = a / a.sum(axis=1, keepdims=True)
    back = np.full((chains, k), 1.0 / k)
    for i in range(steps - 2, -1, -1):
        message = (e[i + 1] * back) @ t.T
        message /= message.sum(axis=1, keepdims=True)
        back = np.where(mask[i + 1][:, None], message, 1.0 / k)
        forward[i] *= back
    return forward / forward.sum(axis=2, keepdims=True)


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text (long ones in parts) with its most likely language and that probability."""
    words = _words(text)
    if not words or not field.labels:
        return []
    begin, size = _chained(np.array([len(words)]))
    states, out = field.states(words), []
    for b, s in zip(begin.tolist(), size.tolist(), strict=True):
        p = _only_marginals(states[b: b + s][:, None, :], field, np.ones((s, 1), bool))[:, 0]
        out += [(words[b + i], field.labels[j], float(p[i, j])) for i, j in enumerate(p.argmax(axis=1).tolist())]
    return out


def training_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """The bounded sample of labelled training texts: at most SAMPLE per label. Texts of over SAMPLE_BYTES bytes are there in pieces."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).cast("binary")) % FOLDS
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != HELD)).filter(
        F.octet_length("text") > 0)
    count = F.ceil(F.octet_length("text") / SAMPLE_BYTES)
    pieces = F.expr(f"transform(sequence(0L, (octet_length(text) - 1) div {SAMPLE_BYTES}), "
                    f"i -> substring(cast(text as binary), cast(i * {SAMPLE_BYTES} + 1 as int), {SAMPLE_BYTES}))")
    cut = usable.select("lang", F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(pieces).alias("text"))
    # Of a common label only about twice the sample by a uniform hash is ranked, so what moves does not grow with the data.
    drawn = cut.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    many = usable.groupBy("lang").agg(F.sum(count).alias("n"))
    near = drawn.join(F.broadcast(many), "lang").filter(F.shiftrightunsigned("h", 11) * 2.0**-53 < 2.0 * SAMPLE / F.col("n"))
    by = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "text")
    rows = near.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= SAMPLE).select("lang", "text", "nth")
    # Halves of a character at a cut go.
    return [(r["lang"], bytes(r["text"]).decode("utf-8", "ignore").encode()) for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["nth"]))]


def _predicted(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field = shared.value
    names = [*field.labels, UNKNOWN]
    for whole in batches:
        for batch in slices(whole, "text", BATCH):
            best, score = labelled(field, batch.column("text"))
            held = [is_held(i) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])


def fitted(spark: SparkSession, docs: DataFrame):
    """Broadcast of the field fitted to docs; its size is set by FEATURES, the labels and the sample."""
    small_batches(spark)
    samples = training_sample(docs)
    return spark.sparkContext.broadcast(fit(samples) if samples else Field([]))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (columns doc_id, text, lang)."""
    shared = fitted(docs.sparkSession, docs)
    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(lambda batches: _predicted(shared, batches), OUT_SCHEMA)


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language: not `und`, and a score of `least` or more. Columns stay as they are."""
    shared = fitted(docs.sparkSession, docs)
    schema, names = docs.schema, docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH):
                best, score = labelled(shared.value, batch.column("text").cast(pa.binary()))
                yield batch.filter(pa.array((best >= 0) & (score >= least))).select(names)

    return docs.mapInArrow(keep, schema)
