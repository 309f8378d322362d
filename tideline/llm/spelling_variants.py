"""Spelling variants of one edit, found over a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a short string over SYMBOLS symbols, and one inserted, deleted or
replaced letter becomes at most one such edit of it. For each distinct reduced word the full neighbourhood of one edit is
generated (itself, every deletion, every insertion, every replacement) and joined with the reduced vocabulary; only then come
the words of both sides, and every pair is verified on the original strings. A neighbourhood has about 2 x SYMBOLS x length
members whatever the alphabet of the words.

A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF of LEAST code points or more that occurs FEW times or more, A-Z
lower-cased; occurrences whose hash with the document is divisible by DAMAGE lose one code point first. Its form is its
near word that occurs most (ties: first in code-point order), if that is TIMES as often or more. Forms occur more often at
each step, so the chain of forms has at most log(most / FEW) / log(TIMES) steps and its end is found by so many doublings.

Words are counted before anything else is done with them, so frequent words cost one row. Reduced words are exact (four
bits a symbol, 64-bit hashed above 14 symbols) and chance matches fall to the verification. A null doc_id hashes as the empty
string, null texts have no words; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Stages, column, ranges

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE, LEAST, FEW, TIMES = 199, 6, 5, 5
SYMBOLS = 8
#: Reduced words whose neighbourhoods are held at a time.
BATCH = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(docs: DataFrame) -> DataFrame:
    """word, n: the vocabulary after the damage."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, less).otherwise(F.col("run"))
    found = low.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LEAST)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= FEW)


def symbols(points: np.ndarray, many: int = SYMBOLS) -> np.ndarray:
    """Code points hashed to 1..many."""
    return (points.astype(np.uint64) % np.uint64(many) + np.uint64(1)).astype(np.uint64)


def _keys(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit key for each string of symbols: its digits, or above 14 symbols their hash."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.zeros(len(lengths), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(lengths.max(initial=0))):
            here = np.flatnonzero(lengths > k)
            digit = flat[starts[here] + k]
            short = lengths[here] <= 14
            out[here] = np.where(short, out[here] << np.uint64(4) | digit, (out[here] ^ digit) * _BASE ^ (out[here] >> np.uint64(29)))
    return out


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words, one after the other, and their lengths."""
    values = texts.to_pylist()
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    return symbols(np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)), lengths


def neighbourhood(flat: np.ndarray, lengths: np.ndarray, many: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Number of a reduced word and key of a string, for every string at no more than one edit from it."""
    starts = np.cumsum(lengths) - lengths
    rows, keys = [np.arange(len(lengths))], [_keys(flat, lengths)]

    def changed(count: np.ndarray, step: int, symbol: np.ndarray | None) -> None:
        """Strings that differ at place 0..count-1: step -1 without the symbol there, 0 with another, 1 with one more."""
        row = np.repeat(np.arange(len(lengths)), count)
        place = ranges(np.zeros(len(lengths), np.int64), count)
        size = lengths[row] + step
        new = np.repeat(np.arange(len(row)), size)
        at = ranges(np.zeros(len(row), np.int64), size)
        from_ = starts[row][new] + at
        if step < 0:
            from_ += at >= place[new]
            out = flat[from_]
        else:
            from_ -= (at > place[new]) * step
            swap = at == place[new]
            out = flat[np.minimum(from_, max(len(flat) - 1, 0))]
            out[swap] = symbol
        rows.append(row)
        keys.append(_keys(out, size))

    changed(lengths, -1, None)
    for s in range(1, many + 1):
        changed(lengths, 0, np.uint64(s))
        changed(lengths + 1, 1, np.uint64(s))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[fresh], key[fresh]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, lengths = coded(batch.column("word"))
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(_keys(flat, lengths).view(np.int64))], ["word", "n", "reduced"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, BATCH):
            batch = whole.slice(a, BATCH)
            flat, lengths = coded(batch.column("word"))
            row, key = neighbourhood(flat, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column(batch, "reduced")[row]), pa.array(key.view(np.int64))], ["reduced", "near"])


def near_pairs(vocabulary: DataFrame, stages: Stages) -> DataFrame:
    """word, other, other_n: ordered pairs of words that differ by exactly one edit."""
    reduced = stages.cut(vocabulary.mapInArrow(_reduced, "word string, n bigint, reduced bigint")).df
    one = reduced.groupBy("reduced").agg(F.min("word").alias("word"))
    reach = one.mapInArrow(_neighbours, "reduced bigint, near bigint")
    # Both sides of the reduced vocabulary first: only keys of words that exist meet their words.
    links = stages.cut(reach.join(one.select(F.col("reduced").alias("near")), "near", "left_semi")).df
    left = links.join(reduced.select("reduced", "word"), "reduced")
    right = reduced.select(F.col("reduced").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    size = F.abs(F.length("word") - F.length("other"))
    return left.join(right, "near").filter((size <= 1) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    stages = Stages(docs.sparkSession, "spelling")
    vocabulary = stages.cut(words(docs)).df
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(vocabulary, stages).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n_near"), best.alias("b"))
    joined = vocabulary.join(near, F.col("word") == F.col("w"), "left")
    strong = -F.col("b.less") >= TIMES * F.col("n")
    table = stages.cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("b.form")).alias("form"),
        F.when(strong, -F.col("b.less")).alias("form_n")))
    most = table.df.agg(F.max("form_n")).first()[0] or FEW
    steps = int(math.log(max(most / FEW, 1), TIMES) + 1e-9)
    chain = table.df.filter("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        onward = chain.select(F.col("word").alias("w"), F.col("root").alias("r"))
        chain = stages.cut(chain.join(onward, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"))).df
        done *= 2
    roots = chain.select(F.col("word").alias("w"), "root")
    return table.df.join(roots, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
