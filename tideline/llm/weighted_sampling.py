"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text is its words with their counts. For sample k each word gets r, c from Gamma(2, 1) and b from [0, 1), all from
hashes of the word and k. With weight S: t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the sample is the word
and t of the least a. Two texts have the same sample with the probability of their generalised Jaccard similarity,
sum of min counts / sum of max counts. The least ln a stands for its word and t, as it is a function of them, so samples
are plain minima in one hash aggregate. A fingerprint has four hex digits of a hash for each of the SAMPLES samples.

Texts are shuffled once, by doc_id; of the next document only as much as its predecessor needs moves on.

Null counts as empty. Rows with one doc_id are one document with the largest of their texts. A document with null doc_id
has no neighbours: its edited text loses the last quarter, and near_next is null. A text without words has the
fingerprint of zeros, which is like itself only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Stages

SAMPLES, STRAND, DIGITS = 64, 8, 4

#: Bits of a hash for r, for u and of u for the table of ln c; below so many cells ln c is computed.
R_BITS, U_BITS, C_BITS, EXACT_CELLS = 10, 28, 12, 16


def neighbours(stages: Stages, ids: DataFrame) -> DataFrame:
    """doc_id, need, next_id, prev_id, prev_need, the ids going round: after the last the first. ids: unique doc_id, need.

    Ids are dealt by ranges; windows stay within a range, and one row per range says what lies beyond it.
    """
    dealt = stages.cut(ids.repartitionByRange("doc_id").withColumn("range_no", F.spark_partition_id())).df
    edges = dealt.groupBy("range_no").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max_by("need", "doc_id").alias("high_need"))
    order = Window.orderBy("range_no")  # as many rows as ranges
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "range_no",
        F.coalesce(F.lead("low").over(order), F.first("low").over(everything)).alias("beyond"),
        F.coalesce(F.lag("high").over(order), F.last("high").over(everything)).alias("ahead"),
        F.coalesce(F.lag("high_need").over(order), F.last("high_need").over(everything)).alias("ahead_need"))
    within = Window.partitionBy("range_no").orderBy("doc_id")
    inner = dealt.withColumns({
        "next_id": F.lead("doc_id").over(within), "prev_id": F.lag("doc_id").over(within), "prev_need": F.lag("need").over(within)})
    return stages.cut(inner.join(F.broadcast(edges), "range_no").select(
        "doc_id", F.coalesce("next_id", "beyond").alias("next_id"), F.coalesce("prev_id", "ahead").alias("prev_id"),
        F.coalesce("prev_need", "ahead_need").alias("prev_need"))).df


def with_edited(stages: Stages, docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, next_id, edited for each document."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(quarter).alias("need"))
    beside = neighbours(stages, ids)
    whole = docs.groupBy("doc_id").agg(F.max("text").alias("text")).join(beside, "doc_id", "left")
    # Without a null check that would reach one of the two uses of the exchange by doc_id, it is made once.
    of = F.coalesce("prev_id", F.lit(-(2**63)).cast("bigint")).alias("of")
    begins = whole.select(of, F.expr("substring(text, 1, prev_need)").alias("next_text"))
    joined = whole.join(begins, whole.doc_id == begins.of, "left")
    n = F.length("text")
    return joined.select(
        "doc_id", "text", n.cast("bigint").alias("n_chars"), "next_id",
        F.concat(F.substring("text", F.lit(1), n - quarter), F.coalesce(F.substring("next_text", F.lit(1), quarter), F.lit(""))).alias("edited"))


def _gamma_quantile(u: float) -> float:
    """Quantile of Gamma(2, 1), whose distribution function is 1 - exp(-x) (1 + x), by Newton steps from below."""
    x = math.sqrt(2.0 * u)
    for _ in range(60):
        x += (u - 1.0 + math.exp(-x) * (1.0 + x)) / (x * math.exp(-x))
    return x


def _table(values: list[float]) -> Column:
    """An array literal: Catalyst folds the parsed text once."""
    return F.split(F.lit(",".join(f"{v:.7g}" for v in values)), ",").cast("array<double>")


def samples(word: Column, logs: list[Column], k: Column) -> list[Column]:
    """ln a of sample k for each log weight of the word; null where that is null.

    One hash gives r (a quantile of 2 ** R_BITS), u and b. ln c is the quantile at u: from the table by the leading bits,
    and below the table's first cells by the expansion of the quantile at zero, so that long texts keep full resolution.
    """
    h = F.xxhash64(word, k)
    r = F.get(_table([_gamma_quantile((i + 0.5) / 2**R_BITS) for i in range(2**R_BITS)]), F.shiftrightunsigned(h, 64 - R_BITS).cast("int"))
    u = (F.shiftrightunsigned(h, 24).bitwiseAND(2**U_BITS - 1) + 0.5) * 2.0**-U_BITS
    cell = F.shiftrightunsigned(h, 24 + U_BITS - C_BITS).bitwiseAND(2**C_BITS - 1).cast("int")
    table = _table([math.log(_gamma_quantile((i + 0.5) / 2**C_BITS)) for i in range(2**C_BITS)])
    c = F.when(cell < EXACT_CELLS, F.ln(2.0 * u) * 0.5 + F.sqrt(2.0 * u) / 3.0).otherwise(F.get(table, cell))
    b = (h.bitwiseAND(2**24 - 1) + 0.5) * 2.0**-24
    return [c - r * (F.floor(x / r + b) - b + 1.0) for x in logs]


def fingerprints(texts: DataFrame, sides: list[str], n: int = SAMPLES) -> DataFrame:
    """doc_id and, for each text column in sides, its fingerprint as <side>_print. texts: unique doc_id, dealt by it.

    A row per word and strand of STRAND samples keeps the aggregate's code small enough to be compiled.
    """
    spread = texts.select("doc_id", F.explode(F.array(*(
        F.struct(F.lit(i).alias("side"), F.col(s).alias("body")) for i, s in enumerate(sides)))).alias("t"))
    words = spread.select("doc_id", F.col("t.side").alias("side"), F.explode(F.split("t.body", "[ \\t-\\r]+")).alias("word"))
    counts = words.filter("word <> ''").groupBy("doc_id", F.xxhash64("word").alias("word")).agg(
        *(F.sum(F.when(F.col("side") == i, 1.0).otherwise(0.0)).alias(f"w{i}") for i in range(len(sides))))
    logs = [F.when(F.col(f"w{i}") > 0, F.ln(f"w{i}")).alias(f"l{i}") for i in range(len(sides))]
    strands = counts.select("doc_id", "word", *logs, F.explode(F.sequence(F.lit(0), F.lit(n // STRAND - 1))).alias("strand"))
    least = [F.min(x).alias(f"m{i}_{j}") for j in range(STRAND)
             for i, x in enumerate(samples(F.col("word"), [F.col(f"l{i}") for i in range(len(sides))], F.col("strand") * STRAND + j))]
    minima = strands.groupBy("doc_id", "strand").agg(*least)

    def digits(m: Column) -> Column:
        held = F.lower(F.substring(F.lpad(F.hex(F.xxhash64(m)), 16, "0"), 17 - DIGITS, DIGITS))
        return F.coalesce(F.when(m.isNotNull(), held), F.lit("0" * DIGITS))

    drawn = minima.select("doc_id", F.struct("strand", *(
        F.concat(*(digits(F.col(f"m{i}_{j}")) for j in range(STRAND))).alias(s) for i, s in enumerate(sides))).alias("drawn"))
    ordered = drawn.groupBy("doc_id").agg(F.sort_array(F.collect_list("drawn")).alias("drawn"))
    return ordered.select("doc_id", *(F.array_join(F.col(f"drawn.{s}"), "").alias(f"{s}_print") for s in sides))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, DIGITS * k + 1, DIGITS) == F.substring(b, DIGITS * k + 1, DIGITS)).cast("double") for k in range(n)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / n


def document_fingerprints(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    stages = stages or Stages(docs.sparkSession, "weighted")
    texts = with_edited(stages, docs)
    prints = fingerprints(texts, ["text", "edited"])
    none = F.lit("0" * DIGITS * SAMPLES)
    meta = texts.select("doc_id", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"))
    joined = meta.join(prints.withColumnRenamed("doc_id", "d"), F.expr("doc_id <=> d"), "left").select(
        "doc_id", "n_chars", "next_id", "edited_sha256", F.coalesce("text_print", none).alias("fingerprint"),
        F.coalesce("edited_print", none).alias("edited_fingerprint"))
    rows = stages.cut(joined).df
    following = rows.select(F.col("doc_id").alias("n"), F.col("fingerprint").alias("next_print"))
    return rows.join(following, F.col("next_id") == F.col("n"), "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
