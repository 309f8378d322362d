"""Exact search for the nearest vectors by integer inner product, exhaustive and term at a time.

Components x become floor(64 x), the weight of the term that is the component's place. Queries and candidates are dealt into
blocks, and every pair of a query block and a candidate block is one cell, so each task holds a bounded number of rows and
the work is even, whatever vectors are alike. Within a cell the candidates lie in order of vec_id, in tiles. Term after term,
the queries that have the term scatter their weight times the term's weighted postings into the tile's dense score array; a
term that most candidates of the tile have is posted densely, one that few have as places and weights. Partition selection
keeps the best of each query: the k-th score of the tile is found by introselect, what lies below it or does not beat the
query's best of earlier tiles goes. The best of each cell are merged by a window per query.

Vectors that are null or hold a null or non-finite component take no part; an empty vector has score 0 with all others, a
missing component is 0. Ties go to the smaller vec_id, rows without a vec_id are candidates (last among ties) but no queries.
Repeated rows are candidates and queries of their own: a query meets every row but itself. Weights beyond a long saturate
and sums beyond it wrap, as Spark's long arithmetic does. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Stages, run_starts

SCALE, BEST, EVERY = 64, 20, 20
#: Rows of a block of queries and of candidates, and weights of a block; what fits first.
QUERY_BLOCK, BLOCK, BLOCK_WEIGHTS = 4096, 32_768, 1 << 22
#: Queries and candidates of one score array.
TILE_QUERIES, TILE = 32, 4096
CELL_SCHEMA = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


def weights(vectors: DataFrame) -> DataFrame:
    """row (a number of each row), vec_id and integer weights of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("weights"))


def dense(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of weights as a matrix, shorter ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    places = np.arange(width)[None, :] < n[:, None]
    out[places] = np.asarray(lists.flatten())
    return out


def accumulate(scores: np.ndarray, queries: np.ndarray, tile: np.ndarray) -> None:
    """Adds the inner products of sparse query rows [queries, terms] with a tile's postings [terms, candidates] to scores."""
    part = np.empty_like(scores)
    for term in np.flatnonzero(queries.any(axis=0)):
        has = queries[:, term]
        rows = np.flatnonzero(has)
        posted = np.flatnonzero(tile[term]) if np.count_nonzero(tile[term]) * 4 < tile.shape[1] else None
        if posted is not None:  # places and weights
            if len(posted):
                scores[np.ix_(rows, posted)] += has[rows, None] * tile[term, posted][None, :]
        elif len(rows) * 2 < len(has):
            scores[rows] += has[rows, None] * tile[term][None, :]
        else:
            np.multiply(has[:, None], tile[term][None, :], out=part)
            np.add(scores, part, out=scores)


def best_of_cell(queries: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, candidate number and score of each query's k best, ties to the earlier candidate."""
    most = int(np.abs(queries).max(initial=0)), int(np.abs(candidates).max(initial=0))
    kind = np.int32 if most[0] * most[1] * max(queries.shape[1], 1) < 2**31 and max(most) < 2**31 else np.int64
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        held = [(np.empty(0, np.int64),) * 3 for _ in range(0, len(queries), TILE_QUERIES)]
        bar = [None] * len(held)  # score that a later candidate of each query must beat
        for a in range(0, len(candidates), TILE):
            tile = np.ascontiguousarray(candidates[a: a + TILE].T)
            for i, b in enumerate(range(0, len(queries), TILE_QUERIES)):
                block = queries[b: b + TILE_QUERIES]
                scores = np.zeros((len(block), tile.shape[1]), kind)
                accumulate(scores, block, tile)
                if bar[i] is not None:
                    over = scores > bar[i][:, None]
                elif tile.shape[1] > k:
                    over = scores >= np.partition(scores, tile.shape[1] - k, axis=1)[:, -k][:, None]
                else:
                    over = np.ones(scores.shape, bool)
                q, c = np.nonzero(over)
                if not len(q):
                    continue
                q, c, s = (np.concatenate(x) for x in zip(held[i], (q, c + a, scores[q, c].astype(np.int64)), strict=True))
                order = np.lexsort((c, ~s, q))
                q, c, s = q[order], c[order], s[order]
                starts = run_starts(q)
                place = np.arange(len(q)) - np.repeat(starts[:-1], np.diff(starts))
                keep = place < k
                held[i] = q[keep], c[keep], s[keep]
                if len(starts) == len(block) + 1 and np.diff(starts).min() >= k:
                    bar[i] = s[starts[:-1] + k - 1].astype(kind)
        for i, (q, c, s) in enumerate(held):
            found.append((q + i * TILE_QUERIES, c, s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _cell(queries: pa.Table, candidates: pa.Table, width: int, k: int) -> pa.Table:
    names = CELL_SCHEMA.replace(" bigint", "").split(", ")
    if not queries.num_rows or not candidates.num_rows:
        return pa.Table.from_arrays([pa.array([], pa.int64())] * len(names), names)
    candidates = candidates.sort_by([("c_vec_id", "ascending"), ("c_row", "ascending")])  # nulls last
    q, c, s = best_of_cell(dense(queries.column("q_weights"), width), dense(candidates.column("c_weights"), width), k)
    take = lambda t, n, at: t.column(n).take(pa.array(at))
    return pa.Table.from_arrays([take(queries, "q_row", q), take(queries, "q_vec_id", q), take(candidates, "c_row", c),
                                 take(candidates, "c_vec_id", c), pa.array(s)], names)


def nearest(vectors: DataFrame, best: int = BEST, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the best rows for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    stages = Stages(spark, "topk")
    rows = stages.cut(weights(vectors)).df  # row must be the same for queries and candidates
    is_query = F.col("vec_id") % every == 0
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"), F.max(F.size("weights")).alias("width")).first()
    width = max(1, sizes["width"] or 1)
    most = max(1, BLOCK_WEIGHTS // width)
    query_blocks = max(1, -(-sizes["queries"] // min(QUERY_BLOCK, most)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-sizes["n"] // min(BLOCK, most)), min(-(-2 * parts // query_blocks), -(-sizes["n"] // 1024)), 1)
    # Both sides' block numbers must have one type: cogroup does not widen its keys, and an int and a long hash apart.
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # The stated queries against all rows, in blocks: a query goes to each candidate block, a candidate to each query block.
    renamed = lambda p: [F.col(c).alias(p + c) for c in ("row", "vec_id", "weights")]
    queries = rows.filter(is_query).select(*renamed("q_"), block(query_blocks, 1).alias("qb"), every_of(blocks).alias("cb"))
    candidates = rows.select(*renamed("c_"), every_of(query_blocks).alias("qb"), block(blocks, 2).alias("cb"))
    cells = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(partial(_cell, width=width, k=best + 1), CELL_SCHEMA)
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return cells.filter("query_row <> row").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= best).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
