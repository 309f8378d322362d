"""Registered queries of the document operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.best_fit_packing import packed_documents
from tideline.llm.common import Stages, documents
from tideline.llm.conversation_repair import repair_conversations
from tideline.llm.crf_language import languages
from tideline.llm.exact_topk import nearest
from tideline.llm.golomb_exchange import exact_duplicates
from tideline.llm.line_minhash import line_report
from tideline.llm.maxent_lm import model_scores
from tideline.llm.piece_merges import piece_digests
from tideline.llm.range_coder import read_documents, write_ids
from tideline.llm.simhash_variants import simhash_components
from tideline.llm.spelling_variants import spelling_variants
from tideline.llm.suffix_sort import repeat_report
from tideline.llm.weighted_sampling import document_fingerprints

Query = Callable[[SparkSession, str], DataFrame]

#: Words of the shortest passages that op8 reports beside its 400 bytes.
PASSAGE = 51

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


@query("op2_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
    WINDOW w AS (PARTITION BY t)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(documents(spark, sf_dir))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


@query("op6_document_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_suffix_array_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(documents(spark, sf_dir), PASSAGE)


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))


@query("op10_token_id_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stages(spark, 'ids').root}/files"
    write_ids(documents(spark, sf_dir), path)
    return read_documents(spark, path)


@query("op11_exact_topk", """
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
        FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.rid AS qr, q.vec_id AS query_id, c.vec_id, c.rid,
        CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, rid) AS rank FROM s) WHERE rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _nibbles() -> str:
    """The CRC-32 of each half byte, from the polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(f"CAST({c} AS BIGINT)")
    return f"[{', '.join(out)}]"


# CRC-32 half byte by half byte, near words by common deletions and common gaps, forms by recursion.
@query("op12_spelling_variants", f"""
    WITH RECURSIVE
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    per AS MATERIALIZED (SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM runs GROUP BY doc_id, run),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(b)),
            lambda i: CAST('0x' || substr(b, i + 2 - 2 * (i % 2), 1) AS BIGINT))),
            lambda c, x: xor(c >> 4, {_nibbles()}[(xor(c, x) & 15) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM per),
    voc AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0
            THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    gaps AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc)),
    del AS (SELECT DISTINCT g.word, g.n, v.word AS other, v.n AS other_n FROM gaps g JOIN voc v ON v.word = g.a || g.z),
    near AS (SELECT word, other, other_n FROM del UNION SELECT other, word, n FROM del
        UNION SELECT x.word, y.word, y.n FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word),
    best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
    forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form,
        CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM voc v LEFT JOIN best b ON b.word = v.word AND place = 1),
    chain AS (SELECT word, form AS tail FROM forms WHERE form IS NOT NULL
        UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.tail WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.tail FROM chain c JOIN forms f ON f.word = c.tail WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(tail, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON e.word = f.word""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
