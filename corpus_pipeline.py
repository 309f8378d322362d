"""Documents to packed training sequences, stage by stage; each stage reads what the one before it kept, from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.best_fit_packing import packed_documents
from tideline.llm.common import Stages, documents
from tideline.llm.crf_language import known_language
from tideline.llm.line_minhash import dedup_lines
from tideline.llm.simhash_variants import keep_one
from tideline.llm.suffix_sort import remove_repeats

#: Least share of the words of a text that its language must have.
LANGUAGE_SHARE = 0.4

#: Words of the shortest passages that go where they are repeated.
PASSAGE = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a leading language go."""
    return known_language(docs, LANGUAGE_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike one stays; documents that lose every line go."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes or more, that also start elsewhere go; documents of which nothing is left go."""
    return remove_repeats(docs, PASSAGE)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1,024 tokens."""
    return packed_documents(docs)


STAGES = [
    ("language id", language),
    ("line dedup", lines),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", passages),
    ("best-fit packing", sequences),
]

#: The stages run a trained model and iterative searches, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = Stages(spark, f"pipeline-{name.split()[0]}").cut(stage(spark, docs, sf_dir)).df
    return docs
