"""Sources in text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL_SCHEMA = (
    "event_id bigint, ts string, model string, label string, horizon_d bigint, threshold_q bigint, "
    "universe string, headline_sharpe double, _corrupt string"
)
FILING_SCHEMA = (
    "_id string, _source struct<ciks: array<string>, display_names: array<string>, "
    "file_date: string, form: string>"
)
PICK_SCHEMA = (
    "ticker string, anchor_date date, anchor_close double, adv20_usd double, score double, "
    "pick_generated string, horizon_days int, track string"
)


def symbols_source(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited symbol directory with a header; every column a string."""
    return spark.read.option("sep", "|").option("header", True).csv(path)


def seed_list_source(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blank lines and # comments skipped; inactive by definition."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .select(line.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select(F.upper("line").alias("ticker"), F.lit(False).alias("active"))
    )


def trial_log_source(spark: SparkSession, path: str, schema: str = TRIAL_SCHEMA) -> DataFrame:
    """JSON lines; blank and malformed lines skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("p")).select("p.*").filter(F.col("_corrupt").isNull()).drop("_corrupt")


def picks_source(spark: SparkSession, path: str, schema: str = PICK_SCHEMA) -> DataFrame:
    """All picks CSV files of a folder; the file stem stands in for a missing pick_generated."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn("pick_generated", F.coalesce("pick_generated", stem))


def filings_source(spark: SparkSession, path: str) -> DataFrame:
    """Nested filing JSON flattened to one row per filing."""
    return flatten_filings(spark.read.schema(FILING_SCHEMA).json(path))


def flatten_filings(df: DataFrame) -> DataFrame:
    return df.select(
        F.split("_id", ":")[0].alias("accession"),
        F.col("_source.ciks")[0].alias("cik"),
        F.col("_source.display_names")[0].alias("issuer"),
        F.col("_source.file_date").alias("filing_date"),
        F.col("_source.form").alias("form"),
    )
