"""Reading, cleaning and writing bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")


def bars_source(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """Bars below a folder. The ticker comes from the data, the partition folder or the file name.

    A requested ticker without a file is simply absent from the result.
    """
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    if "ticker" not in df.columns:
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
        df = df.withColumn("ticker", stem)
    df = df.withColumn("date", F.col("date").cast("date"))
    if tickers is not None:
        df = df.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    keep = [c for c in OHLCV if c in df.columns]
    return df.select("ticker", "date", *keep)


def bars_normalize(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Lower-case OHLCV, no rows without a close, one row per ticker and date.

    The row with the largest ``seq`` wins. The winner is picked with a mergeable aggregate, so a
    ticker that was re-emitted many times shrinks before the shuffle.
    """
    lower = df.toDF(*[c.lower() for c in df.columns])
    keep = [c for c in OHLCV if c in lower.columns]
    if "close" not in keep:
        return lower.select("ticker", F.col("date").cast("date").alias("date")).limit(0)
    clean = lower.select(
        "ticker", F.col("date").cast("date").alias("date"),
        *[F.col(c).cast("double").alias(c) for c in keep], F.col(seq).alias("_seq"),
    ).dropna(how="all", subset=keep).dropna(subset=["close"])
    # Column by column, each over the same rows in the same order: numbers fit a hash aggregate, a struct would be sorted.
    return clean.groupBy("ticker", "date").agg(*[F.max_by(c, "_seq").alias(c) for c in keep])


def bars_sink(df: DataFrame, path: str, skip_existing: bool = True, requested: DataFrame | None = None,
              layout: str = "bucket", buckets: int = 256) -> DataFrame:
    """Append bars of tickers that are not stored yet and return the counts.

    ``layout='ticker'`` makes one folder per ticker; ``'bucket'`` hashes tickers into a fixed number
    of folders, which is what a panel of many millions of tickers needs. Rows are dealt by ranges of
    (bucket, ticker, date), so as many tasks write as the input fills, whatever the number of folders.
    The counts come from the listing of stored tickers before and after, so nothing is counted on the driver.
    """
    spark = df.sparkSession
    asked = (requested if requested is not None else df).select("ticker").distinct()
    stored = _stored_tickers(spark, path)
    new = df.join(stored, "ticker", "left_anti") if skip_existing else df
    if layout == "ticker":
        out, part = new.repartitionByRange("ticker", "date"), "ticker"
    else:
        out = new.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"))
        out, part = out.repartitionByRange("bucket", "ticker", "date"), "bucket"
    out.sortWithinPartitions(part, "ticker", "date").write.mode("append").partitionBy(part).parquet(path)
    had = stored.withColumn("had", F.lit(1))
    have = _stored_tickers(spark, path).withColumn("have", F.lit(1))
    # Stored tickers of earlier runs that nobody asked for still count towards the total.
    return (
        asked.withColumn("asked", F.lit(1))
        .join(have, "ticker", "full_outer").join(had, "ticker", "left")
        .agg(
            F.count("asked").alias("requested"),
            F.sum(F.when(F.col("have").isNotNull() & F.col("had").isNull(), 1).otherwise(0)).alias("fetched"),
            F.sum(F.when(F.col("have").isNull(), 1).otherwise(0)).alias("empty_or_missing"),
            F.count("have").alias("total_stored"),
        )
    )


def _stored_tickers(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], "ticker string")
    # The reader lists files once, here, so what is stored now stays fixed for this frame.
    return spark.read.parquet(path).select("ticker").distinct()
