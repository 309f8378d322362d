"""Settling past picks and replacing corrected bars, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.quality import with_bar_index

# The key and the output columns of settled picks.
PICK_KEY = ["pick_generated", "ticker", "horizon_days"]
REALIZED_COLS = ["pick_generated", "ticker", "horizon_days", "anchor_date", "entry_close", "exit_date",
                 "exit_close", "realized_ret", "score", "track"]
BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def settle_picks(picks: DataFrame, bars: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Realized rows of the picks that are open and can be resolved.

    Needs a bar on the anchor date itself with a positive close and a bar ``horizon_days`` positions
    later. A key is settled once. Picks are few: the joins send them to the bars, not the reverse.
    """
    todo = picks if settled is None else picks.join(settled.select(*PICK_KEY), PICK_KEY, "left_anti")
    bars = bars.join(todo.select("ticker").distinct(), "ticker", "left_semi")
    b = with_bar_index(bars).select("ticker", "date", "close", "idx")
    entry = b.select("ticker", F.col("date").alias("anchor_date"), F.col("close").alias("entry_close"),
                     F.col("idx").alias("_i"))
    leave = b.select("ticker", F.col("date").alias("exit_date"), F.col("close").alias("exit_close"),
                     F.col("idx").alias("_x"))
    j = todo.join(entry.filter("entry_close > 0"), ["ticker", "anchor_date"])
    j = j.withColumn("_x", F.col("_i") + F.col("horizon_days")).join(leave, ["ticker", "_x"])
    j = j.withColumn("realized_ret", F.col("exit_close") / F.col("entry_close") - 1.0)
    first = Window.partitionBy(*PICK_KEY).orderBy("anchor_date", F.col("score").desc_nulls_last())
    return j.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select(*REALIZED_COLS)


def settle_counts(picks: DataFrame, settled: DataFrame | None, new: DataFrame) -> DataFrame:
    """picks_seen, newly_settled and still_pending."""
    seen = picks.agg(F.count("*").alias("picks_seen"))
    todo = picks if settled is None else picks.join(settled.select(*PICK_KEY), PICK_KEY, "left_anti")
    todo = todo.join(new.select(*PICK_KEY), PICK_KEY, "left_anti")
    return seen.select(
        "picks_seen",
        new.agg(F.count("*")).scalar().alias("newly_settled"),
        todo.agg(F.count("*")).scalar().alias("still_pending"))


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows plus the new ones whose key is not there yet."""
    fresh = new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh)


def append_version(spark: SparkSession, base: str, new: DataFrame, key: list[str]) -> str:
    """Write the newest version plus the new rows to the next version folder and return it.

    Readers take the newest finished folder (see newest_version), so they switch at once and a failed write leaves the
    old version in place. Appending the same rows again adds nothing.
    """
    number, path = _newest(spark, base)
    rows = append_new(spark.read.parquet(path), new, key) if path else new.dropDuplicates(key)
    target = f"{base}/version={number + 1:06d}"
    rows.write.mode("overwrite").parquet(target)
    return target


def newest_version(spark: SparkSession, base: str) -> DataFrame | None:
    path = _newest(spark, base)[1]
    return spark.read.parquet(path) if path else None


def _newest(spark: SparkSession, base: str) -> tuple[int, str | None]:
    """Number and path of the newest version that was written to the end; 0 and None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = files.globStatus(hadoop(f"{base}/version=*/_SUCCESS"))
    paths = sorted(str(x.getPath().getParent()) for x in done or [])
    return (int(paths[-1].rpartition("=")[2]), paths[-1]) if paths else (0, None)


def settle_stream(spark: SparkSession, bars_dir: str, picks: DataFrame, realized_dir: str, checkpoint: str,
                  files_per_trigger: int = 1, log_dir: str | None = None) -> StreamingQuery:
    """Settle picks as bar files arrive.

    A trigger adds its bars to a log and settles the picks of its tickers on the newest emission of each bar, so a bar
    that is emitted again neither counts twice nor shifts the exit. A trigger owns one output folder and one log folder,
    which a retry overwrites, so a pick is written once even if a trigger is repeated.
    """
    log = log_dir or f"{checkpoint.rstrip('/')}-bars"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        done = _realized(session, realized_dir).filter(F.col("batch") < batch_id)
        touched = batch.select("ticker").distinct()
        seen = bars_current(session, log, touched, batch_id)
        new = settle_picks(picks.join(touched, "ticker", "left_semi"), seen, done)
        new.write.mode("overwrite").parquet(f"{realized_dir}/batch={batch_id}")

    stream = (spark.readStream.schema(BAR_SCHEMA + ", seq int").option("maxFilesPerTrigger", files_per_trigger)
              .parquet(bars_dir))
    return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _realized(spark: SparkSession, path: str) -> DataFrame:
    schema = ("pick_generated string, ticker string, horizon_days int, anchor_date date, entry_close double, "
              "exit_date date, exit_close double, realized_ret double, score double, track string, batch bigint")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_realized(spark: SparkSession, path: str) -> DataFrame:
    return _realized(spark, path).select(*REALIZED_COLS)


def bars_dedupe_stream(spark: SparkSession, source_dir: str, store_dir: str, checkpoint: str,
                       files_per_trigger: int = 1) -> StreamingQuery:
    """Keep every emission of a bar in a log, one folder per trigger; readers take the newest.

    History may be restated at any age, so there is no watermark and no state to outgrow memory.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store_dir}/batch={batch_id}")

    stream = (spark.readStream.schema(BAR_SCHEMA + ", seq int").option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def bars_current(spark: SparkSession, store_dir: str, tickers: DataFrame | None = None, last_batch: int | None = None) -> DataFrame:
    """The newest emission of every bar of the log, of the given tickers and up to a batch if asked."""
    log = spark.read.schema(BAR_SCHEMA + ", seq int, batch bigint").parquet(store_dir)
    if last_batch is not None:
        log = log.filter(F.col("batch") <= last_batch)
    if tickers is not None:
        log = log.join(tickers, "ticker", "left_semi")
    cols = ["open", "high", "low", "close", "volume"]
    # (batch, seq) as one number, a null seq first: with numbers only, column by column, the log is hashed and not sorted.
    place = F.coalesce(F.col("seq").cast("bigint") + 2**31 + 1, F.lit(0))
    log = log.filter("close IS NOT NULL").withColumn("_order", F.col("batch") * 2**33 + place)
    return log.groupBy("ticker", "date").agg(*[F.max_by(c, "_order").alias(c) for c in cols])
