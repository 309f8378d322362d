"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tideline", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .getOrCreate()
    )
    return tune(spark)


#: Temporary shared folder of each local application that configures none.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or a temporary one in local mode.

    The setting is only read: Spark does not let a running session change it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_DIRS:
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL_DIRS[context.applicationId] = made
    return _LOCAL_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tideline-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later stages restart from files instead of from lost executors, read only the columns they need
    and plan their joins with the real size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Runtime settings the plans were tuned with.
TUNING = {
    # The feature aggregate keeps more than 100 running values; below this limit it loses code generation.
    "spark.sql.codegen.maxFields": "400",
    # An anchor window multiplies its input by up to 252, so small shuffle partitions are worth a task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Unions of co-partitioned inputs lose track of their partition count once small partitions are merged.
    "spark.sql.unionOutputPartitioning": "false",
    # Bars that a window has put in order are gathered as they come; a hash aggregate of lists would sort them again.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark
