"""Session settings the operators rely on."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Wide invoice rows generate methods the JVM would only interpret; beyond this size Spark falls back
# to smaller pieces, which the JVM compiles.
HUGE_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app_name: str = "khata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI casts, UTC and adaptive execution on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        HUGE_METHOD_LIMIT[0]: HUGE_METHOD_LIMIT[1],
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a fresh local one only where none is set and all runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of an executor, unlike a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Python and the driver collect what nobody refers to: Spark removes the files of a shuffle only then, so those behind a checkpoint stay on disk.

    By themselves they may not do so for half an hour. Java objects whose methods were called are in cycles, and the last job is held until there is another.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).count()
    spark._jvm.System.gc()
