"""Session settings shared by the bench, the tests and the driver entry."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own.

    The price model compiles to methods beyond what the JVM optimises; above hugeMethodLimit
    Spark evaluates operator by operator, which measured twice as fast here. Queries change
    no setting of the session they are given.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName("tillroll")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, to the shared folder, and read it back.

    For results that several branches of one job read: they then scan a narrow columnar
    table instead of computing it again, a lost executor costs only its own tasks, and
    the planner knows the size. The folder is the one the cluster names; a private one is
    used only where none is named, which is allowed for a local master alone.
    """
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_folder(spark: SparkSession) -> str:
    """A new folder for the output and the log of one stream."""
    return f"{_shared_folder(spark)}/{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_SETTING, None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="tillroll-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
