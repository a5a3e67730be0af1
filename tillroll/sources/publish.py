"""Versions of a table: write the next one, check it, then move the pointer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def current_version(spark: SparkSession, root: str) -> int:
    """Published version, 0 before the first. The pointer is a table of one row per publication."""
    pointer = _pointer(spark, root)
    return 0 if pointer is None else pointer.agg(F.max("version")).first()[0]


def _pointer(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("version int").parquet(f"{root}/published")
    except AnalysisException:  # nothing published yet
        return None


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version or current_version(spark, root)}")


def publish(df: DataFrame, root: str, violations=None, partition_by: str | None = None) -> int:
    """Write a new version and publish it unless `violations(old, new)` has rows.

    A refused version stays unpublished; readers keep the old one.
    """
    spark = df.sparkSession
    old = current_version(spark, root)
    new = old + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/version={new}")
    if violations is not None and old:
        found = violations(read_version(spark, root, old), read_version(spark, root, new)).limit(5).collect()
        if found:
            raise ValueError(f"version {new} not published: {found}")
    spark.range(1).select(F.lit(new).cast("int").alias("version")).write.mode("append").parquet(f"{root}/published")
    return new


def write_report(df: DataFrame, path: str) -> None:
    """Audit and migration results as JSON lines."""
    df.write.mode("overwrite").json(path)
