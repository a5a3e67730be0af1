"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_medians(df: DataFrame, keys: list[str], value: str, *extra) -> DataFrame:
    """Twice the median of a whole-number column, its count, least and greatest value.

    Equal values are counted before the groups meet, so a group costs its distinct values
    and a hot group is spread over the cluster until then. Twice the median is whole.
    `extra` are aggregates that may be aggregated again under the same alias: (alias, fn, column).
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), *[fn(c).alias(a) for a, fn, c in extra])
    return counted.groupBy(*keys).agg(
        (F.percentile(value, 0.5, F.col("_n")) * 2).cast("bigint").alias("median_x2"),
        F.sum("_n").alias("observations"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        *[fn(a).alias(a) for a, fn, _ in extra])
