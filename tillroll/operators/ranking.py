"""Rank of every row in a total order, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.session import stored


def with_rank(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Add the 0-based rank by the given columns.

    Rows are cut into ranges of about equal size by sampled bounds, so a common value of
    the first column does no harm. Only the row counts of the ranges are summed up in one
    place, and the row number is counted within a range.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_rows").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.join(offsets, "_range").withColumn(
        out, (number - 1 + F.col("_before")).cast("bigint")).drop("_range", "_before")
