"""As-of lookup: for every left row the last right row of its series before it.

Both sides are put into one table, dealt by ranges of (series, order) into segments of like
size and written once. Within a segment the last right value is carried forward by a window.
A series may begin in an earlier segment: one row per segment, the last right row it holds,
is carried on to the segments after it. So neither a long series nor a hot key gathers in
one task, and the sides are not joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.session import stored


def _all_known(columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], order: list[str], values: list[str],
                  into: str = "found", inclusive: bool = False, segments: int | None = None) -> DataFrame:
    """The left rows with a struct `into` of the `values` of the right row found, or NULL.

    `by` and `order` are columns of both sides. Only a right row strictly before counts, with
    `inclusive` also one at the same place; of several at one place the one with the greatest
    values. Rows without a series or a place find nothing and are not found. `segments` is the
    number of shuffle partitions if none is given; it does not change the result.
    """
    spread = [segments] if segments else []
    asked = left.select(*by, *order, F.lit(int(inclusive)).alias("_side"), F.struct(*left.columns).alias("_left"))
    known = right.where(_all_known([*by, *order])).select(
        *by, *order, F.lit(int(not inclusive)).alias("_side"), F.struct(*values).alias("_right"))
    both = asked.unionByName(known, allowMissingColumns=True)
    placed = stored(both.repartitionByRange(*spread, *by, *order, "_side").withColumn("_segment", F.spark_partition_id()))
    series, found = W.partitionBy("_segment", *by), F.col("_right").isNotNull()
    last = F.last("_right", ignorenulls=True).over(
        series.orderBy(*order, "_side", "_right").rowsBetween(W.unboundedPreceding, W.currentRow))
    # One row per segment, so neither this window nor the broadcast grows with the rows.
    tails = placed.groupBy("_segment").agg(F.max(F.when(found, F.struct(*by, *order, "_right"))).alias("_tail"))
    before = tails.select("_segment", F.max("_tail").over(
        W.orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_before.{c}") for c in by])
    carried = F.when(same & _all_known(order), F.col("_before._right"))
    return placed.withColumn("_last", last).where("_left IS NOT NULL").join(F.broadcast(before), "_segment", "left").select(
        "_left.*", F.coalesce("_last", carried).alias(into))
