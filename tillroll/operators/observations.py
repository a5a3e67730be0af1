"""Purchase lines joined to their receipt: the one view all analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.identity import identity


def observe(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Inner join on the receipt with the effective identity; the receipt adds date and store.

    No hint: the planner broadcasts receipts only below its size threshold, and otherwise
    splits a receipt that holds too many lines.
    """
    head = receipts.select(F.col("id").alias("receipt_id"), "date", "store")
    return items.withColumn("identity", identity()).join(head, "receipt_id")


def of_receipts(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """The lines of some receipts (receipt_id)."""
    return items.join(receipts.select("receipt_id"), "receipt_id", "left_semi")


def paid() -> Column:
    """What the line cost, for the dashboard: line total, else price, else nothing."""
    return F.coalesce(F.col("line_total"), F.col("price"), F.lit(0))
