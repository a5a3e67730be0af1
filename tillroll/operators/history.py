"""Trailing price history: count, median, least and greatest strictly earlier price.

A series is one product at one price unit. The window is the 180 days before a line plus
the lines of its own day that come first by (receipt_id, id). No built-in frame has both a
range of days and a tuple order, and a median over a sliding frame would be computed anew
for every line, so the last step is an Arrow function. It answers all windows of a block of
lines at once, level by level of a wavelet matrix over the ranks of their prices.

The lines are dealt by ranges of (series, day, receipt, line) into segments of like size,
which cut a series, a day or a receipt wherever that is needed, and written once. Only the
first series of a segment can have a window that begins before it: Spark sums that part
into (day, price) -> count from the earlier segments and hands it to the segment first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import vocabulary as V
from tillroll.session import stored

SERIES = ["identity", "normalized_price_unit"]
ORDER = ["dn", "receipt_id", "id"]
PLACE = ["segment", *SERIES]
STATS = "prior_count bigint, median_x2 bigint, prior_min bigint, prior_max bigint"
#: Lines answered together at least; a block is also as long as the window it starts with.
BLOCK = 1 << 16


class Window(NamedTuple):
    """What a series has had in its last days: (day, price) cells with their counts, by day."""

    place: tuple
    days: np.ndarray
    prices: np.ndarray
    counts: np.ndarray


def kth_ranks(ranks: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For every query the rank at weight k (from 1) of the entries left <= i < right in order of rank.

    A wavelet matrix, one bit of the ranks at a time: entries with a zero come first, in their
    order, then those with a one, and a query follows the side that holds its k-th weight.
    """
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        one = (ranks >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        light = np.r_[0, np.cumsum(np.where(one, 0, weights))]
        low = light[right] - light[left]
        up = k > low
        k = np.where(up, k - low, k)
        left, right = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (left, right))
        found |= up.astype(np.int64) << bit
        order = np.r_[np.flatnonzero(~one), np.flatnonzero(one)]
        ranks, weights = ranks[order], weights[order]
    return found


def _changes(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    changed = np.zeros(len(rows), bool)
    changed[:1] = True
    for column in columns:
        value = rows[column].to_numpy()
        changed[1:] |= value[1:] != value[:-1]
    return changed


def block_stats(window: Window | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, Window]:
    """The lines of a block with their statistics, and the window after its last line.

    Lines of equal keys must be in one block.
    """
    series = np.cumsum(_changes(rows, PLACE)) - 1
    if window is None or window.place != tuple(rows[PLACE].iloc[0]):
        window = Window((), *[np.empty(0, np.int64)] * 3)
    before = len(window.days)
    n = rows["n"].to_numpy(np.int64)
    days = np.r_[window.days, rows["dn"].to_numpy(np.int64)]
    prices = np.r_[window.prices, rows["price_e4"].to_numpy(np.int64)]
    weights = np.r_[window.counts, np.where(n > 0, n, 1)]
    series = np.r_[np.zeros(before, np.int64), series]
    first_day = days.min()
    span = days.max() - first_day + 1
    place = series * span + (days - first_day)
    lines = before + np.flatnonzero(n == 0)
    left = np.searchsorted(place, series[lines] * span + np.maximum(days[lines] - V.HISTORY_DAYS - first_day, 0))
    # lines of one key see what was there before the first of them
    right = np.maximum.accumulate(np.where(_changes(rows, [*PLACE, "n", *ORDER]), np.arange(len(rows)), 0))[lines - before] + before
    values, ranks = np.unique(prices, return_inverse=True)
    total = np.r_[0, np.cumsum(weights)]
    count = total[right] - total[left]
    some = np.flatnonzero(count)
    held, l, r = count[some], left[some], right[some]  # noqa: E741
    places = [(held + 1) // 2, held // 2 + 1, np.ones_like(held), held]
    lower, upper, least, most = np.split(values[kth_ranks(ranks, weights, np.tile(l, 4), np.tile(r, 4), np.concatenate(places))], 4)
    stats = {"prior_count": pd.array(count, dtype="Int64")}
    for name, value in (("median_x2", lower + upper), ("prior_min", least), ("prior_max", most)):
        filled = np.zeros(len(lines), np.int64)
        filled[some] = value
        stats[name] = pd.arrays.IntegerArray(filled, count == 0)
    out = rows[n == 0].drop(columns=["segment", "n"]).reset_index(drop=True).assign(**stats)
    last = (series == series[-1]) & (days >= days[-1] - V.HISTORY_DAYS)
    cells, which = np.unique((days[last] - first_day) * len(values) + ranks[last], return_inverse=True)
    after = Window(tuple(rows[PLACE].iloc[-1]), cells // len(values) + first_day, values[cells % len(values)],
                   np.bincount(which, weights[last].astype(np.float64), len(cells)).astype(np.int64))
    return out, after


def sliding_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Statistics for the lines of one or more segments, each with its counts from before.

    Rows of a segment come in order, the counts (n is not null) first. What is kept is the
    window of the current series and the lines of a block; a block ends before the lines
    that share its last key, as more of them may follow.
    """
    window, held, size = None, [], 0
    for rows in batches:
        if rows.empty:
            continue
        held.append(rows)
        size += len(rows)
        if size < max(BLOCK, 0 if window is None else len(window.days)):
            continue
        block = pd.concat(held, ignore_index=True) if len(held) > 1 else rows
        cut = int(np.flatnonzero(_changes(block, [*PLACE, "n", *ORDER]))[-1])
        held, size = [block.iloc[cut:]], len(block) - cut
        if cut:
            out, window = block_stats(window, block.iloc[:cut])
            yield out
    if held:
        yield block_stats(window, pd.concat(held, ignore_index=True))[0]


def _counts_before(placed: DataFrame) -> DataFrame:
    """Per segment the (day, price) counts of the window its first line has in earlier segments.

    Broadcast is one row per segment, and there are no more segments than shuffle partitions.
    """
    starts = placed.groupBy("segment").agg(F.min(F.struct(*SERIES, *ORDER)).alias("first")).select(
        F.col("segment").alias("later"), F.col("first.dn").alias("first_dn"), *[F.col(f"first.{c}").alias(f"first_{c}") for c in SERIES])
    cells = placed.groupBy("segment", *SERIES, "dn", "price_e4").agg(F.count("*").alias("n"))
    same = [F.col(c) == F.col(f"first_{c}") for c in SERIES]
    return cells.join(F.broadcast(starts), [*same, F.col("segment") < F.col("later"), F.col("dn") >= F.col("first_dn") - V.HISTORY_DAYS]).groupBy(
        F.col("later").alias("segment"), *SERIES, "dn", "price_e4").agg(F.sum("n").alias("n"))


def _filler(kind: T.DataType) -> Column:
    """What a row of counts has in a carried column: a null would turn whole numbers into floats."""
    return F.lit(0 if isinstance(kind, T.IntegralType) else None).cast(kind)


def with_prior_prices(eligible: DataFrame, segments: int | None = None) -> DataFrame:
    """Add the statistics of strictly earlier prices of the same series.

    Needs identity, normalized_price_unit, dn (day number), receipt_id, id and price_e4;
    all other columns are carried along. `segments` is the number of shuffle partitions
    if none is given; it does not change the result.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in eligible.schema.fields) + ", " + STATS
    spread = [segments] if segments else []
    placed = stored(eligible.repartitionByRange(*spread, *SERIES, *ORDER).withColumn("segment", F.spark_partition_id()))
    before = _counts_before(placed)
    empty = [c for c in eligible.columns if c not in (*SERIES, "dn", "price_e4")]
    rows = placed.withColumn("n", F.lit(0).cast("bigint")).unionByName(before.select(
        "segment", *SERIES, "dn", "price_e4", "n", *[_filler(eligible.schema[c].dataType).alias(c) for c in empty]))
    rows = rows.repartition(*spread, "segment").sortWithinPartitions("segment", F.col("n") == 0, *SERIES, *ORDER)
    return rows.select(*eligible.columns, "segment", "n").mapInPandas(sliding_stats, schema)
