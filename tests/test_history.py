import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.operators import history
from tillroll.operators.history import with_prior_prices
from tillroll.operators.medians import group_medians


def brute(rows):
    out = {}
    for r in rows:
        prior = sorted(o[5] for o in rows if o[:2] == r[:2] and o[2] >= r[2] - 180 and o[2:5] < r[2:5])
        n = len(prior)
        out[r] = (n, prior[(n - 1) // 2] + prior[n // 2], prior[0], prior[-1]) if n else (0, None, None, None)
    return out


def check(spark, rows, segments):
    df = spark.createDataFrame(rows, "identity string, normalized_price_unit string, dn int, receipt_id long, id long, price_e4 long")
    got = {tuple(r[:6]): tuple(r[6:]) for r in with_prior_prices(df, segments).collect()}
    assert got == brute(rows)


def rows_of(seed, n, days, prices, products):
    rng = random.Random(seed)
    return list({(f"p{rng.randint(1, products)}", rng.choice(["eur_per_kg", "eur_per_l"]), rng.randint(0, days),
                  rng.randint(1, 6), i if seed % 2 else rng.randint(1, 3), rng.randint(1, prices)): 0
                 for i in range(n)})


def test_usual_series_equal_brute_force(spark):
    check(spark, rows_of(1, 300, 500, 10**8, 3), None)


def test_long_series_equal_brute_force(spark):
    check(spark, rows_of(3, 300, 400, 50, 2), 15)
    check(spark, rows_of(2, 250, 2, 10**6, 1), 25)  # days and receipts are cut, equal keys are not earlier
    check(spark, rows_of(5, 400, 900, 4, 1), 40)


def test_exactly_180_days_back_counts(spark):
    check(spark, [("a", "u", 0, 1, 1, 5), ("a", "u", 180, 1, 1, 7), ("a", "u", 181, 1, 1, 9)], 3)


def test_group_medians(spark):
    values = [("a", 1), ("a", 4), ("a", 4), ("a", 9), ("b", 3), ("b", 4)]
    out = group_medians(spark.createDataFrame(values, "k string, v long"), ["k"], "v", ("last", F.max, "v")).orderBy("k")
    assert [tuple(r) for r in out.collect()] == [("a", 8, 4, 1, 9, 9), ("b", 7, 2, 3, 4, 4)]


def test_one_series_of_half_the_lines_is_spread(spark):
    rows = [("hot" if i % 2 else f"p{i}", "u", i // 50, i % 7, i, i % 90) for i in range(4000)]
    df = spark.createDataFrame(rows, "identity string, normalized_price_unit string, dn int, receipt_id long, id long, price_e4 long")
    large = 2**62 + 1  # whole numbers stay whole
    df = df.withColumn("receipt_id", F.col("receipt_id") + F.lit(large))
    dealt = df.repartitionByRange(20, "identity", "normalized_price_unit", "dn", "receipt_id", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in dealt.collect()) < 2 * 4000 / 20
    assert {tuple(r) for r in with_prior_prices(df, 20).collect()} == {tuple(r) for r in with_prior_prices(df, 1).collect()}
    assert with_prior_prices(df, 20).agg(F.sum(F.col("receipt_id") - F.lit(large))).first()[0] == sum(r[3] for r in rows)


def test_ranks_of_windows_equal_sorting():
    rng = np.random.default_rng(1)
    ranks, weights = rng.integers(0, 37, 400), rng.integers(1, 4, 400)
    left = rng.integers(0, 399, 600)
    right = left + 1 + (rng.random(600) * (400 - left)).astype(int).clip(0, 399 - left)
    spelt = [np.sort(np.repeat(ranks[a:b], weights[a:b])) for a, b in zip(left, right)]
    k = np.array([rng.integers(1, len(s) + 1) for s in spelt])
    assert history.kth_ranks(ranks, weights, left, right, k).tolist() == [s[i - 1] for s, i in zip(spelt, k)]
    assert history.kth_ranks(np.zeros(3, int), np.ones(3, int), np.array([0]), np.array([3]), np.array([2])).tolist() == [0]


@pytest.mark.parametrize("block, batch", [(1, 1), (7, 3), (50, 11), (1 << 16, 40)])
def test_blocks_do_not_change_the_result(monkeypatch, block, batch):
    """Windows carried from block to block, equal keys across batches, and counts that come before a segment's lines."""
    monkeypatch.setattr(history, "BLOCK", block)
    rng = random.Random(block)
    rows = sorted((rng.choice("ab"), "u", rng.randint(0, 500), rng.randint(1, 3), rng.randint(1, 2), rng.randint(1, 9)) for _ in range(500))
    columns = ["identity", "normalized_price_unit", "dn", "receipt_id", "id", "price_e4"]
    cut = 230
    while rows[cut][:5] == rows[cut - 1][:5]:
        cut += 1
    frame = pd.DataFrame(rows, columns=columns).assign(segment=[int(i >= cut) for i in range(500)], n=0)
    counts = Counter((r[2], r[5]) for r in rows[:cut] if r[:2] == rows[cut][:2] and r[2] >= rows[cut][2] - 180)
    before = pd.DataFrame([(*rows[cut][:2], day, 0, 0, price, 1, n) for (day, price), n in sorted(counts.items())], columns=[*columns, "segment", "n"])
    frame = pd.concat([frame[:cut], before, frame[cut:]], ignore_index=True)
    got = pd.concat(history.sliding_stats(frame[i:i + batch] for i in range(0, len(frame), batch)))
    got = [tuple(None if v is pd.NA else int(v) for v in r) for r in got[["prior_count", "median_x2", "prior_min", "prior_max"]].itertuples(index=False)]
    want = []
    for r in rows:
        prior = sorted(o[5] for o in rows if o[:2] == r[:2] and o[2] >= r[2] - 180 and o[2:5] < r[2:5])
        m = len(prior)
        want.append((m, prior[(m - 1) // 2] + prior[m // 2], prior[0], prior[-1]) if m else (0, None, None, None))
    assert got == want
