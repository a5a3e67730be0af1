"""As-of lookup against brute force, however the rows are cut into segments."""

import random

import pytest

from tillroll.operators.asof import asof_backward

LEFT = "k string, t int, n long"
RIGHT = "k string, t int, v long"


def brute(left, right, inclusive):
    out = []
    for k, t, n in left:
        prior = [(u, v) for j, u, v in right if None not in (k, t, j, u) and j == k and (u < t or (inclusive and u == t))]
        out.append((k, t, n, max(prior, key=lambda p: (p[0], p[1] is not None, p[1] or 0))[1] if prior else None))
    return sorted(out, key=str)


def found(spark, left, right, inclusive, segments):
    df = asof_backward(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], ["t"], ["v"],
                       inclusive=inclusive, segments=segments)
    return sorted([(r.k, r.t, r.n, r.found and r.found.v) for r in df.collect()], key=str)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("segments", [1, 3, 40])
def test_equals_brute_force(spark, segments, inclusive):
    rng = random.Random(segments)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(30)]), i) for i in range(150)]
    right = [(key(), rng.choice([None, *range(30)]), rng.choice([None, *range(5)])) for _ in range(60)]
    assert found(spark, left, right, inclusive, segments) == brute(left, right, inclusive)


def test_one_early_row_reaches_over_many_segments(spark):
    left = [("a", t, t) for t in range(1, 400)] + [("b", 1, 0)]
    assert found(spark, left, [("a", 0, 7)], False, 30) == brute(left, [("a", 0, 7)], False)


def test_empty_sides(spark):
    assert found(spark, [], [("a", 0, 1)], False, 2) == []
    assert found(spark, [("a", 0, 1)], [], False, 2) == [("a", 0, 1, None)]


def test_values_may_be_named_like_left_columns(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], RIGHT)
    got = asof_backward(rows, rows, ["k"], ["t"], ["v", "t"]).orderBy("t").collect()
    assert got[0].found is None and (got[1].v, got[1].found.v, got[1].found.t) == (6, 5, 1)
