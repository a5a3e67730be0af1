import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators.snapshots import changed_buckets, checksums, sparse_diff, table_diff, tables_equal
from tillroll.plans.quality import parser_examples

SCHEMA = "receipt_id long, id long, name string, price int, note string"


def version(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lines(n):
    return [(i // 3, i, f"n{i % 7}", None if i % 5 == 0 else i, None if i % 4 else "x") for i in range(n)]


def plain(df):
    return sorted((r.receipt_id, r.id, r.status, tuple(r.changed_fields or ())) for r in df.collect())


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_sparse_diff_is_the_full_one(spark, buckets):
    rng = random.Random(4)
    old = lines(400)
    new = [r if rng.random() > 0.05 else (*r[:2], "other", *r[3:]) for r in old if rng.random() > 0.03] + [(900, 1, "new", 1, None)]
    rng.shuffle(new)
    before, after = version(spark, old), version(spark, new).select("note", "id", "price", "receipt_id", "name")
    got = plain(sparse_diff(before, after, buckets=buckets))
    assert got == plain(table_diff(before, after)) and {s for _, _, s, _ in got} == {"changed", "deleted", "inserted"}


def test_a_value_that_moves_past_a_null_is_a_change(spark):
    old, new = version(spark, [(1, 1, "a", 1, None)]), version(spark, [(1, 1, None, 1, "a")])
    assert plain(sparse_diff(old, new)) == [(1, 1, "changed", ("name", "note"))]


def test_null_keys_empty_versions_and_other_types(spark):
    old = version(spark, [(None, 1, "a", 1, None), (1, 1, "a", 1, None)])
    assert sorted(map(str, sparse_diff(old, old).collect())) == sorted(map(str, table_diff(old, old).collect()))
    assert sparse_diff(old, old).count() == 2
    assert sparse_diff(old.limit(0), old.limit(0)).count() == 0
    assert plain(sparse_diff(old.limit(0), version(spark, lines(2)))) == [(0, 0, "inserted", ()), (0, 1, "inserted", ())]
    with pytest.raises(ValueError):
        sparse_diff(old, old.withColumn("price", F.col("price").cast("double")))


def test_equal_rows_on_one_side_do_not_cancel(spark):
    twice, other = version(spark, [(1, 1, "a", 1, None)] * 2), version(spark, [(1, 1, "b", 1, None)] * 2)
    assert changed_buckets(checksums(twice), checksums(other)).count() == 1
    assert changed_buckets(checksums(twice), checksums(twice.limit(1))).count() == 1
    assert changed_buckets(checksums(twice), checksums(twice)).count() == 0


def test_one_changed_line_compares_one_bucket(spark, tmp_path):
    old = lines(5000)
    versions = []
    for name, rows in (("old", old), ("new", old[:77] + [(*old[77][:2], "other", *old[77][3:])] + old[78:])):
        version(spark, rows).write.parquet(f"{tmp_path}/{name}")
        versions.append(spark.read.parquet(f"{tmp_path}/{name}"))
    sums = [checksums(v, buckets=500) for v in versions]
    assert changed_buckets(*sums).count() == 1
    assert plain(sparse_diff(*versions, sums=tuple(sums), buckets=500)) == [(old[77][0], 77, "changed", ("name",))]


def test_examples_are_the_first_lines_of_a_class(spark):
    rng = random.Random(2)
    classes = {"Kase Nr. 12": "cashier_line", "Rīsi 8x125g": "multipack", "Piens 1L": "unknown", "Siers": "unknown", None: "unknown"}
    rows = [(rng.randrange(40), i, rng.choice(list(classes))) for i in range(600)]
    got = parser_examples(spark.createDataFrame(rows, "receipt_id long, id long, name string"), 4).collect()
    for label in set(classes.values()):
        want = sorted((r, i, n or "") for r, i, n in rows if classes[n] == label)[:4]
        assert [(r.receipt_id, r.id, r.name) for r in sorted(got, key=lambda r: r["rank"]) if r.contamination == label] == want
    assert parser_examples(spark.createDataFrame([], "receipt_id long, id long, name string")).count() == 0


def test_versions_are_counted_as_by_multiset_difference_in_one_shuffle(spark):
    rng = random.Random(7)
    old = [r for r in lines(60) for _ in range(rng.randint(1, 3))] + [(None, 1, None, None, "x"), (None, 1, None, None, None)]
    new = [r for r in lines(70) for _ in range(rng.randint(0, 3))] + [(None, 1, "x", None, None)]
    before, after = version(spark, old), version(spark, new)
    found = tables_equal(before, after)
    assert [tuple(r) for r in found.collect()] == [(before.exceptAll(after).count(), after.exceptAll(before).count())]
    assert [tuple(r) for r in tables_equal(before, before).collect()] == [(0, 0)]
    assert [tuple(r) for r in tables_equal(before.limit(0), after.limit(0)).collect()] == [(0, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # what moves is two digests and a count, never a name or a note
    assert plan.count("hashpartitioning") == 1 and "name" not in plan.split("hashpartitioning")[1].split(")")[0]
