"""Two versions of a table: row status, changed fields, equality, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_KEY = ["receipt_id", "id"]
#: Key buckets a version is summed by; the bound of every table of checksums.
BUCKETS = 4096


def changed_fields(fields: list[str], old: str, new: str) -> Column:
    """Names of the fields that differ, NULL counting as a value."""
    return F.array_compact(F.array(*[
        F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields]))


def table_diff(before: DataFrame, after: DataFrame, key: list[str] = LINE_KEY) -> DataFrame:
    """One row per key that was inserted, deleted or changed, with the changed fields."""
    fields = [c for c in before.columns if c not in key]
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("the two versions have different columns")
    old = before.withColumn("_in", F.lit(True)).alias("o")
    new = after.withColumn("_in", F.lit(True)).alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    status = F.when(F.col("o._in").isNull(), "inserted").when(F.col("n._in").isNull(), "deleted").otherwise("changed")
    rows = old.join(new, same, "full").select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key], status.alias("status"),
        F.when(status == "changed", changed_fields(fields, "o", "n")).alias("changed_fields"))
    return rows.where((F.col("status") != "changed") | (F.size("changed_fields") > 0))


def row_digest(columns: list[str], salt: int) -> Column:
    """64-bit digest of the columns; which of them are NULL counts, as a hash alone passes over NULL."""
    nulls = F.concat(F.lit(str(salt)), *[F.col(c).isNull().cast("string") for c in columns])
    return F.xxhash64(nulls, *columns)


def checksums(version: DataFrame, key: list[str] = LINE_KEY, buckets: int = BUCKETS) -> DataFrame:
    """Order-free checksums of a version: (bucket, n, a, b, c, d), one row per key bucket.

    The sums are those of the halves of two digests of whole rows, so each task adds up its
    own rows and at most `buckets` rows a task are shuffled. Stored beside a version they
    spare its comparison the scan. Rows with a NULL in the key are in bucket -1.
    """
    columns = sorted(version.columns)
    halves = [half for digest in ("_a", "_b") for half in (F.shiftright(digest, 32), F.col(digest).bitwiseAND(0xFFFFFFFF))]
    rows = version.select(_bucket(key, buckets).alias("bucket"), row_digest(columns, 1).alias("_a"), row_digest(columns, 2).alias("_b"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(h.cast("long")).alias(c) for h, c in zip(halves, "abcd")])


def _bucket(key: list[str], buckets: int) -> Column:
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return F.when(whole, F.pmod(F.xxhash64(*key), F.lit(buckets))).otherwise(F.lit(-1)).cast("int")


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Buckets whose checksums differ, and the one of keys with NULL, which match nothing."""
    both = before.join(after.select("bucket", F.struct("n", *"abcd").alias("other")), "bucket", "full")
    return both.where(~F.struct("n", *"abcd").eqNullSafe(F.col("other")) | (F.col("bucket") < 0)).select("bucket")


def sparse_diff(before: DataFrame, after: DataFrame, key: list[str] = LINE_KEY, sums: tuple[DataFrame, DataFrame] | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """`table_diff` of versions that differ little: only rows of differing buckets are joined.

    `sums` are the stored checksums of both versions, made with the same key and number of
    buckets; without them both are summed first. Keys are unique in a version. The result
    is that of `table_diff` but for collisions of 128 bits. Types of a column must agree,
    since digests of one value in two types are different or, worse, equal by chance.
    """
    if sorted(before.dtypes) != sorted(after.dtypes):
        raise ValueError("the two versions have different columns or types")
    left, right = sums or (checksums(before, key, buckets), checksums(after, key, buckets))
    changed = F.broadcast(changed_buckets(left, right))  # at most buckets + 1 rows
    chosen = [v.withColumn("bucket", _bucket(key, buckets)).join(changed, "bucket", "left_semi").drop("bucket") for v in (before, after)]
    return table_diff(*chosen, key=key)


def tables_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, counted; both zero means equal, duplicates included.

    Both versions are counted by two digests of whole rows in one shuffle, so a row moves as
    two numbers; the result is exact but for collisions of 128 bits.
    """
    fields = [f"_{i}" for i in range(len(before.columns))]
    rows = before.toDF(*fields).withColumn("side", F.lit(1)).union(after.toDF(*fields).withColumn("side", F.lit(-1)))
    more = rows.select(row_digest(fields, 1).alias("a"), row_digest(fields, 2).alias("b"), "side").groupBy("a", "b").agg(F.sum("side").alias("more"))
    side = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"))
    return more.agg(side(F.col("more")).alias("missing"), side(-F.col("more")).alias("added"))


def diff_violations(diff: DataFrame, plan: DataFrame, allowed: list[str], key: list[str] = LINE_KEY) -> DataFrame:
    """What a version changed beyond its plan, or planned and did not change."""
    planned = plan.select(*key).distinct().withColumn("_planned", F.lit(True))
    rows = diff.join(planned, key, "full")
    extra = F.array_except(F.coalesce("changed_fields", F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed]))
    problem = F.when(F.col("status").isNull(), "planned_but_unchanged").when(
        F.col("_planned").isNull(), "changed_but_unplanned").when(
        F.col("status") != "changed", F.concat(F.lit("row_"), F.col("status"))).when(F.size(extra) > 0, "field_out_of_scope")
    return rows.select(*key, problem.alias("violation")).where("violation IS NOT NULL")


def invariants(receipts: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics that a maintenance step must not move, as name and value."""
    identity = F.when(F.trim("canonical_name") != "", F.col("canonical_name")).otherwise(F.col("name"))
    spend = F.sum(F.coalesce("line_total", "price", F.lit(0))).cast("double")
    metric = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"))
    histogram = items.groupBy(F.concat(F.lit("category:"), F.coalesce("category", F.lit(""))).alias("metric")).agg(
        F.count("*").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [
        metric(receipts, "receipts", F.count("*")), metric(items, "items", F.count("*")),
        metric(rules, "rules", F.count("*")), metric(items, "identities", F.countDistinct(identity)),
        metric(items, "total_spend", spend), histogram])
