"""Spend analyses over the observation view: filters, totals, rankings, insight lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import is_unresolved, reporting_label
from tillroll.functions.columns import month_of
from tillroll.functions.identity import trimmed_identity


def apply_filters(obs: DataFrame, start: str | None = None, end: str | None = None, store: str | None = None,
                  category: str | None = None, item: str | None = None, strict_reference: bool = False) -> DataFrame:
    """Optional filters, all of which must hold; both dates are inclusive."""
    tests: list[Column] = []
    if start:
        tests.append(F.col("date") >= start)
    if end:
        tests.append(F.col("date") <= end)
    if store:
        tests.append(F.lower("store") == store.lower())
    if category:
        wanted = category.strip().lower()
        wanted = V.LEGACY_CATEGORIES.get(wanted, wanted)
        stored = F.col("category")
        tests.append(is_unresolved(stored, strict_reference) if wanted == V.UNRESOLVED
                     else F.lower(F.trim(stored)) == wanted)
    if item:
        tests.append(F.col("identity").ilike(f"%{item}%") | F.col("name").ilike(f"%{item}%"))
    for test in tests:
        obs = obs.where(test)
    return obs


def money(column) -> Column:
    return F.round(F.coalesce(column, F.lit(0)), 2).cast("double")


def category_spend(obs: DataFrame) -> DataFrame:
    return obs.groupBy(reporting_label(F.coalesce("category", F.lit("прочее"))).alias("category")).agg(
        F.sum("price").alias("_spend")).select("category", money(F.col("_spend")).alias("spend"))


def monthly_spend(obs: DataFrame) -> DataFrame:
    """A date that does not parse keeps its own group, month NULL."""
    return obs.groupBy(month_of(F.col("date")).alias("month")).agg(money(F.sum("price")).alias("spend"))


def top_products(obs: DataFrame, n: int = 10) -> DataFrame:
    return obs.groupBy("identity").agg(F.sum("price").alias("_s")).orderBy(F.desc("_s"), "identity").limit(n).select(
        "identity", money(F.col("_s")).alias("spend"))


def spend_totals(obs: DataFrame) -> DataFrame:
    """Total, receipts and the mean month from one pass over the lines."""
    by_receipt = obs.groupBy("receipt_id", month_of(F.col("date")).alias("month")).agg(F.sum("price").alias("s"))
    by_month = by_receipt.groupBy("month").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    return by_month.agg(
        money(F.sum("s")).alias("total_spent"), F.coalesce(F.sum("n"), F.lit(0)).alias("receipt_count"),
        F.count("*").alias("month_count"),
        F.round(F.try_divide(F.sum("s"), F.count("*")).cast("decimal(38,6)"), 2).cast("double").alias("monthly_average"))


def insight_lines(obs: DataFrame) -> DataFrame:
    """At most three typed lines: coverage, the last change or the only month, the largest share."""
    by_receipt = obs.groupBy(
        "receipt_id", month_of(F.col("date")).alias("month"),
        reporting_label(F.coalesce("category", F.lit("прочее"))).alias("category")).agg(F.sum("price").alias("s"))
    months = by_receipt.groupBy("month").agg(F.sum("s").alias("s"))
    # A handful of months: the two latest decide, so two maxima replace an ordered window.
    latest = F.array_sort(F.collect_list(F.struct(F.coalesce("month", F.lit("")).alias("m"), "s")))
    summary = months.agg(F.count("*").alias("n"), latest.alias("ms"), F.sum("s").alias("total")).select(
        "n", "total", F.try_element_at("ms", F.lit(-1)).alias("cur"),
        F.when(F.col("n") > 1, F.try_element_at("ms", F.lit(-2))).alias("prev"))
    receipts = by_receipt.select("receipt_id").distinct().agg(F.count("*").alias("receipt_count"))
    best = by_receipt.groupBy("category").agg(F.sum("s").alias("s")).orderBy(F.desc("s"), "category").limit(1)
    summary = summary.withColumn("receipt_count", receipts.scalar())
    change = F.round(F.try_divide((F.col("cur.s") - F.col("prev.s")) * 100, F.col("prev.s")).cast("decimal(38,8)"), 1)
    line = F.struct
    none_s, none_d, none_l = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def row(number, kind, month=none_s, subject=none_s, value=none_d, percent=none_d, count=none_l):
        return line(F.lit(number).cast("bigint").alias("line_no"), kind.alias("type"), month.alias("month"),
                    subject.alias("subject"), value.cast("double").alias("amount"),
                    percent.cast("double").alias("percent"), count.cast("bigint").alias("n"))

    direction = F.when(F.abs(change) < 0.05, "unchanged").when(change > 0, "increased").otherwise("decreased")
    second = F.when(F.col("n") < 2, row(2, F.lit("peak_month"), F.col("cur.m"), none_s, F.round("cur.s", 2))).when(
        F.col("prev.s") > 0, row(2, F.lit("month_change"), F.col("cur.m"), direction, none_d, F.abs(change))).otherwise(
        row(2, F.lit("comparison_unavailable"), F.col("cur.m"), F.lit("zero_baseline")))
    first = row(1, F.lit("coverage"), count=F.col("n"), value=F.col("receipt_count"))
    head = summary.where("n > 0").select(F.explode(F.array(first, second)).alias("r")).select("r.*")
    total = summary.select("total").scalar()
    largest = best.withColumn("total", total).where("total > 0").select(row(
        3, F.lit("largest_category"), subject=F.col("category"), value=F.round("s", 2),
        percent=F.round((F.col("s") * 100 / F.col("total")).cast("decimal(38,8)"), 1)).alias("r")).select("r.*")
    product = obs.groupBy("identity").agg(F.sum("price").alias("s")).orderBy(F.desc("s"), "identity").limit(1)
    fallback = product.withColumn("total", total).where("coalesce(total, 0) <= 0").select(row(
        3, F.lit("top_product"), subject=F.col("identity"), value=F.round("s", 2)).alias("r")).select("r.*")
    return head.unionByName(largest).unionByName(fallback)


# --- the sample reports -------------------------------------------------------------------

def receipt_spend_by_month(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy(F.substring("date", 1, 7).alias("month")).agg(money(F.sum("total")).alias("spend_eur"))


def stored_category_spend(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(money(F.sum(F.coalesce("line_total", "price"))).alias("spend_eur"))


def average_price_by_store(obs: DataFrame) -> DataFrame:
    priced = obs.where("normalized_unit_price > 0").withColumn("product", trimmed_identity())
    return priced.groupBy("product", "store", "normalized_price_unit").agg(
        F.sum("normalized_unit_price").alias("_s"), F.count("*").alias("observations")).select(
        "product", "store", "normalized_price_unit", "observations",
        F.round(F.try_divide("_s", "observations").cast("decimal(38,8)"), 4).cast("double").alias("average_price"))


def price_history(obs: DataFrame) -> DataFrame:
    return obs.where("normalized_unit_price > 0").select(
        "date", trimmed_identity().alias("product"), "store",
        F.col("normalized_unit_price").cast("double").alias("normalized_unit_price"),
        "normalized_price_unit").orderBy("product", F.desc("date"))


def recurring_products(items: DataFrame) -> DataFrame:
    return items.select(trimmed_identity().alias("product"), "receipt_id").distinct().groupBy("product").agg(
        F.count("*").alias("receipts")).where("receipts > 1")


def evidence_distribution(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("price_parse_source", F.lit("missing")).alias("source"),
                         F.col("price_parse_confidence").cast("double").alias("confidence")).agg(
        F.count("*").alias("items"))


def total_spent(receipts: DataFrame) -> DataFrame:
    return receipts.agg(money(F.sum("total")).alias("total_spent"))
