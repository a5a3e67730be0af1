"""Period dashboard: summary, trend, category changes, receipt register, month summary."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import is_legacy, reporting_label
from tillroll.functions.columns import iso_date, literal_map, month_of
from tillroll.functions.evidence import requires_review
from tillroll.functions.periods import Period, days_in_month, in_range
from tillroll.operators.asof import asof_backward
from tillroll.operators.observations import of_receipts, paid
from tillroll.plans.spend import money
from tillroll.session import stored


def period_summary(receipts: DataFrame, period: Period, as_of: date) -> DataFrame:
    """Spend and receipts of both ranges from one scan, with change and simple forecast."""
    now, before = period.current(), period.previous()
    sums = receipts.where(now | before).agg(
        F.coalesce(F.sum(F.when(now, F.col("total"))), F.lit(0)).alias("s"),
        F.count_if(now).alias("receipt_count"),
        F.coalesce(F.sum(F.when(before, F.col("total"))), F.lit(0)).alias("p"),
        F.count_if(before).alias("previous_receipt_count"))
    has = F.lit(period.has_previous)
    delta = F.col("s") - F.col("p")
    run_rate = F.lit(period.key == "current_month" and as_of.day >= 7) & (F.col("receipt_count") >= 3)
    return sums.select(
        money(F.col("s")).alias("spend"), "receipt_count",
        F.when(has, money(F.col("p"))).alias("previous_spend"),
        F.when(has, F.col("previous_receipt_count")).otherwise(0).alias("previous_receipt_count"),
        F.when(has, money(delta)).alias("absolute_delta"),
        F.when(has & (F.col("p") != 0), F.round((delta * 100 / F.col("p")).cast("decimal(38,8)"), 1).cast("double")).alias("percentage_delta"),
        F.when(run_rate, F.round((F.col("s") * days_in_month(as_of) / as_of.day).cast("decimal(38,8)"), 2).cast("double")).alias("forecast"))


def meaningful_change(delta: Column, percent: Column, previous_count: Column) -> Column:
    return (previous_count > 0) & (F.abs(delta) >= 5) & (F.abs(F.coalesce(percent, F.lit(0))) >= 5)


def daily_trend(receipts: DataFrame, period: Period) -> DataFrame:
    """One row per calendar day; the spine is bounded by the period, empty days are 0."""
    spend = receipts.where(period.current()).groupBy("date").agg(F.sum("total").alias("_s"))
    days = receipts.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(period.start), F.date_sub(F.lit(period.end), 1))).alias("day")).select(
        F.date_format("day", "yyyy-MM-dd").alias("date"))
    return days.join(spend, "date", "left").select("date", money(F.col("_s")).alias("spend"))


def monthly_trend(receipts: DataFrame, period: Period) -> DataFrame:
    return receipts.where(period.current()).groupBy(month_of(F.col("date")).alias("month")).agg(
        money(F.sum("total")).alias("spend"))


def months_available(receipts: DataFrame) -> DataFrame:
    return receipts.where(iso_date(F.col("date")).isNotNull()).groupBy(month_of(F.col("date")).alias("month")).agg(
        F.count("*").alias("receipt_count"))


def category_changes(obs: DataFrame, period: Period, n: int = 5) -> DataFrame:
    """Largest category movements; both ranges are summed in one pass."""
    now, before = period.current(), period.previous()
    sums = obs.where(now | before).groupBy(reporting_label(F.col("category")).alias("category")).agg(
        F.coalesce(F.sum(F.when(now, paid())), F.lit(0)).alias("c"),
        F.coalesce(F.sum(F.when(before, paid())), F.lit(0)).alias("p")).withColumn("d", F.col("c") - F.col("p"))
    top = sums.orderBy(F.abs("d").desc(), F.desc("c"), "category").limit(n)
    largest = F.max(F.abs("d")).over(W.partitionBy(F.lit(1)))  # over the n rows kept
    return top.withColumn("largest", largest).select(
        "category", money(F.col("c")).alias("current"), money(F.col("p")).alias("previous"),
        money(F.col("d")).alias("delta"),
        F.when(F.col("largest") > 0, F.round((F.abs("d") * 100 / F.col("largest")).cast("decimal(38,8)"), 1))
        .otherwise(0).cast("double").alias("magnitude_percent"))


def receipt_register(receipts: DataFrame, items: DataFrame, period: Period, store_search: str = "",
                     n: int | None = None) -> DataFrame:
    """Receipts of the period, newest first, with line and warning counts."""
    chosen = receipts.where(period.current())
    if store_search:
        chosen = chosen.where(F.lower("store").like(f"%{store_search.lower()}%"))
    if n is not None:
        chosen = chosen.orderBy(F.desc("date"), F.desc("id")).limit(n)
    lines = of_receipts(items, chosen.select(F.col("id").alias("receipt_id")))
    counts = lines.groupBy("receipt_id").agg(
        F.count("*").alias("item_count"), F.count_if(requires_review()).alias("price_warning_count"))
    return chosen.join(counts, chosen.id == counts.receipt_id, "left").select(
        F.col("id").alias("receipt_id"), "receipt_number", "date", "store", money(F.col("total")).alias("total"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("price_warning_count", F.lit(0)).alias("price_warning_count")).orderBy(
        F.desc("date"), F.desc("receipt_id"))


def sort_register(register: DataFrame, key: str = "receipt_id", descending: bool = False) -> DataFrame:
    if key not in ("receipt_id", "date", "total"):
        raise ValueError(f"cannot sort by {key}")
    return register.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "receipt_id")


def register_totals(register: DataFrame) -> DataFrame:
    return register.agg(money(F.sum(F.col("total").cast("decimal(14,2)"))).alias("total"),
                        F.coalesce(F.sum("item_count"), F.lit(0)).alias("item_count"),
                        F.count("*").alias("receipt_count"))


def receipt_previews(register: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """First lines of the receipts shown. The rank limit already applies before the shuffle."""
    rank = F.row_number().over(W.partitionBy("receipt_id").orderBy("id"))
    shown = of_receipts(items, register)
    return shown.withColumn("line_no", rank).where(F.col("line_no") <= n).select(
        "receipt_id", F.col("line_no").cast("bigint").alias("line_no"), "name",
        F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"),
        money(F.col("price")).alias("price"), reporting_label(F.col("category")).alias("category"),
        F.coalesce("category_source", F.lit("rule")).alias("category_source"),
        requires_review().alias("has_price_warning"))


def comma_number(value: Column, decimals: int) -> Column:
    return F.translate(F.format_string(f"%.{decimals}f", value.cast("double")), ".", ",")


def receipt_lines(items: DataFrame) -> DataFrame:
    """Detail rows of every receipt in line order, with the quantity and price text."""
    total = F.coalesce("line_total", "price", F.lit(0))
    unit = F.coalesce("quantity_unit", F.lit("unknown"))
    end = F.concat(F.lit("итого "), comma_number(total, 2), F.lit(" €"))
    plain = F.translate(F.regexp_replace(F.regexp_replace(F.col("quantity").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), ".", ",")
    sign = F.when(unit == "kg", "кг").otherwise("л")
    text = F.when((unit == "piece") & F.col("unit_price").isNotNull(), F.concat(
        plain, F.lit(" шт. · "), comma_number(F.col("unit_price"), 2), F.lit(" €/шт. · "), end)).when(
        unit.isin("kg", "l") & F.col("unit_price").isNotNull(), F.concat(
            comma_number(F.col("quantity"), 3), F.lit(" "), sign, F.lit(" · "),
            comma_number(F.col("unit_price"), 2), F.lit(" €/"), sign, F.lit(" · "), end)).otherwise(end)
    source = F.coalesce("category_source", F.lit("rule"))
    return items.select(
        "receipt_id", F.col("id").cast("string").alias("line_id"), "name",
        total.cast("double").alias("paid"), text.alias("price_text"),
        reporting_label(F.col("category")).alias("category"),
        F.when(is_legacy(F.col("category")), F.trim("category")).alias("legacy_category"),
        F.coalesce(F.try_element_at(literal_map(V.CATEGORY_SOURCES), source), source).alias("category_source"),
        requires_review().alias("needs_review"))


def month_window(as_of: date, period: Period | None = None) -> tuple[date, date, bool]:
    if period is not None and period.key.startswith("month:") and period.start:
        return period.start, period.end, True
    return as_of.replace(day=1), date.fromordinal(as_of.toordinal() + 1), False


def month_summary(receipts: DataFrame, items: DataFrame, as_of: date, period: Period | None = None) -> DataFrame:
    """Receipt sums and line counts, aggregated apart so that lines do not multiply receipts."""
    start, end, selected = month_window(as_of, period)
    chosen = receipts.where(in_range(F.col("date"), start, end))
    lines = of_receipts(items, chosen.select(F.col("id").alias("receipt_id"))).groupBy("receipt_id").agg(F.count("*").alias("lines"))
    per_receipt = chosen.join(lines, chosen.id == lines.receipt_id, "left")
    sums = per_receipt.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("s"), F.count("*").alias("receipt_count"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("item_line_count"), F.max("date").alias("latest_receipt_date"))
    age = F.datediff(F.lit(as_of), iso_date(F.col("latest_receipt_date")))
    reasons = F.lit("completed_month") if selected else F.concat_ws(
        ",", *([F.lit("less_than_7_elapsed_days")] if as_of.day < 7 else []),
        F.when(F.col("receipt_count") < 3, "less_than_3_receipts"),
        F.when(F.col("item_line_count") < 10, "less_than_10_item_lines"),
        F.when(F.col("latest_receipt_date").isNull(), "no_current_month_receipts").when(
            F.coalesce(age > 3, F.lit(True)), "latest_receipt_older_than_3_days"))
    last = days_in_month(start if selected else as_of)
    return sums.withColumn("reasons", reasons).select(
        F.lit(start.isoformat()[:7]).alias("month"), money(F.col("s")).alias("spend"), "receipt_count",
        "item_line_count", "latest_receipt_date", "reasons", (F.col("reasons") == "").alias("eligible"),
        F.when(F.col("reasons") == "", F.round((F.col("s") * last / as_of.day).cast("decimal(38,8)"), 2).cast("double")).alias("forecast"))


def month_products(sold: DataFrame, as_of: date, period: Period | None = None, n: int | None = None) -> DataFrame:
    """Spend and purchases of the month by product, of the `n` products with most spend if given."""
    start, end, _ = month_window(as_of, period)
    sums = sold.where(in_range(F.col("date"), start, end)).groupBy("identity").agg(
        F.sum(paid()).alias("s"), F.count("*").alias("purchase_count"))
    return sums if n is None else sums.orderBy(F.desc("s"), F.desc("purchase_count"), F.lower("identity"), "identity").limit(n)


def comparable_prices(obs: DataFrame) -> DataFrame:
    """Lines with a price per unit, as the as-of lookups need them."""
    return obs.where((F.col("normalized_unit_price") > 0) & F.col("normalized_price_unit").isin(V.ELIGIBLE_UNITS)).select(
        "identity", "normalized_price_unit", "date", "receipt_id", "id", "normalized_unit_price")


def percent_change(price: Column, before: Column) -> Column:
    return F.round(((price - before) * 100 / before).cast("decimal(38,8)"), 1).cast("double")


PRICE_SERIES, PRICE_ORDER = ["identity", "normalized_price_unit"], ["date", "receipt_id", "id"]


def price_context(obs: DataFrame, bought: DataFrame, as_of: date, period: Period | None = None) -> DataFrame:
    """Products of the month (`month_products`), any number of them, with their latest price in
    the month and the one before it at the same unit. `obs` may hold the lines of these products only."""
    start, end, _ = month_window(as_of, period)
    prices = comparable_prices(obs).where(in_range(F.col("date"), None, end))
    latest = prices.where(F.col("date") >= start.isoformat()).groupBy("identity").agg(
        F.max(F.struct(*PRICE_ORDER, "normalized_unit_price", "normalized_price_unit")).alias("l")).select("identity", "l.*")
    known = asof_backward(latest, prices, PRICE_SERIES, PRICE_ORDER, ["normalized_unit_price"], "before").select(
        "identity", "normalized_unit_price", "normalized_price_unit", "before")
    return bought.join(known, "identity", "left").select(
        "identity", money(F.col("s")).alias("spend"), "purchase_count",
        F.round("normalized_unit_price", 2).cast("double").alias("latest_price"), F.col("normalized_price_unit").alias("price_unit"),
        percent_change(F.col("normalized_unit_price"), F.col("before.normalized_unit_price")).alias("change_percent"))


def previous_prices(obs: DataFrame) -> DataFrame:
    """Every comparable line with the price of the same product and unit before it."""
    prices = stored(comparable_prices(obs))
    before = F.col("before.normalized_unit_price")
    return asof_backward(prices, prices, PRICE_SERIES, PRICE_ORDER, ["normalized_unit_price", "date"], "before").select(
        "identity", "normalized_price_unit", "receipt_id", F.col("id").cast("string").alias("line_id"),
        F.col("normalized_unit_price").cast("double").alias("price"), before.cast("double").alias("price_before"),
        F.col("before.date").alias("date_before"), percent_change(F.col("normalized_unit_price"), before).alias("change_percent"))


def briefing(summary: DataFrame, changes: DataFrame, urgent: DataFrame) -> DataFrame:
    """Decision and up to three findings. `urgent` has key, priority and n of severe operations."""
    s = summary.select(
        "*", (F.coalesce(F.col("previous_receipt_count"), F.lit(0)) > 0).alias("has_baseline"),
        meaningful_change(F.col("absolute_delta"), F.col("percentage_delta"), F.col("previous_receipt_count")).alias("changed"))
    leader = changes.orderBy(F.abs("delta").desc(), F.desc("current"), "category").limit(1).select(
        F.struct("category", "delta").alias("leader"))
    s = s.withColumn("leader", leader.scalar())
    visits = F.col("receipt_count") - F.col("previous_receipt_count")
    finding = lambda rank, key, subject, value: F.struct(
        F.lit(rank).cast("double").alias("rank"), F.lit(key).alias("finding"), subject.alias("subject"),
        value.cast("double").alias("value"))
    own = s.select(F.explode(F.array_compact(F.array(
        F.when(F.col("has_baseline") & (F.abs(F.col("leader.delta")) >= F.greatest(F.lit(5.0), F.col("previous_spend") * 0.05)),
               finding(0, "category_movement", F.col("leader.category"), F.col("leader.delta"))),
        F.when(F.col("has_baseline") & (visits != 0),
               finding(1, "visit_frequency", F.lit("receipts"), visits))))).alias("f")).select("f.*")
    severe = urgent.where("n > 0").select((F.col("priority") + 10).cast("double").alias("rank"), F.lit("operation").alias("finding"),
                                          F.col("key").alias("subject"), F.col("n").cast("double").alias("value"))
    findings = own.unionByName(severe).orderBy("rank").limit(3)
    count = findings.agg(F.count("*").alias("c"))
    s = s.withColumn("finding_count", count.scalar())
    quiet = (F.col("receipt_count") == 0) | (F.col("has_baseline") & ~F.col("changed") & (F.col("finding_count") == 0))
    decision = F.when(F.col("receipt_count") == 0, "empty").when(~F.col("has_baseline"), "no_baseline").when(
        ~F.col("changed"), "stable").otherwise("changed")
    head = s.select(F.lit(-1.0).alias("rank"), F.lit("decision").alias("finding"), decision.alias("subject"),
                    quiet.cast("double").alias("value"))
    return head.unionByName(findings)


