"""Price history of every product: deviation per line, monthly trend, stores, dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.columns import AMOUNT, day_number, e4, from_e4, month_of, not_blank
from tillroll.functions.evidence import evidence_category, with_ineligibility
from tillroll.operators.history import with_prior_prices
from tillroll.operators.medians import group_medians
from tillroll.plans.spend import money
from tillroll.session import stored

UNRESOLVED_IDENTITY = "unresolved_product_identity"


GRADED = ["identity", "normalized_price_unit", "dn", "date", "store", "receipt_id", "id", "price_e4", "manual", "reason"]


def graded(obs: DataFrame) -> DataFrame:
    """Observations with trimmed identity, day number, whole-number price and the reason
    against comparing them, apart from the identity of the whole product."""
    evidence = "evidence" if "evidence" in obs.columns else None
    return with_ineligibility(obs, evidence=evidence).withColumns({
        "identity": F.trim("identity"), "dn": day_number(F.col("date")),
        "price_e4": e4(F.col("normalized_unit_price")), "manual": not_blank(F.col("canonical_name"))})


def price_lines(obs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The graded lines, narrow and written once: every price job reads them several times."""
    return stored(graded(obs).select(*GRADED, *(carry or [])))


def with_identity_check(lines: DataFrame) -> DataFrame:
    """Flag products whose name is blank, listed as unresolved, or mixes manual and raw names.

    The flags of a product are two aggregates; only offending products are joined back,
    and AQE broadcasts them when they are few.
    """
    mixed = lines.groupBy("identity").agg(F.bool_or("manual").alias("m"), F.bool_and("manual").alias("a")).where(
        (F.col("m") != F.col("a")) | (F.col("identity") == "") | F.col("identity").isin(V.UNRESOLVED_IDENTITIES))
    return lines.join(mixed.select("identity", F.lit(True).alias("_mixed")), "identity", "left").withColumn(
        "unresolved", F.coalesce("_mixed", F.lit(False))).drop("_mixed")


def status_of(price: Column, median_x2: Column) -> Column:
    """Exact: percent of deviation compared as whole numbers, both limits inclusive."""
    change = (price.cast("decimal(20,0)") * 2 - median_x2) * 100
    return F.when(change <= median_x2.cast("decimal(20,0)") * V.CHEAPER_PERCENT, "CHEAPER_THAN_USUAL").when(
        change >= median_x2.cast("decimal(20,0)") * V.EXPENSIVE_PERCENT, "MORE_EXPENSIVE_THAN_USUAL").otherwise("NORMAL")


def deviation_percent(price: Column, median_x2: Column) -> Column:
    return F.round(((price.cast("decimal(20,0)") * 2 - median_x2) * 100).cast("decimal(28,0)")
                   / median_x2.cast("decimal(20,0)"), 1).cast("double")


def price_deviation(lines: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every line against the median of its earlier comparable prices, or the reason why not."""
    carry = carry or []
    lines = with_identity_check(lines).withColumn("reason", F.when(
        F.col("unresolved"), UNRESOLVED_IDENTITY).when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("dn").isNull(), "invalid_date_or_ordering"))
    keep = ["identity", "normalized_price_unit", "dn", "receipt_id", "id", "price_e4", *carry]
    stats = with_prior_prices(lines.where("reason IS NULL").select(*keep))
    enough = F.col("prior_count") >= V.MIN_PRIOR_PRICES
    price, median = F.col("price_e4"), F.col("median_x2")
    judged = stats.select(
        *keep, F.when(enough, status_of(price, median)).otherwise("INSUFFICIENT_HISTORY").alias("status"),
        F.when(~enough, "insufficient_prior_history").alias("reason"),
        F.when(enough, median).alias("median_x2"), F.when(enough, F.col("prior_min")).alias("prior_min"),
        F.when(enough, F.col("prior_max")).alias("prior_max"),
        F.when(enough, deviation_percent(price, median)).alias("deviation_percent"), "prior_count")
    rest = lines.where("reason IS NOT NULL").select(
        *keep, F.lit("INSUFFICIENT_HISTORY").alias("status"), "reason", *[
            F.lit(None).cast("bigint").alias(c) for c in ("median_x2", "prior_min", "prior_max")],
        F.lit(None).cast("double").alias("deviation_percent"), F.lit(0).cast("bigint").alias("prior_count"))
    return judged.unionByName(rest)


def deviation_report(deviation: DataFrame) -> DataFrame:
    """Reader's form: prices as numbers, the strength and class of the evidence."""
    short = F.col("status") == "INSUFFICIENT_HISTORY"
    waiting = F.col("reason") == "insufficient_prior_history"
    return deviation.select(
        "identity", "receipt_id", F.col("id").cast("string").alias("line_id"), "status", "reason",
        "normalized_price_unit", from_e4(F.col("price_e4")).cast("double").alias("price"),
        (F.col("median_x2") / 20000.0).alias("median_price"),
        from_e4(F.col("prior_min")).cast("double").alias("min_price"),
        from_e4(F.col("prior_max")).cast("double").alias("max_price"), "deviation_percent", "prior_count",
        F.when(short, "INSUFFICIENT").otherwise("SUFFICIENT").alias("evidence_strength"),
        F.when(short, evidence_category(F.col("reason"))).alias("evidence"),
        F.when(waiting, F.greatest(F.lit(0), V.MIN_PRIOR_PRICES - F.col("prior_count"))).alias("remaining"))


def receipt_price_summary(deviation: DataFrame) -> DataFrame:
    status = F.col("status")
    return deviation.groupBy("receipt_id").agg(
        F.count("*").alias("total_items"), F.count_if(status == "CHEAPER_THAN_USUAL").alias("cheap"),
        F.count_if(status == "MORE_EXPENSIVE_THAN_USUAL").alias("expensive"),
        F.count_if(status == "INSUFFICIENT_HISTORY").alias("insufficient"))


def evidence_summary(deviation: DataFrame) -> DataFrame:
    return deviation.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("lines"), F.sum("prior_count").alias("prior_prices"))


def _product_units(lines: DataFrame) -> DataFrame:
    """Per product: identity flags and the number of units among comparable lines."""
    eligible = F.col("reason").isNull()
    unit = F.when(eligible, F.col("normalized_price_unit"))
    return lines.groupBy("identity").agg(
        ((F.bool_or("manual") != F.bool_and("manual")) | (F.first("identity") == "")
         | F.first("identity").isin(V.UNRESOLVED_IDENTITIES)).alias("unresolved"),
        F.min(unit).alias("unit_a"), F.max(unit).alias("unit_b"),
        F.count_if(eligible & F.col("dn").isNotNull()).alias("dated"),
        F.min(F.when(not_blank(F.col("store")), F.trim("store"))).alias("store_a"),
        F.max(F.when(not_blank(F.col("store")), F.trim("store"))).alias("store_b"))


def price_trend(lines: DataFrame) -> DataFrame:
    """Monthly median per product, or one row with the reason why there is none."""
    products = _product_units(lines).withColumn("reason", F.when(F.col("unresolved"), UNRESOLVED_IDENTITY).when(
        F.col("unit_a") != F.col("unit_b"), "incompatible_price_units").when(
        F.col("dated") == 0, "no_comparable_history"))
    months = group_medians(
        lines.where("reason IS NULL AND dn IS NOT NULL").withColumn("month", month_of(F.col("date"))),
        ["identity", "normalized_price_unit", "month"], "price_e4").select(
        "identity", "normalized_price_unit", "month", "median_x2", "observations")
    ready = months.join(products.where("reason IS NULL").select("identity"), "identity", "left_semi")
    value = F.round(F.col("median_x2").cast("decimal(20,0)") / F.lit(20000).cast("decimal(5,0)"), 4).cast("double")
    return ready.select("identity", F.lit(None).cast("string").alias("reason"), "month", value.alias("median_price"),
                        F.col("observations").alias("observation_count"), "normalized_price_unit").unionByName(
        products.where("reason IS NOT NULL").select(
            "identity", "reason", F.lit(None).cast("string").alias("month"), F.lit(None).cast("double").alias("median_price"),
            F.lit(0).cast("bigint").alias("observation_count"), F.lit(None).cast("string").alias("normalized_price_unit")))


def store_levels(lines: DataFrame) -> DataFrame:
    """Median, range, count and latest date of every product and store."""
    levels = group_medians(
        lines.where("reason IS NULL").withColumn("store", F.trim("store")),
        ["identity", "normalized_price_unit", "store"], "price_e4", ("latest_date", F.max, "date"))
    rounded = F.round(F.col("median_x2").cast("decimal(20,0)") / F.lit(20000).cast("decimal(5,0)"), 4).cast(AMOUNT)
    return levels.select("identity", "normalized_price_unit", "store", rounded.alias("median_price"),
                         from_e4(F.col("least")).alias("min_price"), from_e4(F.col("greatest")).alias("max_price"),
                         F.col("observations").alias("observation_count"), "latest_date")


def store_comparison(lines: DataFrame) -> DataFrame:
    """Cheapest store per product, as strong as the evidence allows, or the reason why none.

    The two cheapest stores come from two ordered minima, not from a ranked list.
    """
    products = _product_units(lines)
    order = F.struct("median_price", F.lower("store").alias("folded"), "store")
    levels = store_levels(lines).withColumn("o", order)
    firsts = levels.groupBy("identity").agg(
        F.min("o").alias("a"), F.count("*").alias("stores"), F.min("observation_count").alias("fewest"))
    seconds = levels.join(firsts.select("identity", "a"), "identity").where(F.col("o") > F.col("a")).groupBy(
        "identity").agg(F.min("o").alias("b"))
    ranked = products.join(firsts, "identity", "left").join(seconds, "identity", "left")
    reason = F.when(F.col("unresolved"), UNRESOLVED_IDENTITY).when(
        F.col("unit_a") != F.col("unit_b"), "incompatible_price_units").when(
        F.coalesce("stores", F.lit(0)) < 2,
        F.when(F.coalesce(F.col("store_a") != F.col("store_b"), F.lit(False)), "insufficient_comparable_prices")
        .otherwise("only_one_store"))
    ranked = ranked.withColumn("reason", reason)
    level = F.when(F.col("reason").isNull(), F.when(F.col("fewest") >= 3, "COMPARABLE").when(
        F.col("fewest") >= 2, "LIMITED").otherwise("PRELIMINARY"))
    tie = F.col("reason").isNull() & (F.col("a.median_price") == F.col("b.median_price"))
    ranked = ranked.withColumns({"evidence_level": level, "is_tie": F.coalesce(tie, F.lit(False))})
    claim = F.col("reason").isNull() & (F.col("evidence_level") != "PRELIMINARY") & ~F.col("is_tie")
    return ranked.select(
        "identity", "reason", "evidence_level", "is_tie",
        F.when(F.col("reason").isNull(), F.col("unit_a")).alias("normalized_price_unit"),
        F.when(F.col("reason").isNull(), F.col("stores")).otherwise(0).alias("store_count"),
        F.when(claim, F.col("a.store")).alias("cheapest_store"), F.when(claim, F.col("b.store")).alias("comparison_store"),
        F.when(claim, F.round(((F.col("b.median_price") - F.col("a.median_price")) * 100).cast("decimal(24,4)")
                              / F.col("b.median_price"), 1).cast("double")).alias("difference_percent"),
        (claim & (F.col("evidence_level") == "COMPARABLE")).alias("strong_claim_allowed"))


def product_dossier(obs: DataFrame) -> DataFrame:
    """One row per product: totals, receipts, aliases, stores and the latest price model."""
    cost = F.coalesce("line_total", "price")
    latest = F.max_by(F.struct(
        F.coalesce("line_total", "price").alias("line_total"), "unit_price", "package_size", "package_unit",
        "normalized_unit_price", "normalized_price_unit", "price_parse_source", "price_parse_confidence", "date"),
        F.struct("date", "receipt_id", "id"))
    sums = obs.groupBy("identity").agg(
        F.count("*").alias("lines"), F.sum(cost).alias("s"), latest.alias("l"), F.countDistinct("receipt_id").alias("receipts"),
        F.countDistinct("name").alias("aliases"), F.countDistinct("store").alias("stores"))
    return sums.select(
        "identity", "lines", money(F.col("s")).alias("total_paid"), "receipts", "aliases", "stores",
        F.col("l.date").alias("latest_date"), F.col("l.line_total").cast("double").alias("latest_total"),
        F.col("l.unit_price").cast("double").alias("latest_unit_price"),
        F.col("l.normalized_unit_price").cast("double").alias("latest_price"),
        F.col("l.normalized_price_unit").alias("latest_price_unit"), F.col("l.price_parse_source").alias("latest_source"))


def dossier_stores(obs: DataFrame) -> DataFrame:
    return obs.groupBy("identity", "store").agg(
        F.count("*").alias("lines"), money(F.sum(F.coalesce("line_total", "price"))).alias("paid"))


def dossier_aliases(obs: DataFrame) -> DataFrame:
    return obs.select("identity", F.col("name").alias("alias")).distinct()


def rank_stores(levels: DataFrame) -> DataFrame:
    """Store order within a product, cheapest first; a product has as many rows as stores."""
    order = W.partitionBy("identity", "normalized_price_unit").orderBy("median_price", F.lower("store"), "store")
    return levels.withColumn("position", F.row_number().over(order).cast("bigint"))
