"""May a stored price be compared? Ordered reasons against it and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.columns import AMOUNT, first_true, is_blank, lookup
from tillroll.functions.price import derive_price, prices_differ


def _any(warnings: Column, names) -> Column:
    return F.arrays_overlap(warnings, F.array(*[F.lit(n) for n in names]))


def with_ineligibility(df: DataFrame, *, evidence: str | None = None, prefix: str = "",
                       out: str = "reason") -> DataFrame:
    """Add `out`: the first reason a stored price is not comparable, NULL when it is.

    `prefix` picks a nested record with the item fields, store and date stay top level.
    """
    def col(field):
        return F.col(prefix + field)

    keep = [c for c in df.columns if c != out]
    df = derive_price(
        df, evidence=evidence, quantity=col("quantity"), line_total=col("line_total"),
        unit_price=col("unit_price"), unit=col("quantity_unit"), package_size=col("package_size"),
        package_unit=col("package_unit"), source=col("price_parse_source"), out="_again")
    q, t, u, n, c = (col(f).cast(AMOUNT) for f in (
        "quantity", "line_total", "unit_price", "normalized_unit_price", "price_parse_confidence"))
    warnings = F.col("_again.warnings")
    reason = first_true([
        (n.isNull(), "missing_normalized_price"),
        (q.isNull() | t.isNull() | u.isNull() | c.isNull(), "missing_price_evidence"),
        ((q <= 0) | (t <= 0) | (u <= 0) | (n <= 0), "non_positive_price_evidence"),
        (n > V.MAX_NORMALIZED_PRICE, "normalized_price_out_of_range"),
        (c < F.lit(V.MIN_CONFIDENCE).cast("decimal(4,2)"), "low_confidence"),
        (~F.coalesce(col("normalized_price_unit").isin(V.ELIGIBLE_UNITS), F.lit(False)), "unsupported_unit"),
        (~F.coalesce(col("price_parse_source").isin(V.ELIGIBLE_SOURCES), F.lit(False)), "unsupported_source"),
        (is_blank(F.col("store")), "missing_store"),
        (is_blank(F.col("date")), "invalid_date"),
        (prices_differ(q, u, t), "arithmetic_mismatch"),
        (F.array_contains(warnings, "service_line"), "service_line"),
        (F.array_contains(warnings, "parser_contamination"), "parser_contamination"),
        (F.array_contains(warnings, "multipack_unresolved"), "unresolved_multipack"),
        (_any(warnings, V.AMBIGUOUS_PACKAGE_WARNINGS), "ambiguous_measurement"),
        (F.array_contains(warnings, "line_total_unit_price_mismatch"), "arithmetic_mismatch"),
        (_any(warnings, V.BLOCKING_WARNINGS), "blocked_price_diagnostic"),
    ])
    return df.select(*keep, reason.alias(out))


def evidence_category(reason: Column) -> Column:
    return lookup(V.EVIDENCE_BY_REASON, reason, V.EVIDENCE_DEFAULT)


def with_correctability(df: DataFrame, *, evidence: str | None = None) -> DataFrame:
    """Add `classification` and `classification_reason`: can a reviewer settle this line?"""
    keep = [c for c in df.columns if c not in ("classification", "classification_reason")]
    df = with_ineligibility(df, evidence=evidence, out="_reason")
    df = derive_price(df, evidence=evidence, out="_now")
    q, t, u, c = (F.col(f).cast(AMOUNT) for f in ("quantity", "line_total", "unit_price", "price_parse_confidence"))
    warnings = F.col("_now.warnings")
    reason = first_true([
        (F.col("_reason").isNull(), "already_safe"),
        (F.coalesce(q <= 0, F.lit(True)), "quantity_needs_parser"),
        (F.coalesce(t <= 0, F.lit(True)), "line_total_needs_receipt"),
        (F.coalesce(prices_differ(q, u, t), F.lit(False)), "arithmetic_needs_parser"),
        (F.array_contains(warnings, "parser_contamination"), "parser_contamination"),
        (F.array_contains(warnings, "multipack_unresolved"), "ambiguous_multipack"),
        (F.array_contains(warnings, "service_line"), "service_line"),
        (F.coalesce(c > F.lit(V.MANUAL_CONFIDENCE).cast("decimal(4,2)"), F.lit(False)), "stronger_evidence_exists"),
    ])
    return df.withColumn("classification_reason", reason).select(
        *keep,
        F.when(F.col("classification_reason") == "already_safe", "ALREADY_SAFE").when(
            F.col("classification_reason").isNull(), "CORRECTABLE_V1").otherwise("NOT_CORRECTABLE_V1").alias("classification"),
        "classification_reason")


def requires_review(confidence: str = "price_parse_confidence", price: str = "normalized_unit_price") -> Column:
    """Low or missing confidence, or a comparable price out of range."""
    return (F.col(confidence).isNull() | (F.col(confidence) < F.lit(V.MIN_CONFIDENCE).cast("decimal(4,2)"))
            | F.coalesce(suspicious_price(price), F.lit(False)))


def suspicious_price(price: str = "normalized_unit_price") -> Column:
    return (F.col(price) > V.MAX_NORMALIZED_PRICE) | (F.col(price) <= 0)


def low_confidence(confidence: str = "price_parse_confidence") -> Column:
    return F.col(confidence).isNull() | (F.col(confidence) < F.lit(V.MIN_CONFIDENCE).cast("decimal(4,2)"))


def arithmetic_mismatch() -> Column:
    """Stored quantity times unit price does not give the paid total."""
    paid = F.coalesce(F.col("line_total"), F.col("price"))
    return F.coalesce((F.col("quantity") > 0) & F.col("unit_price").isNotNull() & (
        F.round(F.abs(F.col("quantity") * F.col("unit_price") - paid), 4)
        > F.lit(V.PRICE_TOLERANCE).cast("decimal(4,2)")), F.lit(False))


def issue_filters() -> dict[str, Column]:
    """Named row filters of the price-quality worklist."""
    unit_unknown = F.col("normalized_price_unit").isNull() | (F.col("normalized_price_unit") == "unknown")
    suspicious = F.coalesce(suspicious_price(), F.lit(False))
    return {
        "unknown": F.col("quantity_unit").isNull() | (F.col("quantity_unit") == "unknown"),
        "low_confidence": low_confidence(),
        "missing_package": F.coalesce(F.col("quantity_unit") == "piece", F.lit(False)) & F.col("package_size").isNull(),
        "suspicious": suspicious,
        "all": (F.col("line_total").isNull() | F.col("unit_price").isNull() | unit_unknown
                | low_confidence() | suspicious | arithmetic_mismatch()),
    }
