"""Price evidence of one purchase line: package, unit, comparable unit price, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.columns import (
    AMOUNT, CONFIDENCE, UNICODE, apart, codes, first_group, first_true, literal_map, lookup, one_space,
    parse_decimal, settled,
)

# --- fixed values: unit spellings and service-line patterns -------------------------------
UNITS = "(?:kg|ml|gr|g|l|gab|gb|pcs|pc|pieces|piece)"
SERVICE_PATTERNS = [
    r"(?:papildus\s+)?depoz[iī]ta\s+maksa",
    r"(?:deposit(?:\s+fee)?|depozīts?)",
    r"(?:iepakojums|packaging)(?:\s+(?:maksa|fee))?",
    r"(?:paper|reusable|shopping)\s+bag(?:\s+\w+){0,2}",
    r"(?=.*\bmaisi(?:ņš|ns|nss)\b)(?=.*\b(?:iepirkumu|papīra|papira|rimi|lietojams|bioloģiskais|biologiskais|letaupi)\b).+",
    r"(?:kases\s+pakalpojums|cashier\s+service)(?:\s+(?:maksa|fee))?",
]
PHYSICAL_UNITS = ["kg", "g", "l", "ml"]


def quantity_unit(unit: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), r"\.+$", "")
    return lookup(V.QUANTITY_UNIT_SYNONYMS, text, "unknown")


def is_service_line(name: Column) -> Column:
    return is_service_text(F.lower(one_space(name)))


def is_service_text(text: Column) -> Column:
    """The same for a name that is lower case already, its white space single blanks."""
    return text.rlike(r"(?iuU)^(?:" + "|".join(f"(?:{p})" for p in SERVICE_PATTERNS) + ")$")


def with_package(df: DataFrame, name: str, out: str = "package") -> DataFrame:
    """Add `out` = struct(size, unit, warning): at most one of a size and a warning is set.

    The guards are tried in order; the first that fits rejects the measure. Every pattern
    is a column of its own, so that it runs once per row however often it is used.
    """
    keep = [c for c in df.columns if c != out]
    aged = UNICODE + r"(?<!\w)(\d{1,2})\+\s*(\d+(?:[.,]\d+)?)\s*(g|ml)\b"
    measure = UNICODE + rf"(?<![\w+])(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
    wide = "decimal(28,4)"

    df = df.withColumn("_raw", F.lower(F.coalesce(F.col(name), F.lit(""))))
    raw = F.col("_raw")
    # A name without a digit has no measure: skip the costly patterns.
    df = df.withColumn("_digit", raw.rlike("[0-9]") | raw.rlike(UNICODE + r"\d"))

    def found(pattern):
        return F.col("_digit") & raw.rlike(UNICODE + pattern)

    df = df.withColumns({
        "_measures": F.when(F.col("_digit"), F.regexp_extract_all(raw, F.lit(measure), F.lit(0))),
        "_age": F.when(F.contains(raw, F.lit("+")), first_group(raw, aged, 0)),
        "_plus": F.contains(raw, F.lit("+")),
    })
    df = df.withColumns({
        "_count": F.coalesce(F.size("_measures"), F.lit(0)),
        "_one": F.try_element_at("_measures", F.lit(1)),
    })
    df = df.withColumns({
        "_count": F.greatest("_count", F.lit(0)),
        "_number": F.regexp_extract("_one", r"^[\d.,]*\d", 0),
        "_spelled": F.regexp_extract("_one", r"[a-z]+$", 0),
        "_months": F.regexp_extract("_age", UNICODE + r"^(\d+)\+", 1).try_cast("int"),
        "_age_size": parse_decimal(F.regexp_extract("_age", UNICODE + r"\+\s*([\d.,]+)", 1), wide),
        "_rest": F.when(F.col("_age").isNotNull(), F.array_join(F.split(raw, aged, 2), "")),
    })
    df = df.withColumns({
        "_value": parse_decimal(F.col("_number"), wide),
        "_base": F.try_element_at(literal_map({k: u for k, (_, u) in V.PACKAGE_UNITS.items()}), F.col("_spelled")),
        "_age_ok": F.coalesce(F.col("_months").between(1, 36) & (F.col("_age_size") > 0) & (
            F.col("_age_size") <= V.MAX_PACKAGE_BASE_UNITS) & ~F.col("_rest").rlike(measure), F.lit(False)),
    })
    value, unit = F.col("_value"), F.col("_base")
    size = F.round(F.when(F.col("_spelled").isin("l", "kg"), value * 1000).otherwise(value), 3).cast(wide)
    limit = F.when(unit == "piece", V.MAX_PACKAGE_PIECES).otherwise(V.MAX_PACKAGE_BASE_UNITS)
    aged_found = F.col("_age").isNotNull()
    df = df.withColumn("_size", size)
    df = df.withColumn("_warning", first_true([
        (found(rf"\b\d+\s*[xх×]\s*\d+(?:[.,]\d+)?\s*{UNITS}\b"), "multipack_unresolved"),
        (aged_found & F.col("_age_ok"), F.lit(None).cast("string")),
        (aged_found, "age_package_ambiguous"),
        (F.col("_plus") & found(r"\b\d+\s*\++\s*\d+(?:[.,]\d+)?\s*(?:g|ml)\b"), "age_package_ambiguous"),
        (F.contains(raw, F.lit(",")) & found(rf"\d+\s*,\s+\d+\s*{UNITS}\b"), "ambiguous_package_size"),
        (F.col("_plus") & found(rf"\d+\s*\+\s*{UNITS}\b"), "weighted_measurement_ambiguous"),
        (found(rf"[^\W\d_]\d+(?:[.,]\d+)?\s*{UNITS}\b"), "ambiguous_package_size"),
        (F.col("_count") > 1, "ambiguous_package_size"),
        (F.col("_count") == 0, F.lit(None).cast("string")),
        ((unit == "piece") & (value != F.floor(value)), "invalid_package_size"),
        ((unit == "piece") & raw.rlike(
            UNICODE + r"(?:\b(?:komplekts|mānekļi|rotaļlietas)\b|\bmānekļ\.)"), "ambiguous_package_size"),
        (F.col("_size") <= 0, "invalid_package_size"),
        (F.col("_size").isNull() | (F.col("_size") > limit), "ambiguous_package_size"),
    ]))
    clean = F.col("_warning").isNull()
    package = F.struct(
        F.when(clean & aged_found, F.col("_age_size")).when(
            clean & (F.col("_count") == 1), F.col("_size")).cast(AMOUNT).alias("size"),
        F.when(clean & aged_found, F.regexp_extract("_age", r"(g|ml)$", 1)).when(
            clean & (F.col("_count") == 1), unit).alias("unit"),
        F.col("_warning").alias("warning"),
    )
    return df.select(*keep, package.alias(out))


def with_name_evidence(df: DataFrame, name: str = "name", out: str = "evidence") -> DataFrame:
    """Add struct `out`: everything the price model reads from the name alone.

    Narrow. It depends on the name only, so where names repeat it is computed on the
    table of names and carried along.
    """
    keep = [c for c in df.columns if c != out]
    df = with_package(df, name, "_package")
    text = F.coalesce(F.col(name), F.lit(""))
    struct = F.struct(
        is_service_line(F.col(name)).alias("service"),
        text.rlike(r"(?iuU)\b(?:čeks|ceks|receipt|rēķins)\b").alias("contaminated"),
        F.col("_package").alias("package"),
        first_group(F.lower(F.trim(text)), UNICODE + r"\b(kg|l)(?:\s+\d+\.\s*šķ\.)?\s*$").alias("weight_unit"),
    )
    return df.select(*keep, settled(struct).alias(out))


def prices_differ(quantity: Column, unit_price: Column, total: Column) -> Column:
    return F.abs(quantity * unit_price - total) > F.lit(V.PRICE_TOLERANCE).cast("decimal(4,2)")


def derive_price(df: DataFrame, *, name: str = "name", evidence: str | None = None, quantity="quantity",
                 line_total="line_total", unit_price="unit_price", unit="quantity_unit",
                 package_size="package_size", package_unit="package_unit",
                 source="price_parse_source", default_source: str = "derived",
                 out: str = "derived", warnings: bool = True) -> DataFrame:
    """Add struct column `out`: the evidence-graded price model of every line.

    Narrow: one projection per step, each compiled by itself, no shuffle. Arguments name
    input columns; pass a Column for a constant. `warnings` may be left out of the struct by
    a caller that reads none; the other fields stay as they are.
    """
    def given(value):
        return F.col(value) if isinstance(value, str) else value

    def number(value):
        text = df.select(given(value)).schema[0].dataType.simpleString() == "string"
        return parse_decimal(given(value)) if text else given(value).cast(AMOUNT)

    keep = df.columns
    if evidence is None:
        df = with_name_evidence(df, name, "_ev")
    else:
        df = df.withColumn("_ev", F.col(evidence))
    numbers = {"_q_in": number(quantity), "_given_total": number(line_total),
               "_listed": number(unit_price), "_size_in": number(package_size)}
    df = df.withColumns({
        **numbers,
        "_unit": quantity_unit(given(unit)),
        "_size_unit": F.lower(F.trim(F.coalesce(given(package_unit), F.lit("")))),
        "_source": F.coalesce(F.nullif(given(source), F.lit("")), F.lit(default_source)),
    })
    supplied = (F.col("_size_in") > 0) & F.col("_size_unit").isin("kg", "l", "g", "ml", "piece")
    df = df.withColumns({
        "_q": F.coalesce(F.col("_q_in"), F.lit(1).cast(AMOUNT)),
        "_t": F.coalesce(F.col("_given_total"), F.lit(0).cast(AMOUNT)),
    })
    total = F.col("_t")
    df = df.withColumns({
        "_t": apart("_t"),
        "_effective": F.when(F.col("_given_total").isNotNull() & (F.col("_q") > 0) & (total >= 0),
                             F.round(F.try_divide(total, F.col("_q")), 4).cast(AMOUNT)).otherwise(F.col("_listed")),
        "_listed_ok": (F.col("_q") > 0) & F.col("_listed").isNotNull() & (total > 0) & ~F.coalesce(
            prices_differ(F.col("_q"), F.col("_listed"), total), F.lit(True)),
        "_supplied_size": F.when(supplied, F.when(F.col("_size_unit").isin("kg", "l"),
                                                  (F.col("_size_in") * 1000).cast(AMOUNT)).otherwise(F.col("_size_in"))),
        "_supplied_unit": F.when(supplied, F.when(F.col("_size_unit") == "kg", F.lit("g")).when(
            F.col("_size_unit") == "l", F.lit("ml")).otherwise(F.col("_size_unit"))),
        "_physical": F.col("_unit").isin(PHYSICAL_UNITS),
        "_whole": F.col("_q") == F.floor("_q"),
    })
    reviewed = (F.col("_source") == "manual_correction") & (F.col("_supplied_size").isNotNull() | F.col("_physical"))
    df = df.withColumns({
        "_t": apart("_t"),
        "_package_warning": F.when(~(reviewed & F.col("_ev.package.warning").isin(V.AMBIGUOUS_PACKAGE_WARNINGS)),
                                   F.col("_ev.package.warning")),
        "_listed_mismatch": F.col("_listed").isNotNull() & F.col("_given_total").isNotNull() & (
            F.col("_q") > 0) & ~F.col("_listed_ok"),
        "_size": F.coalesce(F.col("_supplied_size"), F.col("_ev.package.size")),
        "_size_base": F.coalesce(F.col("_supplied_unit"), F.col("_ev.package.unit")),
        "_weighted": (F.col("_q") > 0) & ~F.col("_whole") & F.col("_ev.weight_unit").isNotNull() & F.col("_listed_ok"),
    })
    fatal = F.col("_ev.contaminated") | F.coalesce(F.col("_package_warning") == "multipack_unresolved", F.lit(False)) | (
        F.coalesce(F.col("_package_warning").isin(V.AMBIGUOUS_PACKAGE_WARNINGS), F.lit(False))
        & F.col("_supplied_size").isNull() & ~F.col("_physical") & ~F.col("_weighted"))
    countable = (F.col("_q") > 0) & F.col("_whole") & F.col("_given_total").isNotNull() & (F.col("_t") > 0)
    df = df.withColumns({"_t": apart("_t"), "_branch": first_true([
        (F.col("_ev.service"), "service_line"),
        (fatal, "rejected"),
        (F.col("_unit") != "unknown", "stated"),
        (F.col("_weighted"), "weighted_inference"),
        (countable & F.coalesce(F.col("_size") > 0, F.lit(False)), "package_name"),
        (countable, "inferred_piece"),
        (F.lit(True), "unresolved"),
    ])})
    open_branch = ~F.col("_branch").isin("service_line", "rejected")
    df = df.withColumns({
        "_t": apart("_t"),
        "_final_unit": first_true([
            (F.col("_branch") == "service_line", F.lit("unknown")),
            (F.col("_branch") == "weighted_inference", F.col("_ev.weight_unit")),
            (F.col("_branch").isin("package_name", "inferred_piece"), F.lit("piece")),
            (F.lit(True), F.col("_unit")),
        ]),
        "_final_size": F.when(open_branch, F.col("_size")),
        "_final_base": F.when(open_branch, F.col("_size_base")),
        "_final_source": F.when(F.col("_branch") == "stated", F.col("_source")).otherwise(F.col("_branch")),
        "_graded": first_true([
            (F.col("_branch") == "stated", F.coalesce(
                F.try_element_at(literal_map(V.SOURCE_CONFIDENCE), F.col("_source")),
                F.when(F.col("_size") > 0, "0.85").otherwise("0.70"))),
            (F.col("_branch").isin("weighted_inference", "package_name", "inferred_piece"),
             F.try_element_at(literal_map(V.SOURCE_CONFIDENCE), F.col("_branch"))),
        ]).cast(CONFIDENCE),
    })
    packed = (F.col("_final_unit") == "piece") & (F.col("_final_size") > 0) & F.col("_final_base").isin("ml", "g", "piece")
    thousand = F.col("_final_unit").isin("g", "ml") | (packed & F.col("_final_base").isin("g", "ml"))
    priced = open_branch & (F.col("_q") > 0) & (F.col("_t") > 0) & F.col("_final_unit").isin(
        "kg", "g", "l", "ml", "piece")
    per = first_true([
        (F.col("_final_unit").isin("kg", "g"), F.lit("eur_per_kg")),
        (F.col("_final_unit").isin("l", "ml"), F.lit("eur_per_l")),
        (packed & (F.col("_final_base") == "ml"), F.lit("eur_per_l")),
        (packed & (F.col("_final_base") == "g"), F.lit("eur_per_kg")),
        (F.col("_final_unit") == "piece", F.lit("eur_per_piece")),
    ])
    numerator = F.col("_t") * F.when(thousand, F.lit(1000)).otherwise(F.lit(1)).cast("decimal(4,0)")
    denominator = F.col("_q") * F.when(packed, F.col("_final_size")).otherwise(F.lit(1).cast(AMOUNT))
    df = df.withColumns({
        "_t": apart("_t"),
        "_npu": F.when(priced, F.round(F.try_divide(numerator, denominator), 4).cast(AMOUNT)),
        "_npu_unit": F.when(priced, per).otherwise(F.lit("unknown")),
    })
    df = df.withColumns({"_t": apart("_t"), "_mismatch": F.col("_listed_mismatch") | (
        (F.col("_effective") != 0) & (F.col("_q") > 0) & prices_differ(F.col("_q"), F.col("_effective"), F.col("_t")))})
    listed = codes([
        ("line_total_unit_price_mismatch", F.col("_mismatch")),
        ("service_line", F.col("_ev.service")),
        ("parser_contamination", F.col("_ev.contaminated")),
        *[(w, F.col("_package_warning") == w) for w in [*V.AMBIGUOUS_PACKAGE_WARNINGS, "multipack_unresolved"]],
        ("quantity_unit_inferred_piece", F.col("_branch").isin("package_name", "inferred_piece")),
        ("quantity_not_positive", F.col("_q") <= 0),
        ("line_total_negative", F.col("_t") < 0),
        ("unit_price_negative", F.col("_effective") < 0),
        ("normalized_unit_price_not_positive", F.col("_npu") <= 0),
        ("normalized_unit_price_suspicious", F.col("_npu") > V.MAX_NORMALIZED_PRICE),
        ("package_size_not_positive", F.col("_final_size") <= 0),
        ("unknown_quantity_unit", F.col("_final_unit") == "unknown"),
    ])
    capped = F.col("_mismatch") & (F.col("_graded") > F.lit("0.70").cast(CONFIDENCE))
    model = F.struct(
        F.col("_q").alias("quantity"),
        F.col("_final_unit").alias("quantity_unit"),
        F.col("_t").alias("line_total"),
        F.col("_effective").alias("unit_price"),
        F.col("_final_size").alias("package_size"),
        F.coalesce(F.col("_final_base"), F.lit("unknown")).alias("package_unit"),
        F.col("_npu").alias("normalized_unit_price"),
        F.col("_npu_unit").alias("normalized_price_unit"),
        F.col("_final_source").alias("source"),
        F.when(capped, F.lit("0.70").cast(CONFIDENCE)).otherwise(F.col("_graded")).alias("confidence"),
        *([listed.alias("warnings")] if warnings else []),
    )
    kept = [c for c in keep if c != out]
    return df.select(*kept, model.alias("_model")).select(*kept, settled(F.col("_model")).alias(out))


def units_comparable(left: str, right: str) -> Column:
    """May two prices be compared? Per-piece prices only within one product."""
    def both(field):
        return F.coalesce((F.col(f"{left}.{field}") != "") & (F.col(f"{left}.{field}") == F.col(f"{right}.{field}")), F.lit(False))
    unit = F.col(f"{left}.normalized_price_unit")
    same = both("normalized_price_unit") & (unit != "unknown")
    return same & (unit.isin("eur_per_l", "eur_per_kg") | (
        (unit == "eur_per_piece") & (both("product_key") | both("canonical_name"))))
