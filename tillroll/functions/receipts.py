"""Receipt text: repairs, metadata lines, name quality and contamination classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import UNICODE_FOLD, first_true, one_space
from tillroll.functions.price import UNITS, is_service_line, is_service_text, with_package

# --- fixed values: line and name patterns -------------------------------------------------
METADATA_PATTERNS = [
    r"(?:sia\s+)?(?:rimi|maxima)(?:\s+(?:latvia|latvija))?",
    r"(?:čeks|ceks)(?:\s+.*)?",
    r"(?:čeka|ceka)\s*(?:nr\.?\s*)?\d+(?:/\d+)?",
    r"\d+/\d+",
    r"(?:kase(?:s)?(?:\s+nr\.?)?|kasieris|rrn|termin[aā]l[ais]*|tirgot[aā]ja)\b.*",
    r"(?:paldies\s+par\s+pirkumu|saglab[aā]jiet\s+čeku).*",
]
SPLIT_DECIMAL = rf"(?<!\d)(\d+),\s+(\d)(?=\s*{UNITS}\b)"
UNSAFE_DECIMAL = rf"\b\d+,\s+\d{{2,}}\s*{UNITS}\b"
GLUED_PACKAGE = rf"[^\W\d_xх×]\d+(?:[.,]\d+)?\s*{UNITS}\b"
ANY_SPLIT_DECIMAL = rf"\b\d+,\s+\d+\s*{UNITS}\b"
MULTIPACK = rf"\b\d+\s*[xх×]\s*\d+(?:[.,]\d+)?\s*{UNITS}\b|\b\d+\s*\+\s*\d+\b"
MISREAD_KG = r"(?<!\w)lkg\b"
MISREAD_ML = r"\b\d+(?:[.,]\d+)?\s*m1\b"
HEADER = r"^(?:čeks|ceks)(?:\s|$)"


def repair_text(text: Column) -> Column:
    """Plain dashes, and a decimal split by blanks joined before a unit; most texts have neither."""
    repaired = F.regexp_replace(F.regexp_replace(text, "[—–]", "-"), UNICODE_FOLD + SPLIT_DECIMAL, "$1,$2")
    return F.when(text.rlike("[—–]|,[^!-~]"), repaired).otherwise(text)


def is_metadata_line(line: Column) -> Column:
    return F.lower(one_space(line)).rlike(
        UNICODE_FOLD + "^(?:" + "|".join(f"(?:{p})" for p in METADATA_PATTERNS) + ")$")


def name_issue(name: Column) -> Column:
    """First structural fault of a parsed name, NULL for a usable one."""
    text = one_space(name)
    return text_issue(text, F.lower(text))


def text_issue(text: Column, lowered: Column) -> Column:
    """The same for a name whose white space is single blanks, beside its lower-case form.

    What a pattern cannot do without is looked for first; the letters of those parts have no other
    case forms than lower() resolves.
    """
    return first_true([
        (text == "", "empty_name"),
        (text.rlike(UNICODE_FOLD + HEADER), "receipt_header"),
        (is_service_text(lowered), "service_line"),
        (F.contains(lowered, F.lit("lkg")) & text.rlike(UNICODE_FOLD + MISREAD_KG), "ocr_lkg"),
        (F.contains(lowered, F.lit("m1")) & text.rlike(UNICODE_FOLD + MISREAD_ML), "ocr_m1"),
        (F.contains(text, F.lit(", ")) & text.rlike(UNICODE_FOLD + UNSAFE_DECIMAL), "unsafe_decimal_corruption"),
        (text.rlike(UNICODE_FOLD + GLUED_PACKAGE), "glued_package_token"),
    ])


def _contamination(text: Column, package_warning: Column) -> Column:
    return first_true([
        (text.rlike(UNICODE_FOLD + ANY_SPLIT_DECIMAL), "ocr_decimal_corruption"),
        (text.rlike(UNICODE_FOLD + MISREAD_KG), "ocr_lkg"),
        (text.rlike(UNICODE_FOLD + MISREAD_ML), "ocr_m1"),
        (text.rlike(UNICODE_FOLD + HEADER), "receipt_header"),
        (is_metadata_line(text), "cashier_line"),
        (is_service_line(text), "service_line"),
        (text.rlike(UNICODE_FOLD + MULTIPACK), "multipack"),
        (text.rlike(UNICODE_FOLD + GLUED_PACKAGE), "glued_tokens"),
        (F.coalesce(package_warning.isin("ambiguous_package_size", "invalid_package_size"), F.lit(False)),
         "ambiguous_package_size"),
        (F.lit(True), "unknown"),
    ])


def with_contamination(df: DataFrame, name: str = "name") -> DataFrame:
    """Add `contamination` (one of ten classes) and `action`, what today's parser would do."""
    keep = [c for c in df.columns if c not in ("contamination", "action")]
    df = df.withColumns({"_text": one_space(F.col(name)), "_repaired": repair_text(F.col(name))})
    df = df.withColumn("_repaired_text", one_space(F.col("_repaired")))
    df = with_package(with_package(df, "_text", "_p"), "_repaired_text", "_rp")
    df = df.withColumns({
        "contamination": _contamination(F.col("_text"), F.col("_p.warning")),
        "_after": _contamination(F.col("_repaired_text"), F.col("_rp.warning")),
    })
    action = first_true([
        (is_metadata_line(F.col("_repaired")) | name_issue(F.col("_repaired")).isNotNull(), "rejected"),
        (F.col("_after").isin("multipack", "ambiguous_package_size"), "unresolved"),
        (F.col("_repaired") != F.col(name), "corrected"),
        (F.lit(True), "unchanged"),
    ])
    return df.select(*keep, "contamination", action.alias("action"))
