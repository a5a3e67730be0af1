"""Table schemas, conforming older tables to them, and constraint audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V

RECEIPTS_DDL = "id bigint, date string, store string, total decimal(14,2), receipt_number string"
ITEMS_DDL = (
    "id bigint, receipt_id bigint, name string, canonical_name string, normalized_name string, "
    "quantity decimal(18,4), price decimal(14,2), line_total decimal(14,2), unit_price decimal(18,4), "
    "quantity_unit string, package_size decimal(18,4), package_unit string, "
    "normalized_unit_price decimal(18,4), normalized_price_unit string, price_parse_source string, "
    "price_parse_confidence decimal(4,2), category string, category_source string")
RULES_DDL = "product_key string, category string, source string, created_at timestamp, updated_at timestamp"

# Defaults of columns an older table may lack or leave empty.
ITEM_DEFAULTS = {"quantity": "1", "price": "0", "category": V.UNRESOLVED, "category_source": "rule"}
RECEIPT_DEFAULTS = {"total": "0"}


def columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in _fields(ddl)]


def _fields(ddl: str) -> list[str]:
    fields, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "(<") - (c in ")>")
        if c == "," and depth == 0:
            fields.append(ddl[start:i].strip())
            start = i + 1
    return fields + [ddl[start:].strip()]


def conform(df: DataFrame, ddl: str, defaults: dict | None = None) -> DataFrame:
    """Bring any older layout to the schema: missing columns, types and defaults."""
    defaults = defaults or {}
    out = []
    for field in _fields(ddl):
        name, kind = field.split(" ", 1)
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        out.append(value.alias(name))
    return df.select(*out)


def audit_constraints(receipts: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per constraint with the number of violations; every count is a plain aggregate."""
    def duplicates(df, key, name):
        return df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("violations")).select(
            F.lit(name).alias("constraint_name"), "violations")

    def missing(df, fields, table):
        counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
        return counts.select(F.explode(F.array(*[F.struct(
            F.lit(f"{table}.{f}_not_null").alias("constraint_name"), F.col(f).alias("violations")) for f in fields
        ])).alias("r")).select("r.*")

    orphans = items.join(receipts.select(F.col("id").alias("receipt_id")), "receipt_id", "left_anti").agg(
        F.count("*").alias("violations")).select(F.lit("items.receipt_exists").alias("constraint_name"), "violations")
    return reduce(DataFrame.unionByName, [
        duplicates(receipts, "receipt_number", "receipts.receipt_number_unique"),
        duplicates(rules, "product_key", "rules.product_key_unique"),
        missing(receipts, ["total", "receipt_number"], "receipts"),
        missing(items, ["receipt_id", "name", "quantity", "price", "category", "category_source"], "items"),
        orphans,
    ])
