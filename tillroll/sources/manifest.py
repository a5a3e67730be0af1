"""Category migration manifests: CSV with a JSON column, validated row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.columns import is_blank, not_blank

# --- fixed values: manifest layout --------------------------------------------------------
COLUMNS = ["effective_product", "product_key", "target_category", "current_categories", "expected_affected_item_count",
           "expected_rule_operation", "before_state_predicates", "required_exact_exclusions", "protected_item_ids", "reason", "confidence"]
OPERATIONS = ["LABEL_ONLY", "CREATE_EXACT_RULE", "UPDATE_EXISTING_RULE", "MULTI_RULE_EXACT"]
PREDICATES = ("current_categories string, effective_product string, existing_rule string, identity_row_count bigint, "
              "item_exception_count bigint, item_exception_ids array<string>, product_key string, raw_alias_keys array<string>, "
              "rule_scope_rows bigint, shared_product_key_identity_count bigint")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"manifest columns missing: {missing}")
    return df.select(*COLUMNS)


def project_csv(spark: SparkSession, path: str, key: str, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A CSV whose keys must be exactly the allowed ones: the rows, and the keys on one side only."""
    df = spark.read.option("header", True).csv(path)
    seen, wanted = df.select(F.col(key).cast("string").alias(key)), allowed.select(F.col(key).cast("string").alias(key))
    return df, seen.exceptAll(wanted).withColumn("side", F.lit("unexpected")).unionByName(
        wanted.exceptAll(seen).withColumn("side", F.lit("missing")))


def validate_manifest(raw: DataFrame) -> DataFrame:
    """Typed rows with the first fault in `error`; NULL error means the row may be planned."""
    known = [name.split()[0] for name in PREDICATES.split(", ")]
    df = raw.withColumns({
        "predicates": F.from_json("before_state_predicates", PREDICATES),
        "_keys": F.json_object_keys("before_state_predicates"),
        "_count": F.col("expected_affected_item_count").try_cast("bigint"),
        "_same": F.count("*").over(W.partitionBy("effective_product"))})
    error = F.when(is_blank(F.col("effective_product")), "identity_missing").when(F.col("_same") > 1, "identity_duplicated").when(
        F.coalesce(F.col("confidence") != "HIGH", F.lit(True)), "confidence_not_high").when(
        ~F.coalesce(F.col("target_category").isin(V.CANONICAL_CATEGORIES), F.lit(False)), "target_not_approved").when(
        ~F.coalesce(F.col("expected_rule_operation").isin(OPERATIONS), F.lit(False)), "unknown_operation").when(
        not_blank(F.col("required_exact_exclusions")) | not_blank(F.col("protected_item_ids")), "has_exclusions").when(
        F.col("_keys").isNull() | F.col("_count").isNull(), "invalid_predicate").when(
        F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in known]))) > 0, "unsupported_predicate")
    return df.select("effective_product", "product_key", "target_category", "current_categories",
                     F.col("_count").alias("expected_affected_item_count"), "expected_rule_operation", "predicates", F.col("_keys").alias("stated"), "reason",
                     error.alias("error"))
