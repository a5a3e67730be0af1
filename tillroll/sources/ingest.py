"""Parsed receipts to stored tables: duplicates, price model, categories."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.categories import classify, label_source, write_label
from tillroll.functions.columns import MONEY
from tillroll.functions.identity import product_key
from tillroll.functions.names import normalize
from tillroll.functions.price import derive_price, with_name_evidence
from tillroll.schema import ITEMS_DDL, RECEIPTS_DDL, conform
from tillroll.session import stored

NESTED = ("synthetic boolean, receipts array<struct<date: string, store: string, total: double, receipt_number: string, "
          "items: array<struct<name: string, quantity: double, price: double, line_total: double, unit_price: double, "
          "quantity_unit: string, source: string, category: string, category_source: string>>>>")
NESTED_ITEM = ("name", "quantity", "price", "line_total", "unit_price", "quantity_unit", "source", "category", "category_source")


def receipt_id(number: Column) -> Column:
    return F.xxhash64(number)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Receipt files, one document per file; the raw text is kept for the type checks."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("json"))


def validate_nested(documents: DataFrame) -> DataFrame:
    """One row per receipt, or per refused document, with the first fault in `error`."""
    df = documents.withColumn("d", F.from_json("json", NESTED))
    df = df.withColumn("error", F.when(~F.coalesce("d.synthetic", F.lit(False)), "not_synthetic").when(
        F.coalesce(F.size("d.receipts"), F.lit(0)) < 1, "no_receipts"))
    rows = df.select("source", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("d.receipts"))).alias("position", "r"))
    blank = lambda f: F.coalesce(F.trim(F.col(f"r.{f}")) == "", F.lit(True))
    fault = F.when(blank("date"), "date").when(blank("store"), "store").when(blank("receipt_number"), "receipt_number").when(
        F.col("r.total").isNull(), "total").when(F.coalesce(F.size("r.items"), F.lit(0)) < 1, "items").when(
        F.exists("r.items", lambda i: i.isNull() | i["name"].isNull()), "item_name")
    rows = rows.withColumn("error", F.coalesce("error", fault))
    twice = rows.where("error IS NULL").groupBy(F.col("r.receipt_number").alias("n")).agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(twice.select("n", F.lit("duplicate_number").alias("_dup")), F.col("r.receipt_number") == F.col("n"), "left").select(
        "source", "position", F.coalesce("error", "_dup").alias("error"), "r")


def nested_documents(valid: DataFrame) -> DataFrame:
    """Faultless receipts in the shape of parsed documents."""
    line = lambda i, n: F.struct(n.cast("bigint").alias("line_no"), *[i[c].alias(c) for c in NESTED_ITEM])
    return valid.where("error IS NULL").select(
        "r.receipt_number", "r.date", "r.store", F.round("r.total", 2).cast(MONEY).alias("total"), F.transform("r.items", line).alias("items"))


def load_nested(spark: SparkSession, source: str, target: str, rules: DataFrame, overwrite: bool = False) -> DataFrame:
    """Load nested receipt files into a new pair of tables; one row (receipts, items) with what was stored.

    A target that exists is refused before anything is read unless `overwrite` says otherwise. A fault in any
    document refuses the whole load, with up to five of them named; nothing is written then.
    """
    if not overwrite:
        for table, ddl in (("receipts", RECEIPTS_DDL), ("items", ITEMS_DDL)):
            _refuse_existing(spark, f"{target}/{table}", ddl)
    documents = stored(validate_nested(read_nested(spark, source)))
    faults = documents.where("error IS NOT NULL").select("source", "position", "error").orderBy("source", "position").limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r.source}[{0 if r.position is None else r.position}]: {r.error}" for r in faults))
    receipts, items = ingest(nested_documents(documents), spark.createDataFrame([], RECEIPTS_DDL), rules)
    mode = "overwrite" if overwrite else "errorifexists"
    items.write.mode(mode).parquet(f"{target}/items")
    receipts.write.mode(mode).parquet(f"{target}/receipts")
    counted = [spark.read.schema(ddl).parquet(f"{target}/{table}").agg(F.count("*").alias(table)) for table, ddl in (("receipts", RECEIPTS_DDL), ("items", ITEMS_DDL))]
    return counted[0].select("receipts", counted[1].scalar().alias("items"))


def _refuse_existing(spark: SparkSession, path: str, ddl: str) -> None:
    try:
        spark.read.schema(ddl).parquet(path)
    except AnalysisException:  # there is no such folder
        return
    raise FileExistsError(f"target already exists: {path}")


def new_documents(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """One document, with its own lines, of every number that is not stored yet.

    Of several with one number the smallest by content stays, so a lost task that runs
    again takes the same one; a document without a number is no receipt.
    """
    parts = ["date", "store", "total", "items"]
    first = documents.where("receipt_number IS NOT NULL").groupBy("receipt_number").agg(F.min(F.struct(*parts)).alias("d"))
    return first.join(existing.select("receipt_number"), "receipt_number", "left_anti").select(
        receipt_id(F.col("receipt_number")).alias("id"), "d.date", "d.store",
        F.coalesce("d.total", F.lit(0)).cast(MONEY).alias("total"), "receipt_number", "d.items")


def with_name_facts(lines: DataFrame) -> DataFrame:
    """Search form, category and price evidence of the name, computed once per distinct name.

    A stream keeps no set of names and computes them per line.
    """
    facts = lambda df: with_name_evidence(classify(df).withColumn("normalized_name", normalize(F.col("name"))), "name", "_evidence")
    return facts(lines) if lines.isStreaming else lines.join(facts(lines.select("name").distinct()), "name")


def with_category(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Manual rule first, then a stated rule or fallback label, then the classifier's label in `predicted`."""
    df = lines.withColumn("_pk", product_key())
    known = rules.select(F.col("product_key").alias("_pk"), write_label(F.col("category")).alias("_rule")).dropDuplicates(["_pk"])
    df = df.join(known, "_pk", "left")
    stated = F.col("category_source").isin("rule", "fallback")
    label = F.when(F.col("_rule").isNotNull(), F.col("_rule")).when(stated, write_label(F.col("category"))).otherwise(F.col("predicted"))
    source = F.when(F.col("_rule").isNotNull(), "inherited").when(stated, F.col("category_source")).otherwise(label_source(F.col("predicted")))
    return df.withColumns({"_label": label, "_label_source": source}).withColumns(
        {"category": F.col("_label"), "category_source": F.col("_label_source")}).drop(
        "_pk", "_rule", "predicted", "_label", "_label_source")


def enrich(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Price model and category of parsed lines; `source` tells where the unit came from."""
    optional = {"line_total": "decimal(14,2)", "package_size": "decimal(18,4)", "package_unit": "string", "unit_price": "decimal(18,4)",
                "quantity_unit": "string", "category": "string", "category_source": "string", "source": "string",
                "canonical_name": "string"}
    for name, kind in optional.items():
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    lines = lines.withColumns({
        "name": F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")),
        "quantity": F.coalesce(F.col("quantity").cast("decimal(18,4)"), F.lit(1).cast("decimal(18,4)")),
        "line_total": F.coalesce(F.col("line_total").cast(MONEY), F.col("price").cast(MONEY), F.lit(0).cast(MONEY)),
        "canonical_name": F.lit(None).cast("string")})
    lines = with_category(with_name_facts(lines), rules)
    lines = derive_price(lines, evidence="_evidence", source="source", out="d")
    return lines.select(
        *[c for c in lines.columns if c in ("receipt_number", "receipt_id", "line_no")], "name", "canonical_name", "normalized_name",
        "d.quantity", F.col("d.line_total").cast(MONEY).alias("price"), F.col("d.line_total").cast(MONEY).alias("line_total"),
        "d.unit_price", "d.quantity_unit", "d.package_size", "d.package_unit", "d.normalized_unit_price", "d.normalized_price_unit",
        F.col("d.source").alias("price_parse_source"), F.col("d.confidence").alias("price_parse_confidence"), "category", "category_source")


def ingest(documents: DataFrame, existing: DataFrame, rules: DataFrame, source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New receipts and their enriched lines. Running it again on its own output adds nothing.

    `documents` holds receipt_number, date, store, total and items (array of lines);
    `source` says where the unit of a line came from, if the lines do not. The new documents are
    written once, as receipts, names and lines are read from them; `documents` are read only for that.
    """
    fresh = stored(new_documents(documents, existing))
    lines = fresh.select("receipt_number", F.col("id").alias("receipt_id"), F.explode("items").alias("i")).select(
        "receipt_number", "receipt_id", "i.*")
    items = enrich(lines if source is None else lines.withColumn("source", source), rules).withColumn("id", F.col("line_no"))
    return conform(fresh.drop("items"), RECEIPTS_DDL), conform(items, ITEMS_DDL)
