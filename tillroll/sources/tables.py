"""Receipts, purchase lines and rules bound to the order tables the driver supplies.

The order tables stand in for a receipt store. The binding gives every branch of the
price model, the identity contract and the category labels something to do; it adds no
shuffle of its own beyond the joins of the order tables.
"""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.columns import AMOUNT, MONEY, literal_map
from tillroll.functions.identity import identity
from tillroll.functions.names import normalize
from tillroll.functions.price import derive_price, with_name_evidence
from tillroll.schema import ITEMS_DDL, columns

# Fixed labels of the six part types, two of them legacy or unknown on purpose.
TYPE_CATEGORY = {
    "ECONOMY": V.GROCERY, "STANDARD": "напитки", "MEDIUM": V.DAIRY, "LARGE": V.SOFT_DRINKS, "SMALL": V.UNRESOLVED,
}
# A word of a category in the names of some brands.
KEYWORD_BRANDS = {
    "Brand#5": "maize", "Brand#6": "piens", "Brand#12": "banan", "Brand#13": "olas", "Brand#14": "lasis", "Brand#15": "beer",
    "Brand#16": "kakao", "Brand#17": "frozen", "Brand#18": "burger", "Brand#19": "desa", "Brand#20": "rieksti", "Brand#21": "milti",
    "Brand#22": "ketchup", "Brand#23": "ziepes", "Brand#24": "whiskas",
}
RULE_BRANDS = {"Brand#7": V.SNACKS, "Brand#8": "напитки"}
# Tables whose rows take long to prepare.
SPREAD = ("lineitem", "part")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table. Lines and parts that come in fewer splits than there are cores, as one small
    file does, are spread over the cores: names of parts are costly to read, and a file of
    millions of them may still be one split. Enough splits are read as they are."""
    df = spark.read.parquet(os.path.join(folder, f"{table}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in SPREAD and df.rdd.getNumPartitions() < cores else df


def receipts(spark: SparkSession, folder: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Receipts, of a half-open range of days if one is given: it is compared with the stored
    time, so files and row groups outside of it are not read."""
    orders, customer = read(spark, folder, "orders"), read(spark, folder, "customer")
    day = lambda d: F.lit(d.isoformat()).cast(orders.schema["o_orderdate"].dataType)
    if start is not None:
        orders = orders.where(F.col("o_orderdate") >= day(start))
    if end is not None:
        orders = orders.where(F.col("o_orderdate") < day(end))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("c_mktsegment").alias("store"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
        F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("receipt_number"))


def products(spark: SparkSession, folder: str, evidence: bool, named: DataFrame | None = None) -> DataFrame:
    """Part-level columns of a line, of the products `named` by identity only, if given.
    Name evidence is computed here, once per part."""
    parts = _named_parts(spark, folder)
    if named is not None:
        parts = parts.withColumn("identity", identity()).join(named.select("identity"), "identity", "left_semi").drop("identity")
    parts = _search_names(parts)
    return with_name_evidence(parts, "name", "evidence") if evidence else parts


def _search_names(parts: DataFrame) -> DataFrame:
    return parts.withColumn("normalized_name", F.when(F.col("_brand") != "Brand#9", normalize(F.col("name")))).drop("_brand")


def _named_parts(spark: SparkSession, folder: str) -> DataFrame:
    kind, brand = F.col("p_type"), F.col("p_brand")
    base = F.concat_ws(" ", brand, "p_name", F.try_element_at(literal_map(KEYWORD_BRANDS), brand))

    def is_brand(number):
        return brand == f"Brand#{number}"

    size = F.col("p_size").cast("string")
    name = F.when(kind == "LARGE", F.concat(base, F.lit(" "), size, F.lit("00ml"))).when(
        kind == "SMALL", F.when(is_brand(3), base).otherwise(F.concat(base, F.lit(" loose")))).when(
        kind == "PROMO", F.concat(base, F.lit(" 2x"), size, F.lit("0g"))).otherwise(
        F.concat(base, F.lit(" "), size, F.lit("00g")))
    canonical = F.when(kind == "SMALL", F.lit(None)).when(
        kind == "LARGE", F.when(is_brand(2), base).otherwise(F.concat(base, F.lit(" drink")))).when(
        (kind == "MEDIUM") & is_brand(1), F.lit(None)).otherwise(base)
    category = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_CATEGORY.items() for x in p]), kind),
                          F.when(is_brand(5), F.lit("")).when(~is_brand(6), F.lit("promo")))
    return read(spark, folder, "part").select(
        "p_partkey", name.alias("name"), canonical.alias("canonical_name"), category.alias("category"),
        brand.alias("_brand"))


def line_id() -> Column:
    """Line number and a content hash. Unique within a receipt, so lines are keyed by
    (receipt_id, id); no window over the receipt is needed."""
    content = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")],
                          F.col("l_quantity").cast(MONEY).cast("string"),
                          F.col("l_extendedprice").cast(MONEY).cast("string"),
                          F.date_format("l_shipdate", "yyyyMMdd"))
    digits = F.conv(F.substring(F.md5(content), 1, 12), 16, 10).cast("bigint")
    return F.col("l_linenumber").cast("bigint") * F.lit(1 << 48) + digits


def raw_lines(spark: SparkSession, folder: str, evidence: bool = False, line: DataFrame | None = None,
              chosen: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Lines as a parser would hand them over, before the price model; of `chosen` receipts
    and of the products `named` only, if given."""
    line = read(spark, folder, "lineitem") if line is None else line
    if chosen is not None:
        line = line.join(chosen.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
    flag = F.col("l_returnflag")
    total = F.col("l_extendedprice").cast(MONEY)
    line = line.select(
        line_id().alias("id"), F.col("l_orderkey").alias("receipt_id"), F.col("l_partkey").alias("p_partkey"),
        F.col("l_quantity").cast(AMOUNT).alias("quantity"), total.alias("price"), total.alias("line_total"),
        F.when(flag == "A", F.round(total / F.col("l_quantity").cast(AMOUNT), 2)).cast(AMOUNT).alias("unit_price"),
        F.when(flag == "N", F.lit("gab")).alias("quantity_unit"),
        F.when(flag == "N", F.lit("parser")).otherwise(F.lit("derived")).alias("source"),
        F.when(flag == "N", "rule").when(flag == "A", "manual").otherwise("fallback").alias("category_source"),
        (flag == "R").alias("legacy"), (F.col("l_linestatus") == "O").alias("legacy_unknown"))
    return line.join(products(spark, folder, evidence, named), "p_partkey").drop("p_partkey")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Stored lines without the price model: what spend, categories and names need."""
    return raw_lines(spark, folder).select(
        "id", "receipt_id", "name", "canonical_name", "normalized_name", "quantity", "price",
        F.when(~F.col("legacy"), F.col("line_total")).alias("line_total"), "category", "category_source")


def items(spark: SparkSession, folder: str, evidence: bool = False, chosen: DataFrame | None = None,
          named: DataFrame | None = None) -> DataFrame:
    """Stored lines: parsed and derived ones carry a price model, legacy ones do not.

    With `evidence` the name evidence computed per part stays attached. Of `chosen` receipts
    or of the products `named` only the lines are read on, before they are priced.
    """
    no_size = F.lit(None).cast(AMOUNT)
    df = derive_price(raw_lines(spark, folder, evidence=True, chosen=chosen, named=named), evidence="evidence", package_size=no_size,
                      package_unit=F.lit(None).cast("string"), source="source", out="d", warnings=False)
    legacy, unknown = F.col("legacy"), F.col("legacy_unknown")

    def stored(field, name=None):
        return F.when(~legacy, F.col(f"d.{field}")).alias(name or field)

    df = df.select(
        "id", "receipt_id", "name", "canonical_name", "normalized_name", "quantity", "price",
        F.when(~legacy, F.col("line_total")).alias("line_total"), stored("unit_price"),
        F.when(~legacy, F.col("d.quantity_unit")).when(unknown, "unknown").alias("quantity_unit"),
        stored("package_size"), stored("package_unit"), stored("normalized_unit_price"),
        F.when(~legacy, F.col("d.normalized_price_unit")).when(unknown, "unknown").alias("normalized_price_unit"),
        stored("source", "price_parse_source"), stored("confidence", "price_parse_confidence"),
        "category", "category_source", "evidence")
    return df if evidence else df.select(*columns(ITEMS_DDL))


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """Manual category rules of two brands, keyed by product key."""
    keyed = _named_parts(spark, folder).where(F.col("_brand").isin(list(RULE_BRANDS)))
    stamp = F.lit("2001-01-01 00:00:00").cast("timestamp")
    return keyed.select("_brand", F.coalesce("canonical_name", "name").alias("_name")).distinct().select(
        normalize(F.col("_name")).alias("product_key"),
        F.try_element_at(F.create_map(*[F.lit(x) for p in RULE_BRANDS.items() for x in p]), F.col("_brand")).alias("category"),
        F.lit("manual").alias("source"), stamp.alias("created_at"), stamp.alias("updated_at"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every event twice, as a repeated delivery."""
    schema = read(spark, folder, "events").schema
    once = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return once.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(os.path.join(folder, "lineitem.parquet")).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(folder)


def receipt_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts printed in the layout of their store; parsing them must give the lines back."""
    lines = raw_lines(spark, folder).select("id", "receipt_id", "name", "quantity", "price", "category_source").join(
        receipts(spark, folder).select(F.col("id").alias("receipt_id"), "store", "date", "receipt_number"), "receipt_id")
    comma = lambda c: F.translate(c.cast("string"), ".", ",")
    count = F.col("quantity").cast("bigint").cast("string")
    unit = comma(F.round(F.col("price") / F.col("quantity"), 2).cast(MONEY))
    rimi = F.col("store").isin("AUTOMOBILE", "BUILDING")
    reduced = F.col("category_source") == "manual"
    listed = comma(F.when(reduced, F.col("price") + F.lit("0.05").cast(MONEY)).otherwise(F.col("price")).cast(MONEY))
    text = F.when(rimi, F.concat(F.col("name"), F.lit("\n"), count, F.lit(" gab X "), unit, F.lit(" EUR "), listed, F.when(
        reduced, F.concat(F.lit("\nAtl. -0,05\nGala cena "), comma(F.col("price")))).otherwise(""))).otherwise(
        F.concat(F.col("name"), F.lit("\n"), unit, F.lit(" X "), count, F.lit(" gab. "), listed, F.lit(" A"), F.when(
            reduced, F.concat(F.lit("\nAtlaide: (Cena ar atlaidi "), comma(F.col("price")), F.lit(") -0,05 A"))).otherwise("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda r: r["text"]), "\n")
    grouped = lines.withColumn("text", text).groupBy("receipt_id", "store", "date", "receipt_number").agg(
        body.alias("body"), F.sum("price").cast(MONEY).alias("sum"))
    total = comma(F.col("sum"))
    return grouped.select(
        "receipt_number",
        F.when(F.col("store").isin("AUTOMOBILE", "BUILDING"), F.concat(
            F.lit("SIA RIMI LATVIA\nKase Nr. 12\n"), F.col("body"), F.lit("\nKOPA "), total, F.lit("\nLAIKS "), F.col("date"), F.lit(" 12:00"))).otherwise(
            F.concat(F.lit("MAXIMA\nČeks 12/34\n"), F.col("body"), F.lit("\nKopā apmaksai "), total, F.lit("\nDATUMS "),
                     F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "dd.MM.yyyy"))).alias("text"))


def receipt_json(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts as nested documents; those of one store are not marked as synthetic."""
    lines = raw_lines(spark, folder).select("id", "receipt_id", "name", "quantity", "price")
    nested = lines.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "quantity", "price"))).alias("items"),
                                                     F.sum("price").alias("total"))
    head = receipts(spark, folder).select(F.col("id").alias("receipt_id"), "store", "date", "receipt_number")
    return nested.join(head, "receipt_id").select(
        F.col("receipt_number").alias("source"),
        F.to_json(F.struct((F.col("store") != "FURNITURE").alias("synthetic"), F.array(F.struct(
            "date", "store", "total", "receipt_number",
            F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["quantity"].alias("quantity"), i["price"].alias("price"))).alias("items")
        )).alias("receipts"))).alias("json"))


#: Names of goods whose words speak for several categories, for none, or only together.
CONTESTED = [
    "Cāļa šķiņķi grieķu jog. marinādē", "Kausētais siers DZINTARS ar šķiņķi", "Čipsi ar siera garšu", "Zemesrieksti ESTRELLA Čedaras siers",
    "Burgeru maizītes Maiziņš", "Baltmaize kefīra Lielmaize", "Kruasāns ar kakao krēmu", "Ledus tēja FUZETEA citr.-citronz.", "Konservi kaķiem ar tunci",
    "Sviestm. GIGA ar vist. g. gurķi sieru", "Gaļas salāti ar šķiņķi", "Nūd. zupa NONGSHIM KIMCHI RAMYUN", "Saldēti frī kartupeļi AVIKO Steak",
    "BIO biez. RŪDOLFS dārz. rīsi vista 6+", "Papīra iepirkumu maisiņš PALDIES", "Tomātu pasta SPILVA", "Dārzeņi cepšanai HORTEX", "Humoss ar zaļumiem ATLANTIKA",
    "Kuskuss ar dārzeņiem GRACI", "Kukurūzas saldās vālītes vārītas", "Gurķu-sinepju salāti SPILVA", "Pankūkas ar biezpiena pildīj. MĀJAS",
    "Siera uzkoda WELL DONE PREMIUM Pizza", "Pulveris Isostar H&P apelsinu", "Liell. g. uzkoda Beef Jerky Classic WD", "Ķirbis RIEKSTU", "Zobu birste COLGATE Ultra Soft 1+1",
]


def contested_names(spark: SparkSession, folder: str) -> DataFrame:
    """The part names behind names that the classifier's order, pairs and guards decide."""
    number = F.pmod(F.col("p_partkey"), F.lit(len(CONTESTED))).cast("int")
    return read(spark, folder, "part").select(F.concat_ws(" ", F.get(F.array(*[F.lit(n) for n in CONTESTED]), number), "p_name").alias("name"))


#: Names of all contamination classes but service_line, put before the part names of lines.
SPOILED = ["Piens 1, 5L", "Siers lkg", "Sula 500m1", "Čeks", "Kase Nr. 12", "Rīsi 8x125g", "sviestu250g", "Olas 6gab. 300g", "Piens — ", "Piens 1L",
           "Sula 2, 25L", "Cepumi 3+1", "Maxima"]


def spoiled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as a faulty parser might leave them: (receipt_id, id, name)."""
    number = F.pmod(F.col("p_partkey"), F.lit(len(SPOILED))).cast("int")
    names = read(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", F.get(F.array(*[F.lit(n) for n in SPOILED]), number), "p_name").alias("name"))
    return read(spark, folder, "lineitem").join(names, "l_partkey").select(
        F.col("l_orderkey").cast("bigint").alias("receipt_id"), F.col("l_linenumber").cast("bigint").alias("id"), "name")
