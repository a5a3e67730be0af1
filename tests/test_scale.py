"""Costly steps are spread over the cores and compiled in pieces."""

from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.columns import one_space
from tillroll.functions.price import derive_price
from tillroll.functions.receipts import name_issue, repair_text
from tillroll.sources import tables
from tillroll.sources.receipt_text import parse_documents

LINE = ("name string, quantity decimal(18,4), line_total decimal(14,2), unit_price decimal(18,4), quantity_unit string, "
        "package_size decimal(18,4), package_unit string, price_parse_source string")


def test_parts_of_one_small_file_are_spread(spark, tmp_path):
    rows = [(i, f"part {i}") for i in range(100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    parts = tables.read(spark, str(tmp_path), "part")
    assert parts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(tuple(r) for r in parts.collect()) == rows


def test_steps_of_the_price_model_are_compiled_by_themselves(spark, tmp_path):
    row = ("Piens 1L", Decimal(2), Decimal("3.00"), None, "gab", None, None, "parser")
    spark.createDataFrame([row], LINE).write.parquet(str(tmp_path / "lines"))
    df = derive_price(spark.read.parquet(str(tmp_path / "lines")))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    steps = [line for line in plan if line.strip().startswith("+- Project")]  # compiled stages are marked *(n)
    assert len(steps) >= 6, plan
    derived = df.collect()[0].derived
    assert (derived.normalized_unit_price, derived.normalized_price_unit) == (Decimal("1.5000"), "eur_per_l")


def test_a_line_of_a_receipt_is_looked_at_once(spark):
    df = parse_documents(spark.createDataFrame([("1", "x")], "receipt_number string, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("saglabajiet") == 1, plan.count("saglabajiet")


def test_cheap_looks_at_a_text_lose_no_match(spark):
    names = {" a\tb  c　": "a b c", "a b": "a b", "ā  š": "ā š", "": "", "x\u0085y": "x y"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", one_space(F.col("name")).alias("one")).collect()
    assert {r.name: r.one for r in rows} == names
    texts = {"1, 5 l": "1,5 l", "1,\n5 kg": "1,5 kg", "a — b": "a - b", "1,5 l": "1,5 l"}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", repair_text(F.col("text")).alias("r")).collect()
    assert {r.text: r.r for r in rows} == texts
    issues = {"lKg": "ocr_lkg", "5 M1": "ocr_m1", "1, 50 Kg": "unsafe_decimal_corruption", "Piens 1L": None}
    rows = spark.createDataFrame([(n,) for n in issues], "name string").select("name", name_issue(F.col("name")).alias("i")).collect()
    assert {r.name: r.i for r in rows} == issues


def test_lines_are_priced_without_the_warnings_that_none_reads(spark, tmp_path):
    rows = [("Piens 1L", Decimal(q), Decimal(t), u and Decimal(u), unit, None, None, source) for q, t, u, unit, source in [
        (2, "3.00", None, "gab", "parser"), (2, "3.00", "1.20", "gab", "parser"), (2, "3.00", "1.50", None, "derived"), (0, "3.00", "1.50", "kg", "parser")]]
    df = spark.createDataFrame(rows, LINE)
    whole = [r.derived.asDict() for r in derive_price(df).collect()]
    lean = [r.derived.asDict() for r in derive_price(df, warnings=False).collect()]
    assert [{k: v for k, v in r.items() if k != "warnings"} for r in whole] == lean
    assert [("line_total_unit_price_mismatch" in r["warnings"], r["confidence"]) for r in whole] == [
        (False, Decimal("0.95")), (True, Decimal("0.70")), (False, Decimal("0.85")), (False, Decimal("0.95"))]
    for table, row in {"lineitem": "1L l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, 2D l_quantity, 3D l_extendedprice, 'N' l_returnflag, 'O' l_linestatus, timestamp'1998-01-01' l_shipdate",
                       "part": "1L p_partkey, 'a' p_name, 'Brand#1' p_brand, 'LARGE' p_type, 1 p_size"}.items():
        spark.sql(f"SELECT {row}").write.parquet(str(tmp_path / f"{table}.parquet"))
    plan = tables.items(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "unknown_quantity_unit" not in plan
