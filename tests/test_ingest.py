import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.schema import ITEMS_DDL, RECEIPTS_DDL, RULES_DDL
from tillroll.sources import ingest, manifest, publish, receipt_text
from tillroll.streaming.jobs import document_stream, ingest_stream

GOLDEN = """MAXIMA
Dzeramais ūdens AQUA negāzēts 5L
0,99 X 1 gab. 0,99 A
Atlaide: (Cena ar atlaidi 0,97) -0,02 A
BIO biez. RŪDOLFS dārz. rīsi vista 6+
110g
1,78 X 1 gab. 1,78 B
Atlaide: (Cena ar atlaidi 1,74) -0,04 B
Nūd. zupa NONGSHIM KIMCHI RAMYUN 120g
1,59 X 2 gab. 3,18 A
Atlaide: (Cena ar atlaidi 3,10) -0,08 A
Vīns ZIBOMARE Zibibbo 12% 0,75L
6,99 X 1 gab. 6,99 A
Papīra iepirkumu maisiņš PALDIES
0,19 X 1 gab. 0,19 A
SUMMA apmaksai 12,99
Kopā apmaksai 12,99
LAIKS 2026-08-07"""
RIMI = """SIA RIMI LATVIA
Iepriekšējs teksts
Kase Nr. 12
Piens 1, 5L
1 gab X 1,99 EUR 1,99
Siers
Gouda 500g
2 gab X 3,00 EUR 6,00
Atl. -1,00
Gala cena 5,00
Banāni kg
0,742 kg X 1,50 EUR/kg
KOPA 8,10
LAIKS 2026.08.07 12:00"""


def parse(spark, *texts):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "receipt_number string, text string")
    return receipt_text.parse_documents(docs)


def test_golden_maxima(spark):
    r, = parse(spark, GOLDEN).collect()
    assert (r.store, r.date, r.total, r.status) == ("MAXIMA", "2026-08-07", Decimal("12.99"), "ok")
    assert [(i.name, float(i.price), float(i.quantity), i.quantity_unit) for i in r["items"]] == [
        ("Dzeramais ūdens AQUA negāzēts 5L", .97, 1, "piece"), ("BIO biez. RŪDOLFS dārz. rīsi vista 6+ 110g", 1.74, 1, "piece"),
        ("Nūd. zupa NONGSHIM KIMCHI RAMYUN 120g", 3.10, 2, "piece"), ("Vīns ZIBOMARE Zibibbo 12% 0,75L", 6.99, 1, "piece")]


def test_golden_rimi(spark):
    r, = parse(spark, RIMI).collect()
    assert (r.store, r.date, r.total) == ("RIMI", "2026-08-07", Decimal("8.10"))
    assert [(i.name, float(i.price), float(i.quantity), i.quantity_unit) for i in r["items"]] == [
        ("Piens 1,5L", 1.99, 1, "gab"), ("Siers Gouda 500g", 5.0, 2, "gab"), ("Banāni kg", 1.11, .742, "kg")]


def test_layout_and_rejects(spark):
    texts = ["MAXIMA\nRimi piens 1L\n1,00 X 1 gab. 1,00 A\n01.02.2026", "", "nothing here", "SIA RIMI\nPiens 1L\n1,00 X 1 gab. 1,00 A"]
    out = {r.receipt_number: (r.store, r.status, r.date, r.total) for r in parse(spark, *texts).collect()}
    assert out["d0"] == ("MAXIMA", "ok", "2026-02-01", Decimal("1.00"))  # a shop name inside a product is no header
    assert out["d1"][1] == "empty_text" and out["d2"][1] == "no_items"
    assert out["d3"][:2] == ("RIMI", "no_items")


def test_headers_do_not_leak_into_names(spark):
    texts = [f"MAXIMA\n{head}\nPiens 1L\n1,00 X 1 gab. 1,00 A" for head in ("Čeks 123/456", "123/456", "Kase Nr. 12")]
    assert [[i.name for i in r["items"]] for r in parse(spark, *texts).collect()] == [["Piens 1L"]] * 3


def empty(spark, ddl):
    return spark.createDataFrame([], ddl)


def test_ingest_is_idempotent_and_rules_win(spark):
    rules = spark.createDataFrame([("piens 1500ml", "напитки")], "product_key string, category string")
    parsed = parse(spark, GOLDEN, RIMI)
    documents = receipt_text.parsed_documents(parsed)
    receipts, items = ingest.ingest(documents, empty(spark, RECEIPTS_DDL), rules, F.lit("parser"))
    assert receipts.count() == 2 and items.columns == [f.split()[0] for f in ITEMS_DDL.replace("(18,4)", "").replace("(14,2)", "").replace("(4,2)", "").split(", ")]
    out = {r.name: r for r in items.collect()}
    milk = out["Piens 1,5L"]
    assert (milk.category, milk.category_source, milk.normalized_price_unit) == ("безалкогольные напитки", "inherited", "eur_per_l")
    assert out["Nūd. zupa NONGSHIM KIMCHI RAMYUN 120g"].normalized_unit_price == Decimal("12.9167")
    again, more = ingest.ingest(documents, receipts, rules, F.lit("parser"))
    assert again.count() == 0 and more.count() == 0


def test_one_document_of_a_number_is_kept_with_its_own_lines(spark):
    texts = ["MAXIMA\nPiens 1L\n1,00 X 1 gab. 1,00 A\n01.02.2026", "MAXIMA\nSiers 1kg\n2,00 X 1 gab. 2,00 A\nMaize 1kg\n3,00 X 1 gab. 3,00 A\n01.02.2026"]
    docs = spark.createDataFrame([("r1", texts[0]), ("r1", texts[1]), ("r1", texts[0]), ("r2", texts[1]), (None, texts[0])], "receipt_number string, text string")
    receipts, items = ingest.ingest(receipt_text.parsed_documents(receipt_text.parse_documents(docs)), empty(spark, RECEIPTS_DDL), empty(spark, RULES_DDL), F.lit("parser"))
    assert {(r.receipt_number, float(r.total)) for r in receipts.collect()} == {("r1", 1.0), ("r2", 5.0)}
    assert sorted(float(r.price) for r in items.collect()) == [1.0, 2.0, 3.0]
    assert items.select("receipt_id", "id").distinct().count() == 3


def test_nested_source(spark, tmp_path):
    receipt = {"date": "2026-01-01", "store": "A", "total": 2.5, "receipt_number": "n1", "items": [{"name": "Piens 1L", "quantity": 1, "price": 2.5}]}
    cases = {"good": {"synthetic": True, "receipts": [receipt]}, "real": {"synthetic": False, "receipts": [receipt]}, "text": {"synthetic": "true", "receipts": [receipt]},
             "none": {"synthetic": True, "receipts": []}, "bad": {"synthetic": True, "receipts": [{**receipt, "receipt_number": " "}, {**receipt, "receipt_number": "n2", "items": []}]},
             "twice": {"synthetic": True, "receipts": [{**receipt, "receipt_number": "n3"}] * 2}}
    for name, content in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    valid = ingest.validate_nested(ingest.read_nested(spark, str(tmp_path)))
    out = {}
    for r in valid.collect():
        out.setdefault(r.source, []).append(r.error)
    assert out == {"good.json": [None], "real.json": ["not_synthetic"], "text.json": ["not_synthetic"], "none.json": ["no_receipts"],
                   "bad.json": ["receipt_number", "items"], "twice.json": ["duplicate_number"] * 2}
    receipts, items = ingest.ingest(ingest.nested_documents(valid), empty(spark, RECEIPTS_DDL), empty(spark, RULES_DDL))
    assert receipts.first().total == Decimal("2.50") and items.first().category == "молочные продукты и альтернативы"


def test_stream_ingest_adds_each_receipt_once(spark, tmp_path):
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    rules = empty(spark, RULES_DDL)
    (source / "r1.txt").write_text(GOLDEN)
    ingest_stream(document_stream(spark, str(source)), target, rules, log).awaitTermination()
    (source / "r2.txt").write_text(RIMI)
    (source / "r3.txt").write_text("nothing")
    ingest_stream(document_stream(spark, str(source)), target, rules, log).awaitTermination()
    assert sorted(r.receipt_number for r in spark.read.parquet(f"{target}/receipts").collect()) == ["r1", "r2"]
    ingest_stream(document_stream(spark, str(source)), target, rules, log + "-new").awaitTermination()  # everything again
    assert spark.read.parquet(f"{target}/items").count() == 7


def test_manifest(spark, tmp_path):
    head = ",".join(manifest.COLUMNS)
    rows = ["A,a,яйца,x:1,1,LABEL_ONLY,\"{\"\"identity_row_count\"\":1}\",,,why,HIGH", "B,b,яйца,x:1,1,LABEL_ONLY,{},,,why,LOW",
            "C,c,old,x:1,1,LABEL_ONLY,{},,,why,HIGH", "D,d,яйца,x:1,one,LABEL_ONLY,{},,,why,HIGH", "E,e,яйца,x:1,1,DROP,{},,,why,HIGH",
            "F,f,яйца,x:1,1,LABEL_ONLY,{},5,,why,HIGH", "G,g,яйца,x:1,1,LABEL_ONLY,\"{\"\"other\"\":1}\",,,why,HIGH",
            "H,h,яйца,x:1,1,LABEL_ONLY,{},,,why,HIGH", "H,h,яйца,x:1,1,LABEL_ONLY,{},,,why,HIGH"]
    (tmp_path / "m.csv").write_text("\n".join([head, *rows]))
    out = manifest.validate_manifest(manifest.read_manifest(spark, str(tmp_path / "m.csv")))
    assert {r.effective_product: r.error for r in out.collect()} == {
        "A": None, "B": "confidence_not_high", "C": "target_not_approved", "D": "invalid_predicate", "E": "unknown_operation",
        "F": "has_exclusions", "G": "unsupported_predicate", "H": "identity_duplicated"}
    assert out.where("effective_product = 'A'").first().predicates.identity_row_count == 1
    (tmp_path / "bad.csv").write_text("a,b\n1,2")
    with pytest.raises(ValueError):
        manifest.read_manifest(spark, str(tmp_path / "bad.csv"))
    _, odd = manifest.project_csv(spark, str(tmp_path / "bad.csv"), "a", spark.createDataFrame([("3",)], "a string"))
    assert sorted((r.a, r.side) for r in odd.collect()) == [("1", "unexpected"), ("3", "missing")]


def test_publish_refuses_violations(spark, tmp_path):
    root = str(tmp_path / "t")
    assert publish.publish(spark.range(3), root) == 1
    assert publish.publish(spark.range(4), root, lambda old, new: old.join(new, "id", "left_anti")) == 2
    with pytest.raises(ValueError):
        publish.publish(spark.range(2), root, lambda old, new: old.join(new, "id", "left_anti"))
    assert publish.current_version(spark, root) == 2 and publish.read_version(spark, root).count() == 4


def test_documents_are_read_once(spark):
    """Receipts, lines and names of lines come from one reading, as parsing is the work."""
    seen = spark.sparkContext.accumulator(0)

    def counted(day: str) -> str:
        seen.add(1)
        return day

    lines = "array<struct<line_no: bigint, name: string, quantity: decimal(18,4), quantity_unit: string, unit_price: decimal(18,4), price: decimal(14,2)>>"
    parsed = spark.createDataFrame([(f"r{i % 4}", "2026-01-01", "A", Decimal(i), [(1, f"Piens {i}L", Decimal(1), "piece", Decimal(i), Decimal(i))]) for i in range(1, 6)],
                                   f"receipt_number string, date string, store string, total decimal(14,2), items {lines}")
    documents = parsed.withColumn("date", F.udf(counted, "string")("date"))
    receipts, items = ingest.ingest(documents, empty(spark, RECEIPTS_DDL), empty(spark, RULES_DDL), F.lit("parser"))
    assert sorted((r.receipt_number, int(r.total)) for r in receipts.collect()) == [("r0", 4), ("r1", 1), ("r2", 2), ("r3", 3)]
    assert sorted(r.name for r in items.collect()) == ["Piens 1L", "Piens 2L", "Piens 3L", "Piens 4L"] and seen.value == 5
