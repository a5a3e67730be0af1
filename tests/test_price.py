from decimal import Decimal

import pytest

from tillroll.functions.price import derive_price

SCHEMA = ("name string, quantity string, line_total string, unit_price string, quantity_unit string, "
          "package_size string, package_unit string, price_parse_source string")


def derive(spark, *cases):
    rows = [tuple(None if c.get(k) is None else str(c[k]) for k in (
        "name", "quantity", "line_total", "unit_price", "quantity_unit", "package_size", "package_unit", "source"))
        for c in cases]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    return [r.derived for r in derive_price(df).orderBy("i").collect()]


# name, quantity, total, listed, unit, size, size unit, source -> unit, size, base, price, price unit, source, confidence
CASES = [
    (dict(name="Siers", quantity=.742, unit_price=7.99, line_total=5.93, quantity_unit="kg", source="parser"),
     ("kg", None, "unknown", 7.9919, "eur_per_kg", "parser", .95)),
    (dict(name="Siers 750g", quantity=2, unit_price=4.5, line_total=9, quantity_unit="gab", source="parser"),
     ("piece", 750, "g", 6, "eur_per_kg", "parser", .95)),
    (dict(name="Siers kg", quantity=.742, unit_price=7.99, line_total=5.93),
     ("kg", None, "unknown", 7.9919, "eur_per_kg", "weighted_inference", .75)),
    (dict(name="Āboli kg 2. šķ.", quantity=.742, unit_price=7.99, line_total=5.93),
     ("kg", None, "unknown", 7.9919, "eur_per_kg", "weighted_inference", .75)),
    (dict(name="Siers kg", quantity=.742, unit_price=5, line_total=5.93),
     ("unknown", None, "unknown", None, "unknown", "unresolved", None)),
    (dict(name="Siers kg", quantity=.742, line_total=5.93),
     ("unknown", None, "unknown", None, "unknown", "unresolved", None)),
    (dict(name="Siers 750g", quantity=1, unit_price=4.5, line_total=4.5),
     ("piece", 750, "g", 6, "eur_per_kg", "package_name", .85)),
    (dict(name="Siers 750g", quantity=3, unit_price=4.5, line_total=13.5),
     ("piece", 750, "g", 6, "eur_per_kg", "package_name", .85)),
    (dict(name="Olas 30gab", quantity=1, line_total=2.99),
     ("piece", 30, "piece", .0997, "eur_per_piece", "package_name", .85)),
    (dict(name="Olas", quantity=2, line_total=4),
     ("piece", None, "unknown", 2, "eur_per_piece", "inferred_piece", .70)),
    (dict(name="KIT KAT 2gab", quantity=1, line_total=1.20),
     ("piece", 2, "piece", .60, "eur_per_piece", "package_name", .85)),
    (dict(name="Miltu maiss 45kg", quantity=.5, unit_price=20, line_total=10, quantity_unit="kg", source="parser"),
     ("kg", None, "unknown", 20, "eur_per_kg", "parser", .95)),
    (dict(name="Siers 45kg", quantity=2, unit_price=4.5, line_total=9, quantity_unit="gab", package_size=750,
          package_unit="g", source="parser"), ("piece", 750, "g", 6, "eur_per_kg", "parser", .95)),
    (dict(name="Piens 1,5L", quantity=1, line_total=3), ("piece", 1500, "ml", 2, "eur_per_l", "package_name", .85)),
    (dict(name="BIO biez. 6+110g", quantity=1, line_total=1.48, quantity_unit="piece", source="parser"),
     ("piece", 110, "g", 13.4545, "eur_per_kg", "parser", .95)),
    (dict(name="Zupa 120g", quantity=2, line_total=3.10, unit_price=1.59, quantity_unit="piece", source="parser"),
     ("piece", 120, "g", 12.9167, "eur_per_kg", "parser", .70)),
    (dict(name="Siers 45kg", quantity=1, line_total=4, quantity_unit="piece", package_size=1, package_unit="kg",
          source="manual_correction"), ("piece", 1000, "g", 4, "eur_per_kg", "manual_correction", .85)),
]


def test_price_models(spark):
    out = derive(spark, *[c for c, _ in CASES])
    for (case, want), got in zip(CASES, out):
        unit, size, base, price, per, source, confidence = want
        assert (got.quantity_unit, got.package_unit, got.normalized_price_unit, got.source) == (
            unit, base, per, source), case
        for value, expected in ((got.package_size, size), (got.normalized_unit_price, price), (got.confidence, confidence)):
            assert value is None if expected is None else value == Decimal(str(expected)), (case, got)


@pytest.mark.parametrize("warning, names", [
    ("ambiguous_package_size", ["Burgeru maizītes 6gab. 300g", "Piens 1, 5L", "Miltu maiss 45kg", "sviestu250g",
                                "Masāžas bumbiņu komplekts 2gab.", "Mānekļi PHILIPS AVENT silik. 0-6m. 2gab.",
                                "Mānekļ. PHILIPS AVENT Ultr. Air 6-18m. 2gb.", "Zīdaiņu vannas rotaļlietas FOXTER 8gab."]),
    ("multipack_unresolved", ["Olas 2x10gab", "Biezenis 6×110g"]),
    ("invalid_package_size", ["Olas 0gab", "Olas 2,5gab"]),
    ("age_package_ambiguous", ["Biezenis 40+ 110g", "Biezenis 6+ 110g 200g", "A 6 ++ 110g"]),
    ("weighted_measurement_ambiguous", ["Āboli 75+ kg"]),
    ("service_line", ["Papildus depozīta maksa", "paper bag large", "Papīra iepirkumu maisiņš PALDIES"]),
    ("parser_contamination", ["Čeks piens 1L"]),
])
def test_rejections_fail_closed(spark, warning, names):
    for got in derive(spark, *[dict(name=n, quantity=1, line_total=4) for n in names]):
        assert warning in got.warnings
        assert got.normalized_unit_price is None and got.confidence is None
        assert got.source == ("service_line" if warning == "service_line" else "rejected")


def test_mismatch_needs_two_cents(spark):
    near, far = derive(spark, dict(name="A 1kg", quantity=3, line_total=1.01, unit_price=.33),
                       dict(name="A 1kg", quantity=3, line_total=1.02, unit_price=.33))
    assert "line_total_unit_price_mismatch" not in near.warnings and near.confidence == Decimal("0.85")
    assert "line_total_unit_price_mismatch" in far.warnings and far.confidence == Decimal("0.70")


def test_lenient_numbers(spark):
    comma, blank = derive(spark, dict(name="Siers kg", quantity="0,5", line_total="2,00", unit_price="4,00"),
                          dict(name="Siers", quantity=None, line_total=None, unit_price="x"))
    assert comma.normalized_unit_price == Decimal("4.0000")
    assert blank.quantity == 1 and blank.line_total == 0 and blank.unit_price is None
