"""Price history, trend and stores on hand-made observations."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.plans import prices
from tillroll.plans.products import search_products

FIELDS = ("id long, receipt_id long, name string, canonical_name string, normalized_name string, store string, date string, "
          "quantity decimal(18,4), price decimal(14,2), line_total decimal(14,2), unit_price decimal(18,4), quantity_unit string, "
          "package_size decimal(18,4), package_unit string, normalized_unit_price decimal(18,4), normalized_price_unit string, "
          "price_parse_source string, price_parse_confidence decimal(4,2), category string, category_source string")


def row(i, price, date="2026-01-10", **over):
    price = Decimal(str(price))
    base = dict(id=i, receipt_id=i, name="Siers 1kg", canonical_name=None, normalized_name="siers 1000g", store="A", date=date,
                quantity=Decimal(1), price=price, line_total=price, unit_price=price, quantity_unit="piece",
                package_size=Decimal(1000), package_unit="g", normalized_unit_price=price, normalized_price_unit="eur_per_kg",
                price_parse_source="parser", price_parse_confidence=Decimal("0.95"), category="яйца", category_source="rule")
    base.update(over)
    return tuple(base[f.split()[0]] for f in FIELDS.split(", "))


def observations(spark, rows):
    return spark.createDataFrame(rows, FIELDS).withColumn("identity", F.coalesce("canonical_name", "name"))


def deviation(spark, rows):
    out = prices.deviation_report(prices.price_deviation(prices.price_lines(observations(spark, rows))))
    return {int(r.line_id): r for r in out.collect()}


def test_prior_median_and_future(spark):
    out = deviation(spark, [row(i, 2, f"2026-01-0{i}") for i in (1, 2, 3)] + [row(4, 4, "2026-01-05"), row(5, 100, "2026-02-01")])
    assert (out[4].status, out[4].prior_count, out[4].median_price, out[4].deviation_percent) == ("MORE_EXPENSIVE_THAN_USUAL", 3, 2.0, 100.0)
    assert out[3].reason == "insufficient_prior_history" and out[3].prior_count == 2 and out[3].remaining == 1
    assert out[3].evidence == "NOT_ENOUGH_HISTORY"


@pytest.mark.parametrize("price, status", [("11.50", "MORE_EXPENSIVE_THAN_USUAL"), ("11.49", "NORMAL"), ("9.00", "CHEAPER_THAN_USUAL"), ("9.01", "NORMAL")])
def test_limits_are_inclusive(spark, price, status):
    out = deviation(spark, [row(i, 10, f"2026-01-0{i}") for i in (1, 2, 3)] + [row(4, price, "2026-01-09")])
    assert out[4].status == status


def test_same_day_order_and_window(spark):
    day = "2026-06-30"
    out = deviation(spark, [row(1, 10, "2026-01-01"), row(2, 10, "2026-01-01"), row(3, 10, day), row(4, 10, day), row(5, 10, day),
                            row(6, 10, day, receipt_id=5), row(7, 10, "2026-07-01", receipt_id=1)])
    assert out[5].prior_count == 4  # two old ones exactly 180 days back, two of the day
    assert out[6].prior_count == 5  # same receipt, earlier line
    assert out[7].prior_count == 4  # the old ones have left the window


@pytest.mark.parametrize("over, reason", [
    (dict(normalized_unit_price=None), "missing_normalized_price"), (dict(unit_price=None), "missing_price_evidence"),
    (dict(line_total=Decimal(0)), "non_positive_price_evidence"), (dict(normalized_unit_price=Decimal("10000.01")), "normalized_price_out_of_range"),
    (dict(price_parse_confidence=Decimal("0.74")), "low_confidence"), (dict(normalized_price_unit="eur_per_m"), "unsupported_unit"),
    (dict(price_parse_source="inferred_piece"), "unsupported_source"), (dict(store=" "), "missing_store"), (dict(date=""), "invalid_date"),
    (dict(unit_price=Decimal("9.97")), "arithmetic_mismatch"), (dict(name="Papildus depozīta maksa"), "service_line"),
    (dict(name="Čeks siers 1kg"), "parser_contamination"), (dict(name="Siers 2x1kg"), "unresolved_multipack"),
    (dict(name="Siers 1kg 2kg"), "ambiguous_measurement"), (dict(date="2026-1-3"), "invalid_date_or_ordering"),
    (dict(name="Dilles 100g"), "unresolved_product_identity"),
])
def test_reasons(spark, over, reason):
    assert deviation(spark, [row(1, 10, **over)])[1].reason == reason


def test_manual_and_raw_names_do_not_mix(spark):
    out = deviation(spark, [row(1, 10), row(2, 10, name="x 1kg", canonical_name="Siers 1kg")])
    assert {r.reason for r in out.values()} == {"unresolved_product_identity"}


def test_monthly_trend(spark):
    lines = prices.price_lines(observations(spark, [row(1, 2, "2026-06-01"), row(2, 100, "2026-06-02"), row(3, 4, "2026-06-03"), row(4, 8, "2026-07-01")]))
    assert [(r.month, r.median_price, r.observation_count) for r in prices.price_trend(lines).orderBy("month").collect()] == [
        ("2026-06", 4.0, 3), ("2026-07", 8.0, 1)]
    mixed = prices.price_lines(observations(spark, [row(1, 2), row(2, 2, normalized_price_unit="eur_per_piece")]))
    assert [r.reason for r in prices.price_trend(mixed).collect()] == ["incompatible_price_units"]


@pytest.mark.parametrize("a, b, level, cheapest, gap, strong", [
    ((10, 12, 14), (12, 15, 18), "COMPARABLE", "A", 20.0, True), ((10, 14), (12, 16), "LIMITED", "A", 14.3, False),
    ((10,), (12,), "PRELIMINARY", None, None, False), ((10, 10), (10, 10), "LIMITED", None, None, False)])
def test_store_comparison(spark, a, b, level, cheapest, gap, strong):
    rows = [row(i, p, store="A") for i, p in enumerate(a)] + [row(10 + i, p, store="B") for i, p in enumerate(b)]
    out = prices.store_comparison(prices.price_lines(observations(spark, rows))).collect()
    assert [(r.evidence_level, r.cheapest_store, r.difference_percent, r.strong_claim_allowed) for r in out] == [(level, cheapest, gap, strong)]


def test_store_reasons(spark):
    one = prices.store_comparison(prices.price_lines(observations(spark, [row(i, 10) for i in range(3)])))
    assert [r.reason for r in one.collect()] == ["only_one_store"]
    two = prices.store_comparison(prices.price_lines(observations(spark, [row(1, 10), row(2, 10, store="B", price_parse_confidence=Decimal("0.5"))])))
    assert [r.reason for r in two.collect()] == ["insufficient_comparable_prices"]


def test_search_prefers_exact(spark):
    items = spark.createDataFrame([("b siers", None, None), ("siers", None, None), ("A Siers", None, None)], "name string, canonical_name string, normalized_name string")
    assert [r[0] for r in search_products(items, "siers").collect()] == ["siers", "A Siers", "b siers"]
