from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from test_prices import FIELDS, row
from test_spellings import keys_follow_distinct
from tillroll import vocabulary as V
from tillroll.functions.price import units_comparable
from tillroll.operators.snapshots import diff_violations, table_diff
from tillroll.plans import maintenance
from tillroll.schema import RULES_DDL, audit_constraints, conform
from tillroll.sources.manifest import PREDICATES

BLANK = dict(line_total=None, unit_price=None, quantity_unit=None, package_size=None, package_unit=None,
             normalized_unit_price=None, normalized_price_unit=None, price_parse_source=None, price_parse_confidence=None)


def items(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def test_backfill_fills_only_gaps_and_is_idempotent(spark):
    df = items(spark, [
        row(1, 3, name="Coca-Cola 500ml", quantity=Decimal(2), canonical_name="Cola", category="manual label", **BLANK),
        row(2, 3, name="Papildus depozīta maksa", **{**BLANK, "quantity_unit": "piece", "normalized_unit_price": Decimal(3)}),
        row(3, 3, name="Siers", **BLANK), row(4, 3, name="Siers 2x1kg"), row(5, 3, name="Siers 1kg", **{**BLANK, "package_size": Decimal(7), "package_unit": "g"})])
    plan = maintenance.backfill_plan(df)
    out = {r.id: r.plan for r in plan.collect()}
    assert (out[1].package_size, out[1].package_unit, out[1].normalized_price_unit, out[1].price_parse_source) == (500, "ml", "eur_per_l", "package_name")
    assert out[1].normalized_unit_price == Decimal("3.0000")
    assert (out[2].price_parse_source, out[2].normalized_unit_price, out[2].quantity_unit) == ("service_line", None, "unknown")
    assert out[4].conflict == "multipack" and out[5].package_size == 7
    new = maintenance.backfill_apply(plan, ["package_name"])
    first = {r.id: r for r in new.collect()}
    assert first[1].canonical_name == "Cola" and first[1].category == "manual label" and first[3].price_parse_source is None
    assert maintenance.backfill_apply(maintenance.backfill_plan(new), ["package_name"]).exceptAll(new).count() == 0
    with pytest.raises(ValueError):
        maintenance.backfill_apply(plan, ["parser"])


def test_review_list_is_preserved(spark):
    df = items(spark, [row(1, 3)])
    plan = maintenance.backfill_plan(df, spark.createDataFrame([(1, 1)], "receipt_id long, id long"))
    assert plan.first().plan.conflict == "manual_review"


def test_rules_and_lines(spark):
    rules = spark.createDataFrame([("a", "яйца")], "product_key string, category string").withColumns({
        "source": F.lit("manual"), "created_at": F.lit("2020-01-01").cast("timestamp"), "updated_at": F.lit("2020-01-01").cast("timestamp")})
    out = maintenance.upsert_rules(rules, spark.createDataFrame([("a", "мясо"), ("b", "кот")], "product_key string, category string"), "2021-01-01 00:00:00")
    assert {(r.product_key, r.category, r.created_at.year, r.updated_at.year) for r in out.collect()} == {
        ("a", V.MEAT, 2020, 2021), ("b", V.PETS, 2021, 2021)}
    df = items(spark, [row(1, 3), row(2, 3, name="other")])
    assert [r.category for r in maintenance.override_lines(df, spark.createDataFrame([(1, 1, "nonsense"), (2, 2, "мясо")], "receipt_id long, id long, category string")).orderBy("id").collect()] == ["яйца", V.MEAT]
    merged = maintenance.merge_products(df, spark.createDataFrame([("other", " Siers ")], "selected string, canonical string"))
    assert [r.canonical_name for r in merged.orderBy("id").collect()] == [None, "Siers"]


def test_recategorize_scope(spark):
    df = items(spark, [row(1, 3, name="Piens", category=""), row(2, 3, name="kg", category=None), row(3, 3, name="Piens", category="x")])
    assert [r.category for r in maintenance.recategorize(df).orderBy("id").collect()] == [V.DAIRY, "прочее", "x"]
    assert [r.category for r in maintenance.recategorize(df, overwrite=True).orderBy("id").collect()] == [V.DAIRY, "прочее", V.DAIRY]


@pytest.mark.parametrize("unit, size, base, error", [
    ("piece", "500", "g", None), ("kg", None, None, None), ("box", None, None, "unsupported_quantity_unit"), ("piece", "1", "m", "unsupported_package_unit"),
    ("piece", "x", "g", "package_size_not_a_number"), ("piece", "0", "g", "package_size_not_positive"), ("piece", "5", None, "size_and_unit_belong_together"),
    ("kg", "5", "g", "no_package_for_a_physical_unit"), ("piece", "20001", "g", "package_size_too_large"), ("piece", "2.5", "piece", "pieces_must_be_whole")])
def test_proposals(spark, unit, size, base, error):
    df = items(spark, [row(1, 3, name="Siers", price_parse_confidence=Decimal("0.70"), price_parse_source="inferred_piece", package_size=None, package_unit="unknown")])
    proposal = spark.createDataFrame([(1, 1, unit, size, base)], "receipt_id long, id long, quantity_unit string, package_size string, package_unit string")
    r = maintenance.correction_previews(df, proposal).first()
    assert r.error == error and (not r.eligible_before)
    if error is None:
        assert r.eligible_after and r.after.confidence == Decimal("0.85")


def test_strong_evidence_is_not_corrected(spark):
    df = items(spark, [row(1, 3, store="")])
    proposal = spark.createDataFrame([(1, 1, "piece", None, None)], "receipt_id long, id long, quantity_unit string, package_size string, package_unit string")
    assert maintenance.correction_previews(df, proposal).first().error == "not_correctable:stronger_evidence_exists"


def test_only_proposed_lines_are_joined_to_their_receipt(spark):
    """Each proposal of a line gives a row; the planner finds the lines before store and date are added."""
    df = items(spark, [row(i, 3, name="Siers", price_parse_confidence=Decimal("0.70"), price_parse_source="inferred_piece", package_size=None, package_unit="unknown")
                       for i in (1, 2, 3)])
    lines = df.drop("date", "store").join(df.select("receipt_id", "date", "store").dropDuplicates(["receipt_id"]), "receipt_id")
    proposals = spark.createDataFrame([(1, 1, "piece", "250", "g"), (1, 1, "piece", "x", "g"), (9, 9, "piece", "250", "g"), (None, 1, "piece", "250", "g")],
                                      "receipt_id long, id long, quantity_unit string, package_size string, package_unit string")
    out = maintenance.correction_previews(lines, proposals)
    joins = [kind for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() for kind in ("Inner", "LeftSemi") if f"Join {kind}," in line]
    assert joins == ["Inner", "Inner", "LeftSemi"]
    assert sorted((r.receipt_id, r.id, r.error or "") for r in out.collect()) == [(1, 1, ""), (1, 1, "package_size_not_a_number")]


def test_repair_reaches_a_fixed_point(spark):
    df = items(spark, [row(1, 10, unit_price=Decimal(12)), row(2, 10, unit_price=Decimal(12), name="Siers 2x1kg"), row(3, 10)])
    repair = maintenance.arithmetic_repair(df)
    assert {r.id: r.repairable for r in repair.collect()} == {1: True, 2: False}
    fixed = maintenance.apply_repair(df, repair)
    assert {r.id: float(r.unit_price) for r in fixed.collect()} == {1: 10.0, 2: 12.0, 3: 10.0}
    assert {r.id for r in maintenance.arithmetic_repair(fixed).collect()} == {2}
    drifted = df.withColumn("category", F.lit("x"))
    assert maintenance.apply_repair(drifted, repair).exceptAll(drifted).count() == 0
    diff = table_diff(df, fixed)
    assert diff_violations(diff, repair.where("repairable"), maintenance.DERIVED_FIELDS).count() == 0
    assert [r.violation for r in diff_violations(diff, repair.where("repairable"), ["category"]).collect()] == ["field_out_of_scope"]


def test_conform_and_audit(spark):
    old = spark.createDataFrame([(1, 1, "a", 2.0)], "id long, receipt_id long, name string, price double")
    r = conform(old, "id bigint, receipt_id bigint, name string, quantity decimal(18,4), price decimal(14,2), category string, category_source string",
                {"quantity": "1", "category": V.UNRESOLVED, "category_source": "rule"})
    assert tuple(r.first()) == (1, 1, "a", Decimal("1.0000"), Decimal("2.00"), V.UNRESOLVED, "rule")
    receipts = spark.createDataFrame([(2, "n", 1), (3, "n", None)], "id long, receipt_number string, total int")
    found = {x.constraint_name: x.violations for x in audit_constraints(receipts, r, spark.createDataFrame([], RULES_DDL)).collect()}
    assert found["receipts.receipt_number_unique"] == 1 and found["items.receipt_exists"] == 1 and found["receipts.total_not_null"] == 1


def test_units_comparable(spark):
    a = "named_struct('normalized_price_unit', '%s', 'product_key', '%s', 'canonical_name', '')"
    cases = [("eur_per_kg", "a", "eur_per_kg", "b", True), ("eur_per_kg", "a", "eur_per_l", "a", False),
             ("eur_per_piece", "a", "eur_per_piece", "b", False), ("eur_per_piece", "a", "eur_per_piece", "a", True), ("unknown", "a", "unknown", "a", False)]
    for u1, k1, u2, k2, want in cases:
        assert spark.range(1).selectExpr(a % (u1, k1) + " AS l", a % (u2, k2) + " AS r").select(units_comparable("l", "r")).first()[0] is want


def test_manifest_states_are_compared_null_safe_and_violations_refused(spark):
    items = spark.createDataFrame([(1, i, "Piens 1L", None, None, c) for i, c in enumerate(["b", "b", "a", "a", "c"])],
                                  "receipt_id long, id long, name string, normalized_name string, canonical_name string, category string")
    rules = spark.createDataFrame([("piens 1000ml", "a", "manual", None, None)],
                                  "product_key string, category string, source string, created_at timestamp, updated_at timestamp")
    state, = maintenance.identity_states(items).collect()
    assert (state.modal_category, state.item_exception_count) == ("a", 3)  # of equally frequent labels the first by name
    def manifest(rule, lines):
        row = ("Piens 1L", "piens 1000ml", "x", "a:2|b:2|c:1", 5, "LABEL_ONLY", ["existing_rule", "item_exception_ids"],
               {"existing_rule": rule, "item_exception_ids": lines})
        return spark.createDataFrame([row], "effective_product string, product_key string, target_category string, current_categories string, "
                                     f"expected_affected_item_count long, expected_rule_operation string, stated array<string>, predicates struct<{PREDICATES}>")

    drift = lambda m, r=rules: {v.violation for v in maintenance.migration_violations(items, r, m).collect()}
    right = manifest("a|manual", ["1:0", "1:1", "1:4"])
    assert drift(right) == set()
    assert drift(manifest(None, ["1:0", "1:1", "1:4"])) == {"existing_rule_drift"}  # no rule expected, one exists
    assert drift(manifest("a|manual", None)) == {"item_exception_ids_drift"}
    with pytest.raises(ValueError, match="existing_rule_drift"):
        maintenance.migration_plan(items, rules, manifest(None, ["1:0", "1:1", "1:4"]))
    lines, changes = maintenance.migration_plan(items, rules, right)
    assert maintenance.migration_drift(items, rules, lines, changes).count() == 0
    late = rules.withColumn("source", F.lit("other"))
    assert [tuple(r) for r in maintenance.migration_drift(items, late, lines, changes).collect()] == [("rule", "piens 1000ml")]
    assert maintenance.migration_apply(items, late, lines, changes, "2001-01-01 00:00:00")[1].first().category == "a"


def test_states_of_many_lines_of_one_spelling_take_one_key_each(spark):
    schema = "receipt_id long, id long, name string, normalized_name string, canonical_name string, category string"
    rows = [(i, 1, "Piens 1L" if i % 3 else "Maize", None if i % 2 else "piens", None if i % 5 else "Piens A", "a" if i % 4 else None) for i in range(240)]
    states = {r.identity: r for r in maintenance.identity_states(spark.createDataFrame(rows, schema)).collect()}
    counts = {}
    for _, _, name, _, canonical, category in rows:
        product = counts.setdefault(canonical or name, {})
        product[category or ""] = product.get(category or "", 0) + 1
    assert {k: (r.identity_row_count, r.current_categories, r.item_exception_count) for k, r in states.items()} == {
        k: (sum(c.values()), "|".join(f"{x}:{c[x]}" for x in sorted(c)), sum(c.values()) - max(c.values())) for k, c in counts.items()}
    # the key is made above an aggregation, not line by line
    assert keys_follow_distinct(maintenance.alias_keys(spark.createDataFrame(rows, schema)))
