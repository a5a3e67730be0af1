"""Keys are made once per spelling, and lines are still all counted."""

from tillroll.plans import products, quality
from tillroll.session import stored

SCHEMA = "receipt_id long, name string, normalized_name string, canonical_name string, category string, category_source string, store string"
ROWS = [(i % 7 if i % 11 else None, "Piens 1L" if i % 3 else "Maize 2kg", None if i % 2 else " ", None if i % 5 else "Piens A",
         [None, "", "x", "молочка"][i % 4], None if i % 2 else "manual", "s" if i % 3 else None) for i in range(120)]


def keys_follow_distinct(df):
    """No step below the lowest aggregation, which sees every line, makes a normal form."""
    steps = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lowest = max(i for i, step in enumerate(steps) if "Aggregate [" in step)
    return any("regexp_replace" in step for step in steps) and not any("regexp_replace" in step for step in steps[lowest + 1:])


def test_review_values_and_health_make_keys_after_the_lines_are_distinct(spark):
    lines = spark.createDataFrame(ROWS, SCHEMA)
    assert keys_follow_distinct(quality.review_values(lines))
    assert keys_follow_distinct(quality.group_health(lines))
    once = spark.createDataFrame(sorted({r[1:] for r in ROWS}, key=str), SCHEMA.partition(", ")[2])
    assert sorted(map(tuple, quality.review_values(lines).collect())) == sorted(map(tuple, quality.review_values(once).collect()))
    health, = quality.group_health(lines).collect()
    assert (health.groups, health.conflicts, health.unresolved) == (3, 3, 3)


def test_catalogue_counts_lines_and_receipts_without_moving_texts_per_line(spark):
    counted = products.catalogue(spark.createDataFrame(ROWS, SCHEMA))
    want = {}
    for receipt, name, normalized, canonical, category, *_ in ROWS:
        lines = want.setdefault((name, normalized or "", canonical or name, category or None), [])
        lines.append(receipt)
    assert {(r.name, r.normalized_name, r.identity, r.category): (r.item_count, r.receipt_count) for r in counted.collect()} == {
        k: (len(v), len({x for x in v if x is not None})) for k, v in want.items()}
    assert "name" not in next(p for p in counted._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]
                              if "receipt_id" in p.partition(")")[0]).partition(")")[0]


def test_review_groups_count_lines_before_keys_and_receipts_by_digests(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "stored", lambda df: kept.append(df) or stored(df), raising=False)
    rows = [(*r, r[3] or r[1], f"2020-01-{i % 28 + 1:02d}") for i, r in enumerate(ROWS)]
    lines = spark.createDataFrame(rows, SCHEMA + ", identity string, date string")
    rules = spark.createDataFrame([("maize 2000g",)], "product_key string")
    groups = quality.review_groups(lines, rules)
    per_line = [df for df in [*kept, groups] if "Expand" in (plan := df._jdf.queryExecution().optimizedPlan().toString())
                or "regexp_replace" in plan and not keys_follow_distinct(df)]
    assert [df.columns for df in per_line] == [groups.columns]  # labels, names and stores of counted spellings only
    assert "regexp_replace" not in groups._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for receipt, name, normalized, canonical, category, source, store, *_, date in rows:
        key = "piens a" if canonical else {"Piens 1L": "piens 1000ml", "Maize 2kg": "maize 2000g"}[name]
        want.setdefault(key, []).append((receipt, name, store, category if category == "x" else "other", date))
    distinct = lambda seen: len({x for x in seen if x is not None})
    assert {r.product_key: (r.item_count, r.receipt_count, r.alias_count, r.store_count, r.conflict_count, r.last_date, r.has_rule)
            for r in groups.collect()} == {
        k: (len(v), *(distinct(x[i] for x in v) for i in (0, 1, 2)), distinct(x[3] for x in v) - 1, max(x[4] for x in v), k == "maize 2000g")
        for k, v in want.items()}


def test_search_forms_are_tested_after_products_are_counted(spark):
    lines = spark.createDataFrame(ROWS, SCHEMA)
    found = products.with_match_features(products.catalogue(lines))
    assert keys_follow_distinct(found)
    assert found.count() == products.catalogue(lines).count()
