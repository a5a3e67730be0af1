"""Periods, dashboard and story on small hand-made months."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from test_prices import observations, row
from tillroll.functions.periods import days_in_month, resolve_period, resolve_story_month
from tillroll.plans import dashboard, story
from tillroll.plans.quality import rank_actions

AS_OF = date(2026, 3, 31)
MAY = resolve_period("month:2026-05", date(2026, 6, 2))
RECEIPTS = "id long, date string, store string, total decimal(14,2), receipt_number string"


def heads(spark, rows):
    return spark.createDataFrame([(i, d, "A", Decimal(str(t)), f"n{i}") for i, d, t in rows], RECEIPTS)


def test_periods():
    p = resolve_period("current_month", AS_OF)
    assert (p.start, p.end, p.previous_start, p.previous_end) == (date(2026, 3, 1), date(2026, 4, 1), date(2026, 2, 1), date(2026, 3, 1))
    p = resolve_period("nonsense", date(2026, 3, 10))
    assert (p.key, p.previous_end) == ("current_month", date(2026, 2, 11))
    p = resolve_period("last_30_days", AS_OF)
    assert (p.start, p.previous_start, p.previous_end) == (date(2026, 3, 2), date(2026, 1, 31), date(2026, 3, 2))
    assert resolve_period("previous_month", AS_OF).previous_start == date(2026, 1, 1)
    assert resolve_period("all_time", AS_OF).start is None and resolve_period("month:2026-13", AS_OF).key == "current_month"
    assert days_in_month(date(2028, 2, 3)) == 29


def test_story_month(spark):
    df = spark.createDataFrame([("2026-01",), ("2026-09",), (None,)], "r string")
    months = F.array(F.lit("2026-01"), F.lit("2026-02"))
    assert [r[0] for r in df.select(resolve_story_month(F.col("r"), "2026-03", months)).collect()] == ["2026-01", "2026-02", "2026-02"]


def test_summary_trend_and_forecast(spark):
    receipts = heads(spark, [(1, "2026-03-01", 10), (2, "2026-03-02", 20), (3, "2026-03-31", 30), (4, "2026-02-03", 40), (5, "bad", 99), (6, "2026-3-1", 99)])
    s = dashboard.period_summary(receipts, resolve_period("current_month", AS_OF), AS_OF).first()
    assert (s.spend, s.receipt_count, s.previous_spend, s.absolute_delta, s.percentage_delta, s.forecast) == (60.0, 3, 40.0, 20.0, 50.0, 60.0)
    days = dashboard.daily_trend(receipts, resolve_period("current_month", AS_OF)).collect()
    assert len(days) == 31 and sum(r.spend for r in days) == 60.0
    assert [(r.month, r.receipt_count) for r in dashboard.months_available(receipts).orderBy("month").collect()] == [("2026-02", 1), ("2026-03", 3)]


def test_month_summary_reasons(spark):
    receipts = heads(spark, [(1, "2026-03-01", 10), (2, "2026-03-02", 20)])
    lines = spark.createDataFrame([(1,), (1,), (2,)], "receipt_id long")
    r = dashboard.month_summary(receipts, lines, date(2026, 3, 6)).first()
    assert r.reasons == "less_than_7_elapsed_days,less_than_3_receipts,less_than_10_item_lines,latest_receipt_older_than_3_days"
    assert (r.spend, r.item_line_count, r.eligible) == (30.0, 3, False)
    assert dashboard.month_summary(heads(spark, []), lines, date(2026, 3, 20)).first().reasons.endswith("no_current_month_receipts")


def build(spark, totals, lines, previous=()):
    receipts = heads(spark, [*totals, *previous])
    obs = observations(spark, lines)
    summary = dashboard.period_summary(receipts, MAY, date(2026, 6, 2))
    candidates = story.item_candidates(obs, summary, MAY)
    return receipts, candidates, story.ranked_insight(obs, receipts, summary, candidates, MAY)


def test_unusual_item_wins(spark):
    prior = [row(i, 10, f"2026-04-0{i}") for i in range(1, 6)]
    receipts, candidates, insight = build(spark, [(9, "2026-05-03", 60)], [*prior, row(9, 50, "2026-05-03")])
    assert [(r.unusual, r.history_count) for r in candidates.collect()] == [(True, 5)]
    r = insight.first()
    assert (r.type, r.subject_key, r.metric_value, r.evidence) == ("unusual_purchase", "Siers 1kg", 50.0, [9])


def test_unusual_receipt(spark):
    previous = [(20 + i, f"2026-04-1{i}", 20) for i in range(5)]
    _, _, insight = build(spark, [(1, "2026-05-03", 150), (2, "2026-05-04", 20)], [row(1, 150, "2026-05-03")], previous)
    assert insight.first().subject_key == "receipt:1"


def test_category_impact(spark):
    now = [(i, f"2026-05-0{i}", 40) for i in (1, 2, 3)]
    before = [(10 + i, f"2026-04-0{i}", 20) for i in (1, 2, 3)]
    lines = [row(i, 40, f"2026-05-0{i}") for i in (1, 2, 3)] + [row(10 + i, 20, f"2026-04-0{i}") for i in (1, 2, 3)]
    r = build(spark, now, lines, before)[2].first()
    assert (r.type, r.subject_key, r.metric_value, r.raw_impact_ratio, sorted(r.evidence)) == ("category_impact", "яйца", 60.0, 1.0, [1, 2, 3])
    lines = [row(i, 50, f"2026-05-0{i}") for i in (1, 2, 3)] + [row(10 + i, 20, f"2026-04-0{i}") for i in (1, 2, 3)]
    r = build(spark, now, lines, before)[2].first()
    assert (r.raw_impact_ratio, r.impact_ratio) == (1.5, 1.0)


def test_visit_frequency_and_calm(spark):
    now = [(i, f"2026-05-{i:02d}", 20) for i in range(1, 8)]
    before = [(100 + i, f"2026-04-0{i}", 20) for i in (1, 2, 3)]
    r = build(spark, now, [row(1, 1, "2026-05-01")], before)[2].first()
    assert (r.type, r.metric_value, r.evidence) == ("visit_frequency", 4.0, [7, 6, 5])
    assert build(spark, now, [row(1, 1, "2026-05-01")])[2].first().subject_key == "no_baseline"
    assert build(spark, [], [row(1, 1, "2026-04-01")])[2].first().subject_key == "empty"


def test_normalized_price(spark):
    lines = [row(100 + i, 10, f"2026-04-0{i}") for i in (1, 2, 3)] + [row(1, 13, "2026-05-01")]
    now, before = [(1, "2026-05-01", 13)], [(101, "2026-04-01", 13)]
    r = build(spark, now, lines, before)[2].first()
    assert (r.type, r.metric_value, r.subject_key) == ("normalized_price", 30.0, "Siers 1kg:eur_per_kg")


@pytest.mark.parametrize("n", [2, 4, 5, 30])
def test_highlights_and_remainder(spark, n):
    receipts = heads(spark, [(i, f"2026-05-{i:02d}", i % 7) for i in range(1, n + 1)])
    insight = spark.createDataFrame([([2],)], "evidence array<long>")
    shown = story.highlights(receipts, insight, MAY)
    ids = {r.receipt_id for r in shown.collect()}
    assert len(ids) == min(6, n)
    rest = story.remainder(receipts, shown, MAY).first()
    assert rest.receipts == n - len(ids)
    if n == 30:
        assert ids == {2, 6, 13, 30, 1, 8}


def test_timeline_groups_days(spark):
    many = heads(spark, [(i, f"2026-05-{i % 3 + 1:02d}", 1) for i in range(61)])
    assert [(r.type, r.receipts) for r in story.timeline(many, MAY).orderBy("date").collect()] == [("day_group", 21), ("day_group", 20), ("day_group", 20)]
    assert {r.type for r in story.timeline(heads(spark, [(1, "2026-05-01", 1)]), MAY).collect()} == {"receipt"}


def test_timeline_is_in_order_and_keeps_the_receipts_behind_a_day(spark):
    few = heads(spark, [(3, "2026-05-02", 1), (9, "2026-05-01", 1), (1, "2026-05-02", 1), (4, "2026-04-30", 1)])
    assert [r.receipt_id for r in story.timeline(few, MAY).collect()] == [9, 1, 3]
    assert story.timeline_receipts(few, MAY).collect() == []
    many = heads(spark, [(i, f"2026-05-{i % 3 + 1:02d}", 1) for i in range(61)])
    days = story.timeline(many, MAY).collect()
    assert [r.date for r in days] == ["2026-05-01", "2026-05-02", "2026-05-03"]
    behind = [(r.date, r.receipt_id) for r in story.timeline_receipts(many, MAY).collect()]
    assert behind == sorted((f"2026-05-{i % 3 + 1:02d}", i) for i in range(61))


def test_price_context_of_the_month(spark):
    obs = observations(spark, [row(1, 10, "2026-04-30"), row(2, 12, "2026-05-01"), row(3, 15, "2026-05-01"), row(4, 99, "2026-06-01")])
    bought = dashboard.month_products(obs, AS_OF, MAY)
    got = dashboard.price_context(obs, bought, AS_OF, MAY).first()
    assert (got.purchase_count, got.latest_price, got.change_percent) == (2, 15.0, 25.0)
    before = {r.receipt_id: r.price_before for r in dashboard.previous_prices(obs).collect()}
    assert before == {1: None, 2: 10.0, 3: 12.0, 4: 15.0}
    assert dashboard.month_products(obs, AS_OF, MAY, 0).count() == 0


def test_signature_ignores_small_moves(spark):
    receipts = heads(spark, [(1, "2026-05-01", 1)])
    sign = lambda v: story.story_signature(spark.createDataFrame(
        [("calm_month", "stable", v, [1])], "type string, subject_key string, metric_value double, evidence array<long>"), receipts, MAY).first().story_signature
    assert sign(11.0) == sign(12.0) != sign(13.0)


def test_briefing(spark):
    receipts = heads(spark, [(1, "2026-05-01", 100), (2, "2026-05-02", 100), (3, "2026-04-01", 100)])
    obs = observations(spark, [row(1, 90, "2026-05-01"), row(3, 10, "2026-04-01")])
    none = spark.createDataFrame([], "key string, priority double, severity string, n long")
    out = dashboard.briefing(dashboard.period_summary(receipts, MAY, date(2026, 6, 2)), dashboard.category_changes(obs, MAY), none)
    assert [(r.finding, r.subject, r.value) for r in out.orderBy("rank").collect()] == [
        ("decision", "changed", 0.0), ("category_movement", "яйца", 80.0), ("visit_frequency", "receipts", 1.0)]
    queue = spark.createDataFrame([("no_manual_rule", 0.5, 9), ("b", 2.0, 1), ("a", 2.0, 5), ("z", 1.0, 0)], "key string, priority double, n long")
    assert [r.key for r in rank_actions(queue).collect()] == ["a", "b"]
