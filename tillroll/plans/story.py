"""Month story: unusual purchases, one ranked insight, highlights and remainder."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import reporting_label
from tillroll.functions.periods import Period, in_range
from tillroll.operators.medians import group_medians
from tillroll.operators.observations import paid
from tillroll.operators.ranking import with_rank
from tillroll.plans.prices import price_deviation, price_lines
from tillroll.plans.spend import money
from tillroll.session import stored

EVIDENCE = 3
TIMELINE = 60


def _cents(column: Column) -> Column:
    return (column.cast("decimal(14,2)") * 100).cast("bigint")


def item_candidates(obs: DataFrame, summary: DataFrame, period: Period) -> DataFrame:
    """Current lines with the tests an insight may rest on."""
    if period.start is None:
        raise ValueError("a story needs a period with a start")
    history_start = period.start - timedelta(days=V.HISTORY_DAYS)
    window = obs.where(in_range(F.col("date"), history_start, period.end)).withColumns({
        "amount": paid().cast("decimal(14,2)"), "label": reporting_label(F.col("category"))})
    lines = price_lines(window, ["amount", "label", "name"])
    deviation = price_deviation(lines, ["amount", "name", "date"]).where(F.col("date") >= period.start.isoformat())
    conflicts = lines.groupBy("identity").agg((F.min("label") != F.max("label")).alias("category_conflict"))
    recent = lines.where(F.col("date").between((period.start - timedelta(days=90)).isoformat(),
                                               (period.start - timedelta(days=1)).isoformat()) & (F.col("amount") > 0))
    priors = group_medians(recent.withColumn("c", _cents(F.col("amount"))), ["identity"], "c").select(
        "identity", F.col("observations").alias("history_count"), F.col("median_x2").alias("usual_x2"))
    value = F.greatest(F.lit(0).cast("decimal(14,2)"), F.col("amount"))
    df = deviation.withColumn("amount", value).join(conflicts, "identity", "left").join(priors, "identity", "left")
    df = df.withColumns({"spend": summary.select("spend").scalar(),
                         "change": F.abs(F.coalesce(summary.select("absolute_delta").scalar(), F.lit(0.0)))})
    large = ((F.col("spend") > 0) & (F.col("amount") >= F.col("spend") * 0.25)) | (
        (F.col("change") > 0) & (F.col("amount") >= F.col("change") * 0.5))
    unusual = (F.col("history_count") >= 5) & (F.col("amount") >= 40) & (
        _cents(F.col("amount")) * 2 >= F.col("usual_x2") * 3) & large
    return df.select(
        "identity", "receipt_id", F.col("id").cast("string").alias("line_id"), "name", "date",
        F.col("amount").cast("double").alias("amount"), F.coalesce(unusual, F.lit(False)).alias("unusual"),
        F.coalesce("history_count", F.lit(0)).alias("history_count"), "status", "prior_count",
        "normalized_price_unit", "deviation_percent",
        F.coalesce(F.round(F.abs(F.col("price_e4") / 10000.0 - F.col("median_x2") / 20000.0), 2), F.lit(0.0)).alias("price_effect"),
        "category_conflict")


def _insight(kind: str, priority: int, subject: Column, value: Column, unit: str, evidence: Column, ratio=None):
    raw = (ratio if ratio is not None else F.lit(None)).cast("double")
    return [F.lit(kind).alias("type"), F.lit(priority).alias("priority"), subject.alias("subject_key"),
            value.cast("double").alias("metric_value"), F.lit(unit).alias("metric_unit"),
            raw.alias("raw_impact_ratio"), F.when(raw.isNotNull(), F.least(raw, F.lit(1.0))).alias("impact_ratio"), evidence.alias("evidence")]


def category_sums(obs: DataFrame, period: Period) -> DataFrame:
    """Clipped amounts of both ranges by category; the coverage uses the same amounts."""
    now, before = period.current(), period.previous()
    amount = F.greatest(F.lit(0).cast("decimal(14,2)"), paid())
    return obs.where(now | before).groupBy(reporting_label(F.col("category")).alias("category")).agg(
        F.coalesce(F.sum(F.when(now, amount)), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(before, amount)), F.lit(0)).alias("previous"))


def ranked_insight(obs: DataFrame, receipts: DataFrame, summary: DataFrame, candidates: DataFrame, period: Period) -> DataFrame:
    """The one insight of the period. Every kind offers its best; the first kind that does wins."""
    one = summary.limit(1)
    spend, previous = one.select("spend").scalar(), F.coalesce(one.select("previous_spend").scalar(), F.lit(0.0))
    delta = F.coalesce(one.select("absolute_delta").scalar(), F.lit(0.0))
    count, before_count = one.select("receipt_count").scalar(), one.select("previous_receipt_count").scalar()
    current = receipts.where(period.current())
    base = {"_spend": spend, "_previous": previous, "_delta": delta, "_n": count, "_before": before_count}
    S, P, D, N, B = (F.col(c) for c in base)
    meaningful = F.abs(D) >= F.greatest(F.lit(10.0), P * 0.10)
    ids = lambda column: F.array(column)

    item = candidates.where("unusual").orderBy(F.desc("amount"), "identity", "receipt_id").limit(1).select(
        *_insight("unusual_purchase", 1, F.col("identity"), F.col("amount"), "EUR", ids(F.col("receipt_id"))))
    usual = group_medians(receipts.where(in_range(F.col("date"), period.start - timedelta(days=90), period.start) & (
        F.col("total") > 0)).withColumn("c", _cents(F.col("total"))).withColumn("all", F.lit(1)), ["all"], "c")
    receipt = current.withColumns({**base, "_usual": usual.where("observations >= 5").select("median_x2").scalar()}).where(
        (F.col("total") >= 100) & (_cents(F.col("total")) * 2 >= F.col("_usual") * 3)
        & (((S > 0) & (F.col("total") >= S * 0.25)) | ((F.abs(D) > 0) & (F.col("total") >= F.abs(D) * 0.5)))).orderBy(
        F.desc("total"), "id").limit(1).select(*_insight(
            "unusual_purchase", 1, F.concat(F.lit("receipt:"), F.col("id").cast("string")), F.col("total"), "EUR", ids(F.col("id"))))

    sums = stored(category_sums(obs, period))  # one row per category
    covered = sums.agg(F.sum("current").alias("c"), F.sum("previous").alias("p"),
                       F.sum(F.when(F.col("category") == V.UNRESOLVED, F.col("current"))).alias("oc"),
                       F.sum(F.when(F.col("category") == V.UNRESOLVED, F.col("previous"))).alias("op"))
    shares = covered.select(F.struct(
        F.col("c").cast("double").alias("c"), F.col("p").cast("double").alias("p"),
        F.coalesce("oc", F.lit(0)).cast("double").alias("oc"), F.coalesce("op", F.lit(0)).cast("double").alias("op")).alias("s"))
    category = sums.withColumns({**base, "_s": shares.scalar()}).withColumn(
        "move", (F.col("current") - F.col("previous")).cast("double")).where(
        (B >= 3) & (N >= 3) & meaningful & (S > 0) & (P > 0) & (F.col("_s.c") >= S * 0.8) & (F.col("_s.p") >= P * 0.8)
        & (F.col("_s.oc") <= F.col("_s.c") * 0.3) & (F.col("_s.op") <= F.col("_s.p") * 0.3) & (F.col("_s.c") > 0) & (F.col("_s.p") > 0)
        & (F.col("category") != V.UNRESOLVED) & (F.signum("move") == F.signum(D)) & (D != 0)
        & (F.abs("move") >= F.greatest(F.lit(10.0), F.abs(D) * 0.4))).orderBy(
        F.abs("move").desc(), "category").limit(1)
    top = obs.where(period.current()).withColumn("label", reporting_label(F.col("category"))).join(
        category.select(F.col("category").alias("label")), "label", "left_semi").groupBy("receipt_id").agg(
        F.sum(F.greatest(F.lit(0).cast("decimal(14,2)"), paid())).alias("a")).orderBy(F.desc("a"), "receipt_id").limit(EVIDENCE)
    category = category.withColumn("ids", top.agg(F.collect_list("receipt_id")).scalar()).select(*_insight(
        "category_impact", 2, F.col("category"), F.round("move", 2), "EUR", F.col("ids"), F.round(F.abs("move") / F.abs(D), 4)))

    days = [(period.end - period.start).days, (period.previous_end - period.previous_start).days] if period.has_previous else [0, 0]
    newest = current.orderBy(F.desc("date"), F.desc("id")).limit(EVIDENCE).agg(F.collect_list("id"))
    scalars = one.withColumns(base)
    visits = scalars.where(F.lit(min(days) >= 7) & (B > 0) & (N + B >= 5) & (F.abs(N - B) >= 3) & (F.abs(N - B) >= B * 0.4)
                           & (D != 0) & meaningful & (F.signum((N - B).cast("double")) == F.signum(D))
                           & (F.abs(N - B) * P / B >= F.abs(D) * 0.4)).select(*_insight(
        "visit_frequency", 3, F.lit("receipt_frequency"), N - B, "receipts", newest.scalar()))
    price = candidates.withColumns(base).where(
        (F.abs("deviation_percent") >= 15) & F.col("status").isin("CHEAPER_THAN_USUAL", "MORE_EXPENSIVE_THAN_USUAL")
        & ~F.col("category_conflict") & (((S > 0) & (F.col("amount") >= S * 0.1)) | (F.col("price_effect") >= 3))).orderBy(
        F.abs("deviation_percent").desc(), F.desc("amount"), "identity", "receipt_id", "line_id").limit(1).select(*_insight(
            "normalized_price", 4, F.concat_ws(":", "identity", "normalized_price_unit"), F.col("deviation_percent"),
            "percent", ids(F.col("receipt_id"))))
    calm = scalars.select(*_insight(
        "calm_month", 5, F.when(N == 0, "empty").when(B > 0, "stable").otherwise("no_baseline"),
        F.when(D != 0, D).otherwise(S), "EUR", F.array().cast("array<bigint>")))
    offers = reduce(DataFrame.unionByName, [item, receipt, category, visits, price, calm])
    # An item and a receipt can both stand out; the larger amount leads, the item on a tie.
    return offers.orderBy("priority", F.when(F.col("priority") == 1, -F.col("metric_value")), F.col("subject_key").startswith(
        "receipt:")).limit(1)


def highlights(receipts: DataFrame, insight: DataFrame, period: Period) -> DataFrame:
    """Up to six receipts: evidence, the two largest, the last, the first, the quarters."""
    current = receipts.where(period.current()).select("id", "date", "store", "total")
    ranked = stored(with_rank(current, "date", "id"))
    size = ranked.agg(F.count("*").alias("n"))
    at = lambda position: ranked.withColumn("_n", size.scalar()).where(F.col("rank") == position)
    n = F.col("_n")
    picks = [ranked.join(insight.select(F.posexplode("evidence").alias("_p", "id")), "id").withColumn("pick", F.col("_p")).drop("_p")]
    largest = ranked.orderBy(F.desc("total"), "id").limit(2)
    picks.append(largest.withColumn("pick", F.lit(EVIDENCE)))
    for step, position in enumerate([n - 1, F.lit(0)]):
        picks.append(at(position).drop("_n").withColumn("pick", F.lit(EVIDENCE + 2 + step)))
    for step, fraction in enumerate((0.25, 0.5, 0.75)):
        picks.append(at(F.bround((n - 1) * fraction, 0)).where("_n > 4").drop("_n").withColumn("pick", F.lit(EVIDENCE + 4 + step)))
    picks.append(ranked.orderBy("rank").limit(6).withColumn("pick", F.col("rank") + 100))
    # The largest two share a step and are told apart by their total.
    chosen = reduce(DataFrame.unionByName, picks).groupBy("id", "date", "store", "total", "rank").agg(F.min("pick").alias("pick"))
    return chosen.orderBy("pick", F.desc("total"), "id").limit(6).select(
        F.col("id").alias("receipt_id"), "date", "store", F.col("total").cast("double").alias("total"))


def remainder(receipts: DataFrame, shown: DataFrame, period: Period) -> DataFrame:
    rest = receipts.where(period.current()).join(shown.select(F.col("receipt_id").alias("id")), "id", "left_anti")
    return rest.agg(F.count("*").alias("receipts"), money(F.sum("total")).alias("total"))


def timeline(receipts: DataFrame, period: Period) -> DataFrame:
    """Single receipts up to 60 of them, else one row per day, in order of day and receipt."""
    current = receipts.where(period.current())
    size = current.agg(F.count("*").alias("n"))
    few = current.withColumn("_n", size.scalar()).where(F.col("_n") <= TIMELINE).select(
        F.lit("receipt").alias("type"), "date", F.col("id").alias("receipt_id"), F.lit(1).cast("bigint").alias("receipts"),
        F.col("total").cast("double").alias("total"))
    days = current.groupBy("date").agg(F.count("*").alias("receipts"), F.sum("total").alias("t")).withColumn(
        "_n", size.scalar()).where(F.col("_n") > TIMELINE).select(
        F.lit("day_group").alias("type"), "date", F.lit(None).cast("bigint").alias("receipt_id"), "receipts", money(F.col("t")).alias("total"))
    return few.unionByName(days).orderBy("date", "receipt_id")


def timeline_receipts(receipts: DataFrame, period: Period) -> DataFrame:
    """The receipts behind the days of a grouped timeline, one row each, in order of day and receipt."""
    current = receipts.where(period.current())
    size = current.agg(F.count("*").alias("n"))
    return current.withColumn("_n", size.scalar()).where(F.col("_n") > TIMELINE).select(
        "date", F.col("id").alias("receipt_id"), "store", F.col("total").cast("double").alias("total")).orderBy("date", "receipt_id")


def story_signature(insight: DataFrame, receipts: DataFrame, period: Period) -> DataFrame:
    """Stable while the insight, its size in steps of five and its evidence stay the same."""
    last = receipts.where(period.current()).agg(F.coalesce(F.max(F.struct("date", "id"))["id"], F.lit(0))).scalar()
    bucket = (F.bround(F.col("metric_value") / 5, 0) * 5).cast("bigint").cast("string")
    return insight.select("type", "subject_key", F.sha2(F.concat_ws(
        "|", "type", "subject_key", bucket, F.array_join(F.array_sort("evidence").cast("array<string>"), ","),
        last.cast("string")), 256).alias("story_signature"))
