"""Every query by name, bound to the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import classify_names
from tillroll.functions.columns import month_of
from tillroll.functions.evidence import arithmetic_mismatch
from tillroll.functions.identity import identity, product_key
from tillroll.functions.periods import Period, resolve_period, resolve_story_month
from tillroll.functions.price import units_comparable
from tillroll.operators.asof import asof_backward
from tillroll.operators.observations import observe
from tillroll.operators.snapshots import diff_violations, invariants, sparse_diff, table_diff, tables_equal
from tillroll.plans import dashboard, maintenance, prices, products, quality, spend, story
from tillroll.schema import ITEMS_DDL, RECEIPT_DEFAULTS, RECEIPTS_DDL, ITEM_DEFAULTS, audit_constraints, conform
from tillroll.session import stored, stream_folder
from tillroll.sources import ingest, manifest, receipt_text, tables
from tillroll.sources.publish import write_report
from tillroll.streaming.jobs import drop_repeats, enrich_stream, ingest_stream, run_to_end, sweep, sweep_session

AS_OF = date(1998, 6, 14)
MONTH = "month:1998-05"


class Data:
    """The bound tables of one folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def receipts(self) -> DataFrame:
        return tables.receipts(self.spark, self.folder)

    def receipts_in(self, period: Period, days_before: int = 0) -> DataFrame:
        return tables.receipts(self.spark, self.folder, *period.bounds(days_before))

    def sold_in(self, period: Period) -> DataFrame:
        return observe(self.sales, self.receipts_in(period))

    def graded_in(self, period: Period, days_before: int = 0) -> DataFrame:
        """Observations of a time; its lines are chosen before they are priced."""
        chosen = self.receipts_in(period, days_before)
        return observe(tables.items(self.spark, self.folder, evidence=True, chosen=chosen), chosen)

    def items_in(self, period: Period) -> DataFrame:
        return tables.items(self.spark, self.folder, chosen=self.receipts_in(period))

    @property
    def items(self) -> DataFrame:
        return tables.items(self.spark, self.folder)

    @property
    def sales(self) -> DataFrame:
        return tables.sales(self.spark, self.folder)

    @property
    def sold(self) -> DataFrame:
        """Observations without the price model."""
        return observe(self.sales, self.receipts)

    @property
    def graded_items(self) -> DataFrame:
        return tables.items(self.spark, self.folder, evidence=True)

    @property
    def rules(self) -> DataFrame:
        return tables.rules(self.spark, self.folder)

    @property
    def obs(self) -> DataFrame:
        return observe(self.items, self.receipts)

    @property
    def graded_obs(self) -> DataFrame:
        return observe(self.graded_items, self.receipts)

    @property
    def price_lines(self) -> DataFrame:
        return prices.price_lines(self.graded_obs)

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.folder, name)


QUERIES: dict[str, Callable[[Data], DataFrame]] = {}


def query(name: str):
    def add(build):
        QUERIES[name] = build
        return build
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, folder: build(Data(spark, folder))
    return {name: bind(build) for name, build in QUERIES.items()}


CURRENT = resolve_period("current_month", AS_OF)
SELECTED = resolve_period(MONTH, AS_OF)
ALL_TIME = resolve_period("all_time", AS_OF)

# --- spend --------------------------------------------------------------------------------
query("monthly_spend")(lambda d: spend.monthly_spend(d.sold))
query("category_spend")(lambda d: spend.category_spend(d.sold))
query("top_products")(lambda d: spend.top_products(d.sold))
query("spend_totals")(lambda d: spend.spend_totals(d.sold))
query("total_spent")(lambda d: spend.total_spent(d.receipts))
query("filtered_category_spend")(lambda d: spend.category_spend(spend.apply_filters(
    d.sold, start="1996-01-01", end="1998-12-31", store="building", item="gear")))
query("unresolved_monthly_spend")(lambda d: spend.monthly_spend(spend.apply_filters(d.sold, category="прочее")))
query("insight_lines")(lambda d: spend.insight_lines(d.sold))
query("report_monthly_receipts")(lambda d: spend.receipt_spend_by_month(d.receipts))
query("report_category_spend")(lambda d: spend.stored_category_spend(d.sales))
query("report_average_price_by_store")(lambda d: spend.average_price_by_store(d.obs))
query("report_price_history")(lambda d: spend.price_history(d.obs))
query("report_recurring_products")(lambda d: spend.recurring_products(d.sales))
query("report_evidence_distribution")(lambda d: spend.evidence_distribution(d.items))

# --- periods ------------------------------------------------------------------------------
query("period_summary")(lambda d: dashboard.period_summary(d.receipts_in(CURRENT), CURRENT, AS_OF))
for period in ("previous_month", "last_30_days"):
    query(f"period_summary_{period}")(lambda d, period=resolve_period(period, AS_OF): dashboard.period_summary(d.receipts_in(period), period, AS_OF))
query("category_changes")(lambda d: dashboard.category_changes(d.sold_in(CURRENT), CURRENT))
query("daily_trend")(lambda d: dashboard.daily_trend(d.receipts_in(SELECTED), SELECTED))
query("monthly_trend")(lambda d: dashboard.monthly_trend(d.receipts, ALL_TIME))
query("months_available")(lambda d: dashboard.months_available(d.receipts))
query("receipt_register")(lambda d: dashboard.receipt_register(d.receipts_in(SELECTED), d.items_in(SELECTED), SELECTED, "build"))
query("register_by_total")(lambda d: dashboard.sort_register(
    dashboard.receipt_register(d.receipts_in(SELECTED), d.items_in(SELECTED), SELECTED), "total", descending=True).limit(40))
query("register_totals")(lambda d: dashboard.register_totals(
    dashboard.receipt_register(d.receipts, d.items, ALL_TIME)))
query("receipt_previews")(lambda d: dashboard.receipt_previews(
    dashboard.receipt_register(d.receipts_in(SELECTED), d.items_in(SELECTED), SELECTED), d.items_in(SELECTED), 2))
query("recent_receipts")(lambda d: dashboard.receipt_register(d.receipts_in(CURRENT), d.items_in(CURRENT), CURRENT, n=5))
query("receipt_lines")(lambda d: dashboard.receipt_lines(d.items))
query("month_summary")(lambda d: dashboard.month_summary(d.receipts, d.sales, AS_OF))
query("selected_month_summary")(lambda d: dashboard.month_summary(d.receipts_in(SELECTED), d.sales, AS_OF, SELECTED))


def _month_products(d: Data, n: int | None = None) -> DataFrame:
    """Only the lines of the products found are priced."""
    bought = stored(dashboard.month_products(d.sold_in(SELECTED), AS_OF, SELECTED, n))
    return dashboard.price_context(observe(tables.items(d.spark, d.folder, named=bought), d.receipts), bought, AS_OF, SELECTED)


query("top_month_products")(lambda d: _month_products(d, 3))
query("month_price_context")(_month_products)
query("story_month")(lambda d: d.table("lineitem").select(month_of(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("requested")).distinct().withColumn(
    "months", dashboard.months_available(d.receipts).agg(F.collect_set("month")).scalar()).select(
    "requested", resolve_story_month(F.col("requested"), MONTH.removeprefix("month:"), F.col("months")).alias("month"),
    resolve_story_month(F.col("requested"), "2031-01", F.col("months")).alias("month_of_later_day")))

# --- price evidence -----------------------------------------------------------------------
query("price_evidence")(lambda d: d.items.select(
    "receipt_id", F.col("id").cast("string").alias("line_id"), "name", "normalized_name",
    *[F.col(c).cast("double").alias(c) for c in (
        "quantity", "price", "line_total", "unit_price", "package_size", "normalized_unit_price", "price_parse_confidence")],
    "quantity_unit", "package_unit", "normalized_price_unit", "price_parse_source"))
query("price_quality")(lambda d: quality.price_quality(d.items))
query("issue_worklist")(lambda d: quality.issue_worklist(d.graded_obs, "low_confidence", 100))
for issue in ("unknown", "missing_package", "suspicious", "all"):
    query(f"issue_worklist_{issue}")(lambda d, issue=issue: quality.issue_worklist(d.graded_obs, issue, 200))
query("mismatched_lines")(lambda d: quality.mismatched_lines(_drifted(d)))
query("price_correctability")(lambda d: quality.correctability(d.graded_obs))
query("price_eligibility")(lambda d: prices.graded(d.graded_obs).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(
    F.count("*").alias("lines")))



def _neighbours(d: Data) -> DataFrame:
    """Every line but the first of a receipt as `this`, the line before it as `other`."""
    lines = stored(d.items.select("receipt_id", "id", "normalized_price_unit", "canonical_name", product_key().alias("product_key")))
    fields = ["normalized_price_unit", "canonical_name", "product_key"]
    return asof_backward(lines, lines, ["receipt_id"], ["id"], fields, "other").where("other IS NOT NULL").select(
        F.struct(*fields).alias("this"), "other")


# --- price history ------------------------------------------------------------------------
query("price_deviation")(lambda d: prices.deviation_report(prices.price_deviation(d.price_lines)))
query("receipt_price_summary")(lambda d: prices.receipt_price_summary(prices.price_deviation(d.price_lines)))
query("price_evidence_summary")(lambda d: prices.evidence_summary(prices.price_deviation(d.price_lines)))
query("previous_prices")(lambda d: dashboard.previous_prices(d.obs))
query("comparable_units")(lambda d: _neighbours(d).groupBy(
    *[F.coalesce(f"{side}.normalized_price_unit", F.lit("")).alias(f"{side}_unit") for side in ("this", "other")],
    units_comparable("this", "other").alias("comparable")).agg(F.count("*").alias("lines")))
query("price_trend")(lambda d: prices.price_trend(d.price_lines))
query("store_levels")(lambda d: prices.rank_stores(prices.store_levels(d.price_lines)).select(
    "identity", "normalized_price_unit", "store", "position", "observation_count", "latest_date",
    *[F.col(c).cast("double").alias(c) for c in ("median_price", "min_price", "max_price")]))
query("store_comparison")(lambda d: prices.store_comparison(d.price_lines))
query("product_dossier")(lambda d: prices.product_dossier(d.obs))
query("dossier_stores")(lambda d: prices.dossier_stores(d.sold))
query("dossier_aliases")(lambda d: prices.dossier_aliases(d.sold))

# --- categories ---------------------------------------------------------------------------
query("group_health")(lambda d: quality.group_health(d.sales))
query("review_groups")(lambda d: quality.review_groups(d.sold, d.rules))
query("review_page")(lambda d: quality.review_page(quality.review_groups(d.sold, d.rules), "conflict", "conflicts", 100))
for order, page in (("count", 2), ("recent", 1), ("name", 3)):
    query(f"review_page_{order}")(lambda d, order=order, page=page: quality.review_page(
        quality.review_groups(d.sold, d.rules), "no_rule", order, 50, page))
query("review_page_info")(lambda d: quality.page_info(quality.review_groups(d.sold, d.rules), 50, 2))
query("review_values")(lambda d: quality.review_values(d.sold))
query("category_audit")(lambda d: quality.category_audit(d.sales, d.rules))
query("classifier_confusion")(lambda d: quality.classifier_confusion(quality.classifier_records(d.sales, d.rules)))
query("classifier_summary")(lambda d: quality.classifier_summary(quality.classifier_records(d.sales, d.rules)))
query("classifier_samples")(lambda d: quality.classifier_samples(quality.classifier_records(d.sales, d.rules)))
query("category_sources")(lambda d: quality.category_sources(d.sales))

# --- tables -------------------------------------------------------------------------------
query("constraint_audit")(lambda d: audit_constraints(d.receipts, d.sales, d.rules))
query("schema_conform")(lambda d: conform(
    conform(d.sales.drop("category_source", "canonical_name"), ITEMS_DDL, ITEM_DEFAULTS).join(
        conform(d.receipts.drop("total"), RECEIPTS_DDL, RECEIPT_DEFAULTS).select(F.col("id").alias("receipt_id"), "total"),
        "receipt_id").drop("total"), ITEMS_DDL).groupBy("category_source", F.col("canonical_name").isNull().alias("no_canonical")).agg(
    F.count("*").alias("lines"), F.sum("price").cast("double").alias("spend")))

# --- names and duplicates -----------------------------------------------------------------
query("name_features")(lambda d: products.name_features(d.sales))
query("search_products")(lambda d: products.search_products(d.sales, "hot gear"))
query("resolve_names")(lambda d: products.resolve_names(
    d.sales.select(F.col("name").alias("asked")).unionByName(d.table("part").select(F.col("p_name").alias("asked"))).distinct(), d.sales))
query("merge_catalogue")(lambda d: products.merge_catalogue(d.sales))
query("match_catalogue")(lambda d: products.catalogue(d.sales))


def _suggestions(d: Data, **chosen) -> DataFrame:
    return products.duplicate_suggestions(products.with_match_features(products.catalogue(d.sales)), **chosen)


query("duplicate_suggestions")(_suggestions)
query("top_duplicate_suggestions")(lambda d: _suggestions(d, limit=200, confidence="high"))

# --- story and operations -----------------------------------------------------------------


def _summary(d: Data) -> DataFrame:
    return dashboard.period_summary(d.receipts_in(SELECTED), SELECTED, AS_OF)


def _candidates(d: Data) -> DataFrame:
    return story.item_candidates(d.graded_in(SELECTED, V.HISTORY_DAYS), _summary(d), SELECTED)


def _insight(d: Data) -> DataFrame:
    return stored(story.ranked_insight(d.sold_in(SELECTED), d.receipts_in(SELECTED, 90), _summary(d), stored(_candidates(d)), SELECTED))


query("story_items")(lambda d: _candidates(d).drop("prior_count"))
query("ranked_insight")(lambda d: _insight(d).select("type", "subject_key", "metric_value", "metric_unit", F.array_join(
    F.array_sort("evidence").cast("array<string>"), ",").alias("evidence")))
query("story_highlights")(lambda d: story.highlights(d.receipts, _insight(d), SELECTED))
query("story_remainder")(lambda d: story.remainder(d.receipts, story.highlights(d.receipts, _insight(d), SELECTED), SELECTED))
query("story_timeline")(lambda d: story.timeline(d.receipts_in(SELECTED), SELECTED))
query("story_timeline_receipts")(lambda d: story.timeline_receipts(d.receipts_in(SELECTED), SELECTED))
query("story_signature")(lambda d: story.story_signature(_insight(d), d.receipts_in(SELECTED), SELECTED))
query("action_queue")(lambda d: quality.action_queue(d.items, d.sales, products.high_confidence_count(_suggestions(d))))
query("briefing")(lambda d: dashboard.briefing(
    _summary(d), dashboard.category_changes(d.sold_in(SELECTED), SELECTED), quality.action_queue(d.items, d.sales).where("severity IN ('critical', 'high')")))

# --- maintenance --------------------------------------------------------------------------


def _proposals(d: Data) -> DataFrame:
    return d.items.where("price_parse_confidence = 0.70").select(
        "receipt_id", "id", F.lit("piece").alias("quantity_unit"), F.lit("250").alias("package_size"), F.lit("g").alias("package_unit"))


def _dated(d: Data) -> DataFrame:
    """Lines with store and date, the state a reviewer sees."""
    return observe(d.items, d.receipts).drop("identity")


def _previews(d: Data) -> DataFrame:
    return maintenance.correction_previews(_dated(d), _proposals(d))


def _guarded(d: Data) -> DataFrame:
    seen = stored(_dated(d))
    tokens = stored(maintenance.correction_tokens(maintenance.correction_previews(seen, _proposals(d))))
    now = seen.withColumn("category", F.when(F.col("quantity") == 50, "changed").otherwise(F.col("category")))
    updated, refused = maintenance.apply_corrections(now, tokens)
    return refused.groupBy(F.col("refused").alias("outcome")).agg(F.count("*").alias("lines")).unionByName(
        updated.where("price_parse_source = 'manual_correction'").agg(F.count("*").alias("lines")).select(
            F.lit("written").alias("outcome"), "lines"))


def _drifted(d: Data) -> DataFrame:
    return d.items.withColumn("unit_price", F.when(F.col("quantity") == 50, F.col("unit_price") + 1).otherwise(
        F.col("unit_price")).cast("decimal(18,4)"))


def _repaired(d: Data) -> DataFrame:
    lines = stored(_drifted(d))
    fixed = maintenance.apply_repair(lines, maintenance.arithmetic_repair(lines))
    return fixed.groupBy(arithmetic_mismatch().alias("mismatch"), F.coalesce("price_parse_source", F.lit("")).alias("source")).agg(
        F.count("*").alias("lines"))


def _manifest(d: Data) -> DataFrame:
    """A manifest for the products of one brand, stated from the data."""
    return stored(_stated(maintenance.identity_states(d.sales).where(F.col("identity").startswith("Brand#4 "))))


COUNTS = ["identity_row_count", "item_exception_count", "rule_scope_rows", "shared_product_key_identity_count"]
#: A brand for each predicate whose statement is wrong for it.
DRIFTS = {f"Brand#{12 + i}": p for i, p in enumerate(
    [*COUNTS, "current_categories", "effective_product", "product_key", "existing_rule", "raw_alias_keys", "item_exception_ids"])}


def _stated(state: DataFrame, wrong: Column | None = None) -> DataFrame:
    """Manifest rows; `wrong` names the predicate of a row that is stated wrongly."""
    wrong = F.lit("") if wrong is None else wrong
    count = lambda p: (F.col(p) + (wrong == p).cast("int")).alias(p)
    text = lambda p, value: F.when(wrong == p, F.lit("other")).otherwise(value).alias(p)
    listed = lambda p: F.when(wrong == p, F.array(F.lit("other"))).alias(p)
    return state.select(
        F.col("identity").alias("effective_product"), F.col("key").alias("product_key"), F.lit("алкоголь").alias("target_category"),
        "current_categories", F.col("rule_scope_rows").alias("expected_affected_item_count"),
        F.lit("CREATE_EXACT_RULE").alias("expected_rule_operation"),
        F.concat(F.array(*[F.lit(p) for p in (*COUNTS, "current_categories", "effective_product", "product_key", "existing_rule")]),
                 F.when(wrong.isin("raw_alias_keys", "item_exception_ids"), F.array(wrong)).otherwise(F.array().cast("array<string>"))).alias("stated"),
        F.struct(*[count(p) for p in COUNTS], text("current_categories", F.col("current_categories")), text("effective_product", F.col("identity")),
                 text("product_key", F.col("key")), text("existing_rule", F.lit(None).cast("string")), listed("raw_alias_keys"),
                 listed("item_exception_ids")).alias("predicates"))


#: What is stated wrongly in a manifest file for the products of a brand: column and text.
FAULTS = {
    "Brand#2": ("confidence", "LOW"), "Brand#3": ("target_category", "old"), "Brand#4": ("expected_rule_operation", "DROP"),
    "Brand#5": ("expected_affected_item_count", "one"), "Brand#6": ("protected_item_ids", "5"), "Brand#7": ("before_state_predicates", '{"other":1}'),
    "Brand#9": ("before_state_predicates", "none"), "Brand#10": ("effective_product", " "),
}


def _manifest_file(d: Data) -> DataFrame:
    """A manifest of all products as a CSV file, with a fault for some brands and one brand stated twice, read and validated."""
    brand = F.split_part(F.col("identity"), F.lit(" "), F.lit(1))
    stated = {
        "effective_product": F.col("identity"), "product_key": F.col("key"), "target_category": F.lit(V.DAIRY),
        "current_categories": F.lit("x:1"), "expected_affected_item_count": F.col("n").cast("string"), "expected_rule_operation": F.lit("LABEL_ONLY"),
        "before_state_predicates": F.to_json(F.struct(F.col("n").alias("identity_row_count"))), "required_exact_exclusions": F.lit(None).cast("string"),
        "protected_item_ids": F.lit(None).cast("string"), "reason": F.lit("why, \"so\""), "confidence": F.lit("HIGH")}
    for name, (column, text) in FAULTS.items():
        stated[column] = F.when(brand == name, F.lit(text)).otherwise(stated[column])
    rows = d.sales.groupBy(identity().alias("identity")).agg(F.min(product_key()).alias("key"), F.count("*").alias("n"))
    rows = rows.withColumn("_copy", F.explode(F.when(brand == "Brand#8", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    path = stream_folder(d.spark)
    rows.select(*[stated[c].alias(c) for c in manifest.COLUMNS]).write.option("header", True).option("escape", '"').option(
        "ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return manifest.validate_manifest(manifest.read_manifest(d.spark, path)).groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count("*").alias("products"), F.sum("expected_affected_item_count").alias("lines"), F.sum("predicates.identity_row_count").alias("stated_lines"))


def _projected(d: Data) -> DataFrame:
    """A file of receipt numbers that lacks those of one store and has unknown ones of another."""
    path = stream_folder(d.spark)
    numbers = d.receipts.select("store", "receipt_number")
    numbers.where("store <> 'MACHINERY'").unionByName(numbers.where("store = 'BUILDING'").withColumn(
        "receipt_number", F.concat(F.lit("X-"), "receipt_number"))).write.option("header", True).csv(path)
    rows, odd = manifest.project_csv(d.spark, path, "receipt_number", numbers)
    return odd.groupBy("side").agg(F.count("*").alias("receipts")).unionByName(
        rows.agg(F.lit("read").alias("side"), F.count("*").alias("receipts")))


def _reported(d: Data) -> DataFrame:
    """The category audit as a report of JSON lines, read back."""
    path = stream_folder(d.spark)
    write_report(quality.category_audit(d.sales, d.rules), path)
    return d.spark.read.schema("metric string, label string, n bigint").json(path)


def _drifts(d: Data) -> DataFrame:
    """Violations of a manifest that is wrong in another predicate for every brand."""
    brand = F.split_part(F.col("identity"), F.lit(" "), F.lit(1))
    wrong = F.try_element_at(F.create_map(*[F.lit(x) for p in DRIFTS.items() for x in p]), brand)
    manifest = stored(_stated(maintenance.identity_states(d.sales).where(brand.isin(*DRIFTS)), wrong))
    return maintenance.migration_violations(d.sales, d.rules, manifest)


def _migration_drift(d: Data) -> DataFrame:
    """A plan against tables that changed after it was made."""
    items, manifest = stored(d.sales), _manifest(d)
    lines, rules = (stored(t) for t in maintenance.migration_plan(items, d.rules, manifest))
    late = items.withColumn("category", F.when(F.col("quantity") == 50, "changed").otherwise(F.col("category")))
    new = d.rules.unionByName(rules.limit(1).select("product_key", F.lit("мясо").alias("category"), F.lit("manual").alias("source"),
                                                    *[F.lit("2001-01-01 00:00:00").cast("timestamp").alias(c) for c in ("created_at", "updated_at")]))
    new_items, new_rules = maintenance.migration_apply(late, new, lines, rules, "2001-02-03 00:00:00")
    return maintenance.migration_drift(late, new, lines, rules).groupBy("kind").agg(F.count("*").alias("n")).unionByName(
        new_items.where("category = 'алкоголь'").agg(F.lit("lines written").alias("kind"), F.count("*").alias("n"))).unionByName(
        new_rules.where("category = 'алкоголь'").agg(F.lit("rules written").alias("kind"), F.count("*").alias("n")))


def _migration(d: Data) -> DataFrame:
    items, manifest = stored(d.sales), _manifest(d)
    lines, rules = maintenance.migration_plan(items, d.rules, manifest)
    new_items, new_rules = maintenance.migration_apply(items, d.rules, stored(lines), rules, "2001-02-03 00:00:00")
    diff = stored(table_diff(items, new_items))
    bad = diff_violations(diff, lines, ["category"])
    return diff.groupBy(F.col("status").alias("kind"), F.array_join("changed_fields", ",").alias("detail")).agg(F.count("*").alias("n")).unionByName(
        bad.agg(F.count("*").alias("n")).select(F.lit("violations").alias("kind"), F.lit("").alias("detail"), "n")).unionByName(
        rules.groupBy(F.lit("rules").alias("kind"), F.col("operation").alias("detail")).agg(F.count("*").alias("n"))).unionByName(
        new_rules.agg(F.count("*").alias("n")).select(F.lit("rules").alias("kind"), F.lit("total").alias("detail"), "n"))


def _new_rules(d: Data) -> DataFrame:
    return d.sales.where("canonical_name LIKE 'Brand#8 %' OR canonical_name LIKE 'Brand#10 %'").select(
        product_key().alias("product_key"), F.lit("мясо").alias("category")).distinct()


def _sparse(d: Data) -> DataFrame:
    """Two stored versions that differ in the lines of one product range."""
    old = stored(d.sales)
    plan = old.where("quantity = 50 AND canonical_name LIKE 'Brand#11 new %'").select("receipt_id", "id", F.lit("одежда").alias("category"))
    return sparse_diff(old, stored(maintenance.override_lines(old, plan))).select(
        "receipt_id", "id", "status", F.array_join("changed_fields", ",").alias("changed_fields"))


query("price_backfill_statistics")(lambda d: maintenance.backfill_statistics(maintenance.backfill_plan(d.graded_items)))
query("price_backfill_fields")(lambda d: maintenance.backfill_field_counts(maintenance.backfill_plan(d.graded_items)))
query("price_backfill_apply")(lambda d: quality.price_quality(
    maintenance.backfill_apply(maintenance.backfill_plan(d.graded_items), ["package_name"])))
query("name_backfill")(lambda d: maintenance.name_backfill(d.sales).groupBy("outcome").agg(
    F.count("*").alias("lines"), F.countDistinct("normalized_name").alias("names")))
query("recategorize")(lambda d: maintenance.recategorize(d.sales).groupBy("touched", "category").agg(F.count("*").alias("lines")))
query("recategorize_overwrite")(lambda d: maintenance.recategorize(d.sales, overwrite=True).groupBy("touched", "category").agg(F.count("*").alias("lines")))
query("rule_upsert")(lambda d: maintenance.upsert_rules(d.rules, _new_rules(d), "2001-02-03 00:00:00").select(
    "product_key", "category", "source", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    F.date_format("updated_at", "yyyy-MM-dd").alias("updated")))
query("apply_product_categories")(lambda d: maintenance.apply_product_categories(d.sales, d.rules).groupBy(
    "category", "category_source").agg(F.count("*").alias("lines")))
query("override_lines")(lambda d: maintenance.override_lines(d.sales, d.sales.where("quantity = 50").select(
    "receipt_id", "id", F.lit("одежда").alias("category"))).groupBy("category", "category_source").agg(F.count("*").alias("lines")))
query("merge_products")(lambda d: maintenance.merge_products(d.sales, d.sales.select(identity().alias("selected")).where(
    "selected LIKE 'Brand#11 %'").distinct().withColumn("canonical", F.lit("Brand#11 merged"))).groupBy("canonical_name").agg(
    F.count("*").alias("lines")))
query("correction_previews")(lambda d: _previews(d).groupBy(
    F.coalesce("error", F.lit("")).alias("error"), "eligible_before", "eligible_after").agg(F.count("*").alias("lines")))
query("guarded_corrections")(_guarded)
query("arithmetic_repair")(_repaired)
query("manifest_validation")(_manifest_file)
query("csv_projection")(_projected)
query("report_sink")(_reported)
query("migration_violations")(_drifts)
query("migration_drift")(_migration_drift)
query("migration")(_migration)
query("migration_summary")(lambda d: maintenance.migration_summary(maintenance.migration_plan(d.sales, d.rules, _manifest(d))[0]))
query("snapshot_diff")(lambda d: table_diff(d.sales, maintenance.override_lines(
    d.sales.where("quantity > 1"), d.sales.where("quantity = 50").select("receipt_id", "id", F.lit("одежда").alias("category")))).groupBy(
    "status", F.coalesce(F.array_join("changed_fields", ","), F.lit("")).alias("changed_fields")).agg(F.count("*").alias("lines")))
query("snapshot_sparse_diff")(_sparse)
query("snapshot_equality")(lambda d: tables_equal(d.sales.where("quantity > 1"), d.sales.where("quantity < 50")))
query("snapshot_invariants")(lambda d: invariants(d.receipts, d.sales, d.rules))

# --- ingest and streams -------------------------------------------------------------------


def _parsed(d: Data) -> DataFrame:
    return receipt_text.parse_documents(tables.receipt_texts(d.spark, d.folder))


def _delivered(d: Data) -> DataFrame:
    """The receipt texts, those whose number ends in 7 twice; printed once."""
    texts = tables.receipt_texts(d.spark, d.folder)
    copies = F.array_repeat(F.lit(1), F.when(F.col("receipt_number").endswith("7"), 2).otherwise(1))
    return texts.select(*texts.columns, F.explode(copies).alias("_copy")).drop("_copy")


def _ingested(d: Data) -> DataFrame:
    parsed = receipt_text.parse_documents(_delivered(d))
    known = d.receipts.where("store = 'MACHINERY'").select("receipt_number")
    receipts, items = ingest.ingest(receipt_text.parsed_documents(parsed), known, d.rules, F.lit("parser"))
    return items.groupBy("category", "category_source", "price_parse_source", "normalized_price_unit").agg(
        F.count("*").alias("lines"), F.sum("price").cast("double").alias("spend")).unionByName(
        receipts.agg(F.count("*").alias("lines"), F.sum("total").cast("double").alias("spend")).select(
            *[F.lit("receipts").alias(c) for c in ("category", "category_source", "price_parse_source", "normalized_price_unit")],
            "lines", "spend"))


def _ingest_stream(d: Data) -> DataFrame:
    """Two runs over the same documents, the second without the first one's log."""
    source, target = stream_folder(d.spark), stream_folder(d.spark)
    texts = _delivered(d)
    texts.write.parquet(source)
    for _ in range(2):
        documents = d.spark.readStream.schema(texts.schema).parquet(source)
        ingest_stream(documents, target, d.rules, stream_folder(d.spark)).awaitTermination()
    count = lambda table, amount: d.spark.read.parquet(f"{target}/{table}").agg(
        F.lit(table).alias("kind"), F.count("*").alias("rows"), F.sum(amount).cast("double").alias("amount"))
    return count("receipts", "total").unionByName(count("items", "price"))


def _swept(d: Data) -> DataFrame:
    """Three deliveries to one folder, each swept by a stream that starts again: a half, the rest with repeats, all again."""
    source, target, log = stream_folder(d.spark), stream_folder(d.spark), stream_folder(d.spark)
    texts = stored(tables.receipt_texts(d.spark, d.folder))
    half = F.substring("receipt_number", 3, 20).cast("bigint") % 2 == 0
    session = sweep_session(d.spark)
    rules = Data(session, d.folder).rules
    for delivery in (texts.where(half), texts.where(~half | F.col("receipt_number").endswith("7")), texts.withColumn("text", F.concat("text", F.lit("\n")))):
        delivery.write.mode("append").parquet(source)
        documents = session.readStream.schema(texts.schema).parquet(source)
        sweep(documents, target, rules, log).awaitTermination()
    count = lambda table, amount: d.spark.read.parquet(f"{target}/{table}").groupBy(F.col("batch").cast("long").alias("batch")).agg(
        F.lit(table).alias("kind"), F.count("*").alias("rows"), F.sum(amount).cast("double").alias("amount"))
    return count("receipts", "total").unionByName(count("items", "price"))


def _loaded(d: Data) -> DataFrame:
    """The receipts of all stores but one as files of up to 2,000 nested receipts, loaded into new tables."""
    source = stream_folder(d.spark)
    receipts = tables.receipt_json(d.spark, d.folder).where("json LIKE '{\"synthetic\":true%'").select(
        F.floor(F.substring("source", 3, 20).cast("bigint") / 2000).alias("file"), F.from_json("json", ingest.NESTED).alias("d"))
    receipts.groupBy("file").agg(F.to_json(F.struct(F.lit(True).alias("synthetic"), F.flatten(F.collect_list("d.receipts")).alias("receipts"))).alias("value")).write.partitionBy(
        "file").text(source)
    return ingest.load_nested(d.spark, source, stream_folder(d.spark), d.rules)


def _stream_dedupe(d: Data) -> DataFrame:
    events = tables.event_stream(d.spark, d.folder)
    return run_to_end(drop_repeats(events, "event_id", "ts", "1 hour").drop("copy"), stream_folder(d.spark), "events").groupBy(
        "event_type").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("distinct_events"))


def _stream_enrich(d: Data) -> DataFrame:
    lines = tables.raw_lines(d.spark, d.folder, line=tables.line_stream(d.spark, d.folder)).select(
        "receipt_id", "name", "quantity", "price", "unit_price", "quantity_unit", "source")
    rich = enrich_stream(lines, d.rules)
    return run_to_end(rich, stream_folder(d.spark), "lines").groupBy("category", "category_source", "price_parse_source").agg(
        F.count("*").alias("lines"), F.sum("price").cast("double").alias("spend"))


query("parse_receipts")(lambda d: receipt_text.parsed_items(_parsed(d)).select(
    "receipt_number", "name", F.col("quantity").cast("double").alias("quantity"), "quantity_unit",
    F.col("unit_price").cast("double").alias("unit_price"), F.col("price").cast("double").alias("price")))
query("parse_receipt_heads")(lambda d: receipt_text.parsed_receipts(_parsed(d)).withColumn("total", F.col("total").cast("double")))
query("parse_free_text")(lambda d: receipt_text.parse_documents(d.table("documents").select(
    F.col("doc_id").cast("string").alias("receipt_number"), "text")).groupBy("store", "status").agg(F.count("*").alias("documents")))
query("ingest_receipts")(_ingested)
query("nested_receipts")(lambda d: ingest.validate_nested(tables.receipt_json(d.spark, d.folder)).groupBy(
    F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("receipts"), F.sum(F.size("r.items")).alias("lines")))
query("parser_audit")(lambda d: quality.parser_audit(d.sales.select("name").unionByName(d.table("documents").select(
    F.explode(F.split("text", "\n")).alias("name")))))
query("parser_audit_examples")(lambda d: quality.parser_examples(tables.spoiled_lines(d.spark, d.folder)))
query("classifier_conflicts")(lambda d: classify_names(tables.contested_names(d.spark, d.folder)).select("name", "predicted"))
query("classify_text_lines")(lambda d: classify_names(d.table("documents").select(F.explode(F.split("text", "\n")).alias("name"))).groupBy(
    "predicted").agg(F.count("*").alias("lines")))
query("ingest_stream")(_ingest_stream)
query("sweep_receipts")(_swept)
query("load_receipts")(_loaded)
query("stream_dedupe")(_stream_dedupe)
query("stream_enrich")(_stream_enrich)
