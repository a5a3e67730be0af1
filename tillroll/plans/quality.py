"""Data-quality scans, worklists, health counters and category audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import classify_names, is_legacy, reporting_label, write_label
from tillroll.functions.columns import is_blank, not_blank, settled
from tillroll.functions.evidence import (
    arithmetic_mismatch, issue_filters, low_confidence, suspicious_price, with_correctability,
)
from tillroll.functions.identity import SPELLING, product_key, trimmed_identity
from tillroll.functions.names import normalize
from tillroll.functions.receipts import with_contamination
from tillroll.operators.snapshots import row_digest
from tillroll.session import stored


def price_quality(items: DataFrame) -> DataFrame:
    """All price counters in one scan."""
    unit = F.col("normalized_price_unit")
    known = F.col("normalized_unit_price").isNotNull() & unit.isNotNull() & (unit != "unknown")
    return items.agg(
        F.count("*").alias("lines"), F.count("line_total").alias("with_line_total"),
        F.count("unit_price").alias("with_unit_price"), F.count("normalized_unit_price").alias("with_normalized_price"),
        F.count_if(unit == "eur_per_l").alias("per_litre"), F.count_if(unit == "eur_per_kg").alias("per_kilogram"),
        F.count_if(unit == "eur_per_piece").alias("per_piece"),
        F.count_if(unit.isNull() | (unit == "unknown")).alias("unit_unknown"),
        F.count_if(F.col("price_parse_confidence") < V.MIN_CONFIDENCE).alias("stated_low_confidence"),
        F.count_if(low_confidence()).alias("low_confidence"), F.count_if(suspicious_price()).alias("suspicious"),
        F.count_if(arithmetic_mismatch()).alias("arithmetic_mismatch"), F.count_if(known).alias("comparable"),
    ).withColumn("coverage_percent", F.coalesce(F.round(F.try_divide(
        F.col("comparable").cast("decimal(20,0)") * 100, F.col("lines")).cast("decimal(28,6)"), 1).cast("double"), F.lit(0.0)))


def page_size(limit) -> int:
    return min(max(int(limit), 10), 200)


def issue_worklist(obs: DataFrame, issue: str = "all", limit: int = 50) -> DataFrame:
    """Newest lines with the issue; only the page shown is graded for correctability."""
    filters = issue_filters()
    page = obs.where(filters.get(issue, filters["all"])).withColumn("mismatch", arithmetic_mismatch()).orderBy(
        F.desc("date"), F.desc("receipt_id"), F.desc("id")).limit(page_size(limit))
    evidence = "evidence" if "evidence" in obs.columns else None
    return with_correctability(page, evidence=evidence).select(
        "date", "receipt_id", F.col("id").cast("string").alias("line_id"), "name", "store",
        F.col("quantity").cast("double").alias("quantity"),
        F.coalesce("line_total", "price").cast("double").alias("paid"), "mismatch", "classification", "classification_reason")


def correctability(obs: DataFrame) -> DataFrame:
    evidence = "evidence" if "evidence" in obs.columns else None
    return with_correctability(obs, evidence=evidence).groupBy("classification", F.coalesce(
        "classification_reason", F.lit("")).alias("classification_reason")).agg(F.count("*").alias("lines"))


def mismatched_lines(items: DataFrame) -> DataFrame:
    return items.where(arithmetic_mismatch()).select(
        "receipt_id", F.col("id").cast("string").alias("line_id"),
        F.round(F.abs(F.col("quantity") * F.col("unit_price") - F.coalesce("line_total", "price")), 4).cast("double").alias("difference"))


def group_health(items: DataFrame) -> DataFrame:
    """Product groups in more than one category, and groups with unresolved lines."""
    label = reporting_label(F.col("category"))
    # keys are computed once per spelling; settled, as Spark drops a distinct below minima and flags
    spelled = items.select(*SPELLING, "category").distinct().select("category", settled(product_key()).alias("k"))
    groups = spelled.groupBy("k").agg(
        F.min(label).alias("a"), F.max(label).alias("b"), F.bool_or(label == V.UNRESOLVED).alias("u"))
    return groups.agg(F.count_if(F.col("a") != F.col("b")).alias("conflicts"), F.count_if("u").alias("unresolved"),
                      F.count("*").alias("groups"))


def action_queue(items: DataFrame, sales: DataFrame | None = None, merge_count: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Operations with something to do, most urgent first. Both scans give one row each;
    `sales` are the lines without a price model, which categories do not need."""
    quality, health = price_quality(items), group_health(items if sales is None else sales)
    one = quality.select("low_confidence", "suspicious", health.select(F.struct("conflicts", "unresolved")).scalar().alias("h")).select(
        "low_confidence", "suspicious", "h.conflicts", "h.unresolved").withColumns({
        "merges": merge_count.scalar() if merge_count is not None else F.lit(0).cast("bigint")})
    # Key, priority, severity.
    rows = [("category_conflicts", 1.0, "critical", "conflicts"), ("low_confidence_prices", 2.0, "high", "low_confidence"),
            ("suspicious_prices", 2.1, "high", "suspicious"), ("merge_suggestions", 4.0, "medium", "merges"),
            ("uncategorized", 5.0, "low", "unresolved")]
    queue = one.select(F.explode(F.array(*[F.struct(
        F.lit(k).alias("key"), F.lit(p).alias("priority"), F.lit(s).alias("severity"),
        F.col(c).cast("bigint").alias("n")) for k, p, s, c in rows])).alias("r")).select("r.*")
    return rank_actions(queue, limit)


def rank_actions(queue: DataFrame, limit: int = 5) -> DataFrame:
    return queue.where((F.col("n") > 0) & (F.col("key") != "no_manual_rule")).orderBy(
        "priority", F.desc("n")).limit(limit)


def _digests(columns: list[str], names: tuple[str, str]) -> list[Column]:
    return [row_digest(columns, salt).alias(name) for salt, name in enumerate(names, 1)]


def review_groups(obs: DataFrame, rules: DataFrame, query: str = "") -> DataFrame:
    """Product groups with a category or name problem, as counts and flags.

    Nothing of unbounded size is collected; `review_values` lists the distinct values of
    the groups in long form. Lines are counted by spelling, label, source and store first, and keys
    made once per spelling. Receipts are counted by digests of spelling and key, so that a line moves
    as numbers; exact but for collisions of 128 bits.
    """
    if query:
        text = f"%{query}%"
        obs = obs.where(F.col("identity").ilike(text) | F.col("name").ilike(text) | F.col("normalized_name").ilike(text))
    label = reporting_label(F.col("category"))
    source = F.coalesce("category_source", F.lit("rule"))
    spelled = stored(obs.groupBy(*SPELLING, "category", "category_source", "store").agg(
        F.min("identity").alias("identity"), F.count("*").alias("n"), F.max("date").alias("date")).select(
        "*", *_digests(SPELLING, ("_a", "_b"))))
    keyed = stored(spelled.select(*SPELLING, "_a", "_b").distinct().select(
        "_a", "_b", settled(product_key()).alias("product_key")).select("*", *_digests(["product_key"], ("_k", "_l"))))
    lines = spelled.join(keyed.select("_a", "_b", "product_key"), ["_a", "_b"]).withColumns({"label": label, "source": source})
    receipts = obs.select(*_digests(SPELLING, ("_a", "_b")), "receipt_id").join(keyed.drop("product_key"), ["_a", "_b"]).groupBy(
        "_k", "_l").agg(F.countDistinct("receipt_id").alias("receipt_count"))
    groups = lines.groupBy("product_key").agg(
        F.min("identity").alias("display_name"), F.sum("n").alias("item_count"), F.max("date").alias("last_date"),
        F.min("label").alias("first_label"), F.bool_or(F.col("label") == V.UNRESOLVED).alias("unresolved"),
        F.bool_or(is_legacy(F.col("category"))).alias("legacy"),
        F.bool_or(F.col("source") == "fallback").alias("fallback"),
        (F.bool_or(F.col("source") == "manual") & F.bool_or(F.col("source") == "rule")).alias("manual_and_rule"),
        F.bool_or(F.coalesce(F.col("normalized_name") == "", F.lit(True))).alias("no_normalized_name"),
        F.bool_or(is_blank(F.col("category"))).alias("empty_category"),
        F.bool_or(F.coalesce(F.col("canonical_name") != "", F.lit(False))).alias("has_canonical_name"),
        F.countDistinct("label").alias("label_count"), F.countDistinct("name").alias("alias_count"),
        F.countDistinct("store").alias("store_count"))
    groups = groups.join(keyed.select("product_key", "_k", "_l").distinct().join(receipts, ["_k", "_l"]), "product_key")
    keys = rules.select("product_key", F.lit(True).alias("has_rule")).distinct()
    groups = groups.join(keys, "product_key", "left").withColumn(
        "has_rule", F.coalesce("has_rule", F.lit(False)))
    problems = F.concat_ws(
        ",", F.when(F.col("unresolved"), "unresolved"), F.when(F.col("legacy"), "legacy_category"),
        F.when(F.col("fallback"), "fallback"), F.when(F.col("label_count") > 1, "category_conflict"),
        F.when(F.col("manual_and_rule"), "manual_and_rule"), F.when(F.col("no_normalized_name"), "no_normalized_name"),
        F.when(~F.col("has_rule"), "no_manual_rule"), F.when(F.col("empty_category"), "empty_category"))
    return groups.withColumn("problems", problems).where("problems != ''").select(
        "product_key", "display_name", "item_count", "receipt_count", "alias_count", "store_count", "last_date",
        (F.col("label_count") - 1).alias("conflict_count"),
        F.when(F.col("label_count") == 1, F.col("first_label")).otherwise(V.UNRESOLVED).alias("category"),
        "has_rule", "has_canonical_name", "problems")


def review_values(obs: DataFrame) -> DataFrame:
    """Distinct aliases, labels, sources, stores and legacy labels per product group."""
    kinds = {"alias": F.col("name"), "category": reporting_label(F.col("category")),
             "source": F.coalesce("category_source", F.lit("rule")), "store": F.col("store"),
             "legacy": F.when(is_legacy(F.col("category")), F.trim("category"))}
    spelled = obs.select(*SPELLING, "category", "category_source", "store").distinct().withColumn("product_key", product_key())
    return spelled.select("product_key", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("v")).select(
        "product_key", "v.*").where(not_blank(F.col("value"))).distinct()


PROBLEM_FILTERS = {"other": ["unresolved"], "conflict": ["category_conflict"], "no_rule": ["no_manual_rule"],
                   "new": ["no_manual_rule", "no_normalized_name"]}


def review_page(groups: DataFrame, problem: str = "all", sort: str = "count", limit: int = 50, page: int = 1) -> DataFrame:
    wanted = PROBLEM_FILTERS.get(problem)
    if wanted:
        groups = groups.where(F.arrays_overlap(F.split("problems", ","), F.array(*[F.lit(w) for w in wanted])))
    name = F.lower("display_name")
    order: dict[str, list[Column]] = {
        "conflicts": [F.desc("conflict_count"), F.desc("item_count"), name],
        "recent": [F.desc("last_date")], "name": [name], "count": [F.desc("item_count"), name]}
    size = page_size(limit)
    return groups.orderBy(*order.get(sort, order["count"]), "product_key").offset((max(page, 1) - 1) * size).limit(size)


def page_info(groups: DataFrame, limit: int = 50, page: int = 1) -> DataFrame:
    size = page_size(limit)
    return groups.agg(F.count("*").alias("total_count")).select(
        "total_count", F.lit(page > 1).alias("has_prev"), (F.lit(page * size) < F.col("total_count")).alias("has_next"))


def category_audit(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Long table of category metrics; the lines are read once for the counts and once for the groups."""
    label, blank = reporting_label(F.col("category")), is_blank(F.col("category"))
    entry = lambda metric, text=F.lit(""): F.struct(
        F.lit(metric).alias("metric"), text.alias("label"), F.lit(1).cast("bigint").alias("n"))
    keys = rules.select("product_key", F.lit(True).alias("covered")).distinct()
    lines = items.select("category", "category_source", product_key().alias("product_key")).join(keys, "product_key", "left")
    totals = ["total_items", "empty_categories", "other_count", "covered_by_rules", "unknown_categories"]
    per_line = lines.select(F.explode(F.array_compact(F.array(
        entry("category", F.coalesce("category", F.lit(""))), entry("source", F.coalesce("category_source", F.lit(""))),
        entry("total_items"), F.when(blank, entry("empty_categories")), F.when(label == V.UNRESOLVED, entry("other_count")),
        F.when(F.col("covered"), entry("covered_by_rules"))))).alias("e")).select("e.*").groupBy("metric", "label").agg(F.sum("n").alias("n"))
    # of the few counted labels, each unknown one counts once more
    unknown = (F.col("metric") == "category") & not_blank(F.col("label")) & ~reporting_label(F.col("label")).isin(V.CANONICAL_CATEGORIES)
    counted = per_line.select(F.explode(F.array_compact(F.array(
        F.struct("metric", "label", "n"), F.when(unknown, entry("unknown_categories"))))).alias("e")).select("e.*")
    zeros = items.sparkSession.createDataFrame([(m, "", 0) for m in totals], "metric string, label string, n bigint")
    return (counted.unionByName(zeros).groupBy("metric", "label").agg(F.sum("n").alias("n"))
            .unionByName(rules.agg(F.countDistinct("product_key").alias("n")).select(F.lit("manual_rules").alias("metric"), F.lit("").alias("label"), "n"))
            .unionByName(group_health(items).select(F.lit("conflict_groups").alias("metric"), F.lit("").alias("label"),
                                                    F.col("conflicts").alias("n"))))


def classifier_records(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored label, predicted label and rule label of every line."""
    raw_key = F.when(not_blank(F.col("normalized_name")), F.trim("normalized_name")).otherwise(normalize(F.col("name")))
    lines = items.select("receipt_id", "id", F.coalesce("name", F.lit("")).alias("name"), trimmed_identity().alias("identity"),
                         reporting_label(F.col("category")).alias("persisted"), raw_key.alias("product_key"))
    known = rules.select("product_key", write_label(F.col("category")).alias("rule_category")).dropDuplicates(["product_key"])
    return classify_names(lines).join(known, "product_key", "left")


def classifier_confusion(records: DataFrame) -> DataFrame:
    return records.groupBy("persisted", "predicted", F.col("rule_category").isNotNull().alias("rule_covered")).agg(
        F.count("*").alias("lines"))


def classifier_summary(records: DataFrame) -> DataFrame:
    """Exact and fallback rates, per line and per product, for all, covered and rule-free lines."""
    scoped = records.withColumn("scope", F.explode(F.array(
        F.lit("overall"), F.when(F.col("rule_category").isNotNull(), "rule_covered").otherwise("rule_free"))))
    exact, fallback = F.col("persisted") == F.col("predicted"), F.col("predicted") == V.UNRESOLVED
    products = scoped.groupBy("scope", "identity").agg(
        F.count("*").alias("n"), F.count_if(exact).alias("e"), F.count_if(fallback).alias("f"),
        F.count_if(F.col("rule_category") != F.col("predicted")).alias("o"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a).cast("decimal(20,0)"), F.col(b)).cast("decimal(20,8)"), 4).cast("double"), F.lit(0.0))
    return products.groupBy("scope").agg(
        F.sum("n").alias("lines"), F.sum("e").alias("exact_matches"), F.sum("f").alias("fallback_count"),
        F.count("*").alias("identities"), F.count_if(F.col("e") == F.col("n")).alias("exact_identities"),
        F.sum("o").alias("rule_override_lines")).withColumns({
            "exact_rate": rate("exact_matches", "lines"), "fallback_rate": rate("fallback_count", "lines"),
            "exact_identity_rate": rate("exact_identities", "identities")})


def classifier_samples(records: DataFrame, n: int = 3) -> DataFrame:
    """First lines of every confused pair; the rank limit already applies before the shuffle."""
    order = W.partitionBy("persisted", "predicted").orderBy("receipt_id", "id")
    return records.where(F.col("persisted") != F.col("predicted")).withColumn("rank", F.row_number().over(order).cast("bigint")).where(
        F.col("rank") <= n).select("persisted", "predicted", "rank", "name")


def category_sources(items: DataFrame) -> DataFrame:
    return items.groupBy("category_source").agg(F.count("*").alias("lines"))


def parser_audit(names: DataFrame) -> DataFrame:
    """Contamination class and projected action of names, counted; equal names are read once."""
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    return with_contamination(counted).groupBy("contamination", "action").agg(
        F.sum("n").alias("lines"), F.count("*").alias("names"), F.min("name").alias("example"))


def parser_examples(lines: DataFrame, n: int = 5) -> DataFrame:
    """First n lines of every contamination class by (receipt_id, id), with the parser's action.

    A class's first n lines are among the first n of their names, so lines are cut to n a
    name and names are classified once; both rank limits apply before their shuffle and
    no state holds more than n lines. A missing name is an empty one. Lines that tie in
    receipt, id and name are the same example.
    """
    first = W.partitionBy("name").orderBy("receipt_id", "id")
    cut = lines.select("receipt_id", "id", F.coalesce("name", F.lit("")).alias("name")).withColumn(
        "rank", F.row_number().over(first)).where(F.col("rank") <= n)
    names = with_contamination(cut.groupBy("name").agg(F.collect_list(F.struct("receipt_id", "id")).alias("kept")))
    order = W.partitionBy("contamination").orderBy("receipt_id", "id", "name")
    return names.select("contamination", "action", "name", F.explode("kept").alias("k")).select("contamination", "action", "name", "k.*").withColumn(
        "rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n).select(
        "contamination", "rank", "receipt_id", "id", "name", "action")
