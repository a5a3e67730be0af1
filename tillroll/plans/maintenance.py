"""Maintenance as plan, apply, verify: a plan is a table, applying it gives a new version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import classify_names, write_label
from tillroll.functions.columns import not_blank, parse_decimal, settled
from tillroll.functions.evidence import arithmetic_mismatch, with_correctability, with_ineligibility
from tillroll.functions.identity import SPELLING, identity, product_key
from tillroll.functions.names import is_valid_item_name, normalize
from tillroll.functions.price import derive_price
from tillroll.operators.snapshots import LINE_KEY
from tillroll.session import stored

# --- fixed values: fields of the price model and their handling ---------------------------
VALUE_FIELDS = ["line_total", "unit_price", "quantity_unit", "package_size", "package_unit",
                "normalized_unit_price", "normalized_price_unit"]
TARGET_FIELDS = [*VALUE_FIELDS, "price_parse_source", "price_parse_confidence"]
UNIT_FIELDS = {"quantity_unit", "package_unit", "normalized_price_unit"}
TEXT_FIELDS = UNIT_FIELDS | {"price_parse_source"}
SAFE_SOURCES = ["package_name", "weighted_inference"]
CONFLICT_WARNINGS = ["ambiguous_package_size", "invalid_package_size", "multipack_unresolved",
                     "normalized_unit_price_suspicious", "parser_contamination", "service_line"]
DERIVED_FIELDS = ["unit_price", "quantity_unit", "package_size", "package_unit", "normalized_unit_price",
                  "normalized_price_unit", "price_parse_source", "price_parse_confidence"]
STATE_FIELDS = ["id", "receipt_id", "name", "canonical_name", "normalized_name", "quantity", "price", "line_total",
                "unit_price", "quantity_unit", "package_size", "package_unit", "normalized_unit_price",
                "normalized_price_unit", "price_parse_source", "price_parse_confidence", "category", "category_source"]


def _missing(field: str, value: Column) -> Column:
    if field in UNIT_FIELDS:
        return value.isNull() | value.isin("", "unknown")
    return value.isNull() | (value == "") if field in TEXT_FIELDS else value.isNull()


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


# --- price backfill -----------------------------------------------------------------------

def backfill_plan(items: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Per line the merged price fields, what changed, and a conflict verdict.

    Only missing values are filled; a stated confidence is never lowered. `review` lists
    lines (receipt_id, id) kept for manual review.
    """
    kinds = _types(items)
    df = derive_price(items, line_total="price", default_source="legacy_backfill", out="_d",
                      evidence="evidence" if "evidence" in items.columns else None)
    if review is not None:
        df = df.join(review.select(*LINE_KEY).distinct().withColumn("_review", F.lit(True)), LINE_KEY, "left")
    else:
        df = df.withColumn("_review", F.lit(None).cast("boolean"))
    new = {f: F.col(f"_d.{f}").cast(kinds[f]) for f in VALUE_FIELDS}
    new["price_parse_source"], new["price_parse_confidence"] = F.col("_d.source"), F.col("_d.confidence")
    df = df.withColumns({f"_n_{f}": value for f, value in new.items()})
    stated = F.col("price_parse_confidence")
    service = (F.col("_d.source") == "service_line") & F.coalesce(stated < F.lit("0.90").cast("decimal(4,2)"), F.lit(True))
    fill = {f: _missing(f, F.col(f)) & F.col(f"_n_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_n_{f}")) for f in VALUE_FIELDS}
    agrees = reduce(lambda a, b: a & b, [
        _missing(f, F.col(f"_n_{f}")) | _missing(f, F.col(f)) | (F.col(f) == F.col(f"_n_{f}")) for f in VALUE_FIELDS])
    filled = reduce(lambda a, b: a | b, fill.values())
    df = df.withColumns({"_service": service, "_filled": filled, "_agrees": F.coalesce(agrees, F.lit(False)),
                         **{f"_f_{f}": c for f, c in fill.items()}})
    better = F.col("_filled") & F.col("_n_price_parse_confidence").isNotNull() & F.coalesce(
        F.col("_n_price_parse_confidence") > stated, F.lit(True))
    # A service line loses its price instead of gaining one.
    cleared = {"quantity_unit": F.lit("unknown"), "normalized_unit_price": F.lit(None), "normalized_price_unit": F.lit("unknown"),
               "price_parse_source": F.lit("service_line"), "price_parse_confidence": F.lit(None)}
    merged = {}
    for f in TARGET_FIELDS:
        if f in VALUE_FIELDS:
            value = F.when(F.col(f"_f_{f}"), F.col(f"_n_{f}")).otherwise(F.col(f))
        else:
            gap = (F.col("_filled") | F.col("_agrees")) & _missing(f, F.col(f)) & F.col(f"_n_{f}").isNotNull()
            value = F.when(better | gap, F.col(f"_n_{f}")).otherwise(F.col(f))
        if f in cleared:
            value = F.when(F.col("_service"), cleared[f].cast(kinds[f])).otherwise(value)
        else:
            value = F.when(F.col("_service"), F.col(f)).otherwise(value)
        merged[f] = value
    df = df.withColumns({f"new_{f}": value for f, value in merged.items()})
    warnings = F.col("_d.warnings")
    reasons = F.array_intersect(warnings, F.array(*[F.lit(w) for w in CONFLICT_WARNINGS]))
    review_line = F.coalesce("_review", F.lit(False))
    verdict = F.when((stated >= F.lit("0.90").cast("decimal(4,2)")) & (review_line | (F.size(reasons) > 0)), F.when(
        review_line, "manual_review").when(F.array_contains(warnings, "service_line"), "service_line").when(
        F.array_contains(warnings, "parser_contamination"), "parser_contamination").when(
        F.array_contains(warnings, "multipack_unresolved"), "multipack").when(
        F.array_contains(warnings, "ambiguous_package_size") | F.array_contains(warnings, "invalid_package_size"),
        "malformed_or_ambiguous_package").otherwise("suspicious"))
    plan = F.struct(
        *[F.col(f"new_{f}").alias(f) for f in TARGET_FIELDS],
        F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in TARGET_FIELDS])).alias("changed_fields"),
        F.col("_d.source").alias("derived_source"), warnings.alias("warnings"), verdict.alias("conflict"))
    return df.select(*[c for c in items.columns], settled(plan).alias("plan"))


def backfill_statistics(plan: DataFrame) -> DataFrame:
    """Counters of a plan by derived source, merged unit and confidence."""
    changed = F.size("plan.changed_fields") > 0
    return plan.groupBy(
        F.col("plan.derived_source").alias("derived_source"),
        F.coalesce("plan.normalized_price_unit", F.lit("unknown")).alias("normalized_price_unit"),
        F.coalesce(F.col("plan.price_parse_confidence").cast("string"), F.lit("NULL")).alias("confidence"),
        F.coalesce("plan.conflict", F.lit("")).alias("conflict")).agg(
        F.count("*").alias("checked"), F.count_if(changed).alias("to_update"),
        F.sum(F.size("plan.warnings")).alias("warnings"))


def backfill_field_counts(plan: DataFrame) -> DataFrame:
    return plan.select("plan.derived_source", F.explode("plan.changed_fields").alias("field")).groupBy(
        "derived_source", "field").agg(F.count("*").alias("lines"))


def backfill_apply(plan: DataFrame, sources: list[str]) -> DataFrame:
    """New version of the lines: selected sources only, never a conflict."""
    unknown = sorted(set(sources) - set(SAFE_SOURCES))
    if unknown or not sources:
        raise ValueError(f"sources must be chosen from {SAFE_SOURCES}, got {sources}")
    chosen = F.col("plan.derived_source").isin(sources) & F.col("plan.conflict").isNull() & (F.size("plan.changed_fields") > 0)
    return plan.select(*[F.when(chosen, F.col(f"plan.{c}")).otherwise(F.col(c)).alias(c) if c in TARGET_FIELDS else F.col(c)
                         for c in plan.columns if c != "plan"])


# --- names and categories -----------------------------------------------------------------

def name_backfill(items: DataFrame) -> DataFrame:
    """Search form where it is blank; `outcome` tells what happened."""
    filled = not_blank(F.col("normalized_name"))
    df = items.withColumn("_new", F.nullif(normalize(F.col("name")), F.lit("")))
    return df.withColumn("outcome", F.when(filled, "already_filled").when(
        F.col("_new").isNull(), "unresolved").otherwise("to_update")).withColumn(
        "normalized_name", F.when(filled, F.col("normalized_name")).otherwise(F.coalesce("_new", "normalized_name"))).drop("_new")


def recategorize(items: DataFrame, overwrite: bool = False) -> DataFrame:
    """Labels from names, for all lines or only those without one; unusable names become `прочее`."""
    scope = F.lit(True) if overwrite else F.coalesce(F.col("category") == "", F.lit(True))
    label = F.when(is_valid_item_name(F.col("name")), F.col("predicted")).otherwise("прочее")
    return classify_names(items).withColumns({
        "_scope": scope, "category": F.when(scope, label).otherwise(F.col("category"))}).withColumnRenamed(
        "_scope", "touched").drop("predicted")


def upsert_rules(rules: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """`new` has product_key and category; known keys keep their creation time."""
    fresh = new.select("product_key", write_label(F.col("category")).alias("_category")).dropDuplicates(["product_key"])
    joined = rules.join(fresh, "product_key", "full")
    hit, stamp = F.col("_category").isNotNull(), F.lit(now).cast("timestamp")
    return joined.select(
        "product_key", F.coalesce("_category", "category").alias("category"),
        F.when(hit, "manual").otherwise(F.col("source")).alias("source"), F.coalesce("created_at", stamp).alias("created_at"),
        F.when(hit, stamp).otherwise(F.col("updated_at")).alias("updated_at"))


def apply_product_categories(items: DataFrame, new: DataFrame) -> DataFrame:
    """Give every line of a product group the category of its key."""
    chosen = new.select(F.col("product_key").alias("_key"), write_label(F.col("category")).alias("_category")).dropDuplicates(["_key"])
    df = items.withColumn("_pk", product_key()).join(chosen, F.col("_pk") == F.col("_key"), "left")
    return _override(df).select(*items.columns)


def _override(df: DataFrame) -> DataFrame:
    hit = F.col("_category").isNotNull()
    return df.withColumns({"category": F.coalesce("_category", "category"),
                           "category_source": F.when(hit, "manual").otherwise(F.col("category_source"))})


def override_lines(items: DataFrame, new: DataFrame) -> DataFrame:
    """Category of single lines; labels outside the vocabulary are ignored."""
    label = write_label(F.col("category"))
    chosen = new.where(label.isin(V.CANONICAL_CATEGORIES)).select(*LINE_KEY, label.alias("_category")).dropDuplicates(LINE_KEY)
    return _override(items.join(chosen, LINE_KEY, "left")).select(*items.columns)


def merge_products(items: DataFrame, merges: DataFrame) -> DataFrame:
    """`merges` maps a selected name to one canonical name.

    A line follows if its name, manual name or identity was selected. The identity is one
    of the other two, so two lookups are enough; the manual name goes first.
    """
    target = merges.where(not_blank(F.col("selected")) & not_blank(F.col("canonical"))).select(
        F.trim("selected").alias("_k"), F.trim("canonical").alias("_v")).groupBy("_k").agg(F.min("_v").alias("_v"))
    by_manual = target.select(F.col("_k").alias("_km"), F.col("_v").alias("_vm"))
    by_name = target.select(F.col("_k").alias("_kn"), F.col("_v").alias("_vn"))
    df = items.join(by_manual, F.col("canonical_name") == F.col("_km"), "left").join(by_name, F.col("name") == F.col("_kn"), "left")
    return df.withColumn("canonical_name", F.coalesce("_vm", "_vn", "canonical_name")).select(*items.columns)


# --- reviewed price corrections -----------------------------------------------------------

def state_hash(fields: list[str] = STATE_FIELDS) -> Column:
    """Fingerprint of a stored line: an ordered JSON of its fields, NULLs included."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def correction_previews(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """Every proposal against its line: an error code, or the projected price fields.

    Items carry store and date. Proposals have receipt_id, id and the proposed
    quantity_unit, package_size (text) and package_unit; they are written once. The lines they
    name are found by a semi-join, which the planner moves below the join that added store and
    date, so other lines are not moved for it.
    """
    wanted = stored(proposals.select(*LINE_KEY, F.trim(F.coalesce("quantity_unit", F.lit(""))).alias("p_unit"),
                              F.nullif(F.trim(F.col("package_size").cast("string")), F.lit("")).alias("p_text"),
                              F.trim(F.coalesce(F.nullif(F.col("package_unit"), F.lit("")), F.lit("unknown"))).alias("p_base")))
    lines = items.join(wanted.select(*LINE_KEY), LINE_KEY, "left_semi").join(wanted, LINE_KEY)
    columns = lines.columns
    lines = with_correctability(lines).withColumn("p_size", parse_decimal(F.col("p_text")))
    lines = derive_price(lines, unit="p_unit", package_size="p_size", package_unit="p_base",
                         source=F.lit("manual_correction"), out="after")
    lines = with_ineligibility(lines, out="reason_before")
    projected = {"unit_price": "after.unit_price", "quantity_unit": "after.quantity_unit", "package_size": "after.package_size",
                 "package_unit": "after.package_unit", "normalized_unit_price": "after.normalized_unit_price",
                 "normalized_price_unit": "after.normalized_price_unit", "price_parse_source": "after.source",
                 "price_parse_confidence": "after.confidence"}
    kept = {c: F.col(c) for c in ("quantity", "line_total")}
    lines = lines.withColumn("_then", F.struct(*[v.alias(k) for k, v in kept.items()],
                                               *[F.col(v).alias(k) for k, v in projected.items()]))
    lines = with_ineligibility(lines, prefix="_then.", out="reason_after")
    size, warnings = F.col("p_size"), F.col("after.warnings")
    price = F.col("after.normalized_unit_price")
    blocking = F.arrays_overlap(warnings, F.array(*[F.lit(w) for w in V.BLOCKING_WARNINGS]))
    error = F.when(F.col("classification") != "CORRECTABLE_V1", F.concat(F.lit("not_correctable:"), "classification_reason")).when(
        ~F.col("p_unit").isin("piece", "kg", "g", "l", "ml"), "unsupported_quantity_unit").when(
        ~F.col("p_base").isin("g", "ml", "piece", "unknown"), "unsupported_package_unit").when(
        F.col("p_text").isNotNull() & size.isNull(), "package_size_not_a_number").when(size <= 0, "package_size_not_positive").when(
        size.isNull() != (F.col("p_base") == "unknown"), "size_and_unit_belong_together").when(
        (F.col("p_unit") != "piece") & size.isNotNull(), "no_package_for_a_physical_unit").when(
        size > F.when(F.col("p_base") == "piece", V.MAX_PACKAGE_PIECES).otherwise(V.MAX_PACKAGE_BASE_UNITS), "package_size_too_large").when(
        (F.col("p_base") == "piece") & (size != F.floor(size)), "pieces_must_be_whole").when(
        blocking, "blocking_diagnostic_remains").when(
        F.coalesce((price <= 0) | (price > V.MAX_NORMALIZED_PRICE), F.lit(True)), "normalized_price_out_of_range")
    return lines.select(*columns, "after", error.alias("error"), F.col("reason_before").isNull().alias("eligible_before"),
                        F.col("reason_after").isNull().alias("eligible_after"))


def correction_tokens(previews: DataFrame) -> DataFrame:
    """What a reviewer confirms: the state seen and the values to be written."""
    return previews.where("error IS NULL").select(
        *LINE_KEY, state_hash().alias("before_hash"), F.col("p_unit").alias("quantity_unit"),
        F.col("p_text").alias("package_size"), F.col("p_base").alias("package_unit"),
        F.sha2(F.to_json(F.col("after"), {"ignoreNullFields": "false"}), 256).alias("after_hash"))


def apply_corrections(items: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New lines, and the tokens refused because the line or the model changed meanwhile."""
    now = correction_previews(items, tokens)
    checked = now.withColumn("_hash", state_hash()).join(
        tokens.select(*LINE_KEY, "before_hash", "after_hash"), LINE_KEY).withColumn("refused", F.when(
            F.col("_hash") != F.col("before_hash"), "line_changed").when(F.col("error").isNotNull(), F.col("error")).when(
            F.sha2(F.to_json(F.col("after"), {"ignoreNullFields": "false"}), 256) != F.col("after_hash"), "model_changed"))
    accepted = checked.where("refused IS NULL").select(*LINE_KEY, "after")
    source = {"price_parse_source": "source", "price_parse_confidence": "confidence"}
    kinds = _types(items)
    updated = items.join(accepted, LINE_KEY, "left").select(*[
        F.when(F.col("after").isNotNull(), F.col(f"after.{source.get(c, c)}").cast(kinds[c])).otherwise(F.col(c)).alias(c)
        if c in DERIVED_FIELDS else F.col(c) for c in items.columns])
    gone = tokens.join(items.select(*LINE_KEY), LINE_KEY, "left_anti").select(*LINE_KEY, F.lit("line_missing").alias("refused"))
    return updated, checked.where("refused IS NOT NULL").select(*LINE_KEY, "refused").unionByName(gone)


def arithmetic_repair(items: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Lines whose stored product disagrees with the paid total, with the model derived twice.

    `repairable` holds where the second derivation gives the same result without warnings
    and, if a list of allowed lines is given, the line is on it.
    """
    bad = items.where(arithmetic_mismatch())
    once = derive_price(bad, out="first_pass")
    twice = derive_price(once, quantity=F.col("first_pass.quantity"), line_total=F.col("first_pass.line_total"), unit_price=F.col("first_pass.unit_price"),
                         unit=F.col("first_pass.quantity_unit"), package_size=F.col("first_pass.package_size"),
                         package_unit=F.col("first_pass.package_unit"), source=F.col("first_pass.source"), out="after")
    fixed = reduce(lambda a, b: a & b, [F.col(f"first_pass.{f}").eqNullSafe(F.col(f"after.{f}")) for f in (
        "unit_price", "quantity_unit", "package_size", "package_unit", "normalized_unit_price", "normalized_price_unit")])
    listed = F.lit(True)
    if allowed is not None:
        twice = twice.join(allowed.select(*LINE_KEY).distinct().withColumn("_listed", F.lit(True)), LINE_KEY, "left")
        listed = F.coalesce("_listed", F.lit(False))
    return twice.select(*items.columns, "after", (fixed & (F.size("after.warnings") == 0) & listed).alias("repairable"))


def apply_repair(items: DataFrame, repair: DataFrame) -> DataFrame:
    """Optimistic: only lines still in the state the repair was planned on are written."""
    plan = repair.where("repairable").select(*LINE_KEY, state_hash().alias("_seen"), "after")
    kinds, source = _types(items), {"price_parse_source": "source", "price_parse_confidence": "confidence"}
    df = items.withColumn("_now", state_hash()).join(plan, LINE_KEY, "left")
    hit = F.coalesce(F.col("_now") == F.col("_seen"), F.lit(False))
    return df.select(*[F.when(hit, F.col(f"after.{source.get(c, c)}").cast(kinds[c])).otherwise(F.col(c)).alias(c)
                       if c in DERIVED_FIELDS else F.col(c) for c in items.columns])


# --- category migration from a manifest ---------------------------------------------------

def identity_states(items: DataFrame) -> DataFrame:
    """Per product the facts a manifest row states: counts, histogram text, modal label, keys.

    The modal label is the most frequent one, of equally frequent ones the first by name.
    Lines are counted once by spelling and label; all else is read from these counts.
    """
    lines = stored(_labelled(items.groupBy(*SPELLING, "category").agg(F.count("*").alias("n")), "n"))
    counts = lines.groupBy("identity", "category").agg(F.sum("n").alias("n"))
    histogram = counts.groupBy("identity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))),
                                 lambda c: F.concat_ws(":", c["category"], c["n"].cast("string"))), "|").alias("current_categories"),
        F.sum("n").alias("identity_row_count"), F.min(F.struct((-F.col("n")).alias("less"), "category")).alias("_top"))
    keys = lines.groupBy("identity").agg(F.min("key").alias("key"), F.max("key").alias("key_b"))
    scope = lines.groupBy("key").agg(F.sum("n").alias("rule_scope_rows"), F.countDistinct("identity").alias("shared_product_key_identity_count"))
    return histogram.join(keys, "identity").join(scope, "key").withColumns({
        "modal_category": F.col("_top.category"), "item_exception_count": F.col("identity_row_count") + F.col("_top.less")}).drop("_top")


def _labelled(items: DataFrame, *keep: str) -> DataFrame:
    return items.select(*keep, identity().alias("identity"), product_key().alias("key"),
                        F.coalesce("category", F.lit("")).alias("category"))


def line_name(receipt: str = "receipt_id", line: str = "id") -> Column:
    """A line as a manifest names it."""
    return F.concat_ws(":", F.col(receipt).cast("string"), F.col(line).cast("string"))


def exception_lines(items: DataFrame, states: DataFrame) -> DataFrame:
    """(identity, value): the lines whose label is not their product's modal one, one row each."""
    return _labelled(items, *LINE_KEY).join(states.select("identity", "modal_category"), "identity").where(
        "category != modal_category").select("identity", line_name().alias("value"))


def alias_keys(items: DataFrame) -> DataFrame:
    """(identity, value): the keys a product's stored spellings have."""
    value = F.when(not_blank(F.col("normalized_name")), F.trim("normalized_name")).otherwise(normalize(F.col("name")))
    return items.select(*SPELLING).distinct().select(identity().alias("identity"), settled(value).alias("value")).distinct()


def migration_violations(items: DataFrame, rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """Everything that keeps a manifest from being applied; empty means it may be.

    `stated` lists the predicates a row makes a statement on; each of them is compared,
    so a stated null (no rule expected) differs from a rule that exists now.
    """
    states = identity_states(items)
    now = states.select(*[F.col(c).alias(f"now_{c}") for c in states.columns])
    known = rules.select(F.col("product_key").alias("_rule_key"), F.concat_ws("|", "category", "source").alias("now_rule"))
    m = manifest.join(now, F.col("effective_product") == F.col("now_identity"), "left").join(
        known, F.col("product_key") == F.col("_rule_key"), "left")
    actual = {"current_categories": "now_current_categories", "effective_product": "effective_product", "product_key": "product_key",
              "existing_rule": "now_rule", **{p: f"now_{p}" for p in (
                  "identity_row_count", "item_exception_count", "rule_scope_rows", "shared_product_key_identity_count")}}
    drifts = {f"{p}_drift": F.array_contains("stated", p) & ~F.col(f"predicates.{p}").eqNullSafe(F.col(c)) for p, c in actual.items()}
    drifts["current_categories_drift"] = drifts["current_categories_drift"] | ~F.col("current_categories").eqNullSafe(F.col("now_current_categories"))
    checks = {
        "identity_missing": F.col("now_identity").isNull(),
        "product_key_mismatch": (F.col("now_key") != F.col("product_key")) | (F.col("now_key_b") != F.col("product_key")),
        "rule_scope_drift": ~F.col("expected_affected_item_count").eqNullSafe(F.col("now_rule_scope_rows")), **drifts,
        "already_in_target": F.contains(F.concat(F.lit("|"), F.col("now_current_categories")), F.concat(F.lit("|"), F.col("target_category"), F.lit(":"))),
    }
    found = m.select("effective_product", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))).alias("violation"))
    mixed = _rule_targets(manifest, rules).groupBy("rule_key").agg(
        F.min("target_category").alias("a"), F.max("target_category").alias("b"), F.min("effective_product").alias("effective_product")).where(
        "a != b").select("effective_product", F.lit("mixed_rule_targets").alias("violation"))
    return reduce(DataFrame.unionByName, [found, mixed, _list_drift(manifest, "raw_alias_keys", alias_keys(items)),
                                          _list_drift(manifest, "item_exception_ids", exception_lines(items, states))])


def _list_drift(manifest: DataFrame, predicate: str, actual: DataFrame) -> DataFrame:
    """Products whose stated list is not the actual (identity, value) rows; both sides stay long tables."""
    stated = manifest.where(F.array_contains("stated", predicate)).select(
        F.col("effective_product").alias("identity"), F.col(f"predicates.{predicate}").alias("values"))
    wanted = stated.select("identity", F.explode("values").alias("value"))
    there = actual.join(stated.select("identity"), "identity", "left_semi")
    return wanted.exceptAll(there).unionByName(there.exceptAll(wanted)).select(
        F.col("identity").alias("effective_product"), F.lit(f"{predicate}_drift").alias("violation")).distinct()


def _rule_targets(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule keys a manifest wants to hold its target."""
    op = F.col("expected_rule_operation")
    aliases = F.coalesce("predicates.raw_alias_keys", F.array().cast("array<string>"))
    keys = F.when(op == "MULTI_RULE_EXACT", F.array_union(F.array("product_key"), aliases)).otherwise(F.array("product_key"))
    wanted = manifest.select("effective_product", "target_category", op.alias("op"), F.explode(keys).alias("rule_key"))
    known = rules.select(F.col("product_key").alias("rule_key"), F.lit(True).alias("_known")).distinct()
    return wanted.join(known, "rule_key", "left").where((F.col("op") != "LABEL_ONLY") | F.col("_known")).drop("_known")


def migration_plan(items: DataFrame, rules: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line changes and rule changes of a manifest. One with violations is refused."""
    refused = migration_violations(items, rules, manifest).limit(5).collect()
    if refused:
        raise ValueError("manifest refused: " + "; ".join(f"{r.effective_product}: {r.violation}" for r in refused))
    lines = items.select(*LINE_KEY, identity().alias("effective_product"), F.col("category").alias("old_category")).join(
        manifest.select("effective_product", F.col("target_category").alias("new_category")), "effective_product")
    targets = _rule_targets(manifest, rules).select(F.col("rule_key").alias("product_key"), "target_category").distinct()
    rule_changes = targets.join(rules.select("product_key", "category", "source", "updated_at"), "product_key", "left").select(
        "product_key", F.col("category").alias("old_category"), F.col("source").alias("old_source"),
        F.col("updated_at").alias("old_updated_at"), F.col("target_category").alias("new_category"),
        F.when(F.col("category").isNull(), "insert").when(F.col("category") == F.col("target_category"), "unchanged")
        .otherwise("update").alias("operation"))
    return lines, rule_changes


def _rule_as_planned() -> Column:
    """A rule still has the label, source and time of the plan, or still does not exist."""
    return (F.col("category").eqNullSafe(F.col("old_category")) & F.col("source").eqNullSafe(F.col("old_source"))
            & F.col("updated_at").eqNullSafe(F.col("old_updated_at")))


def migration_drift(items: DataFrame, rules: DataFrame, line_changes: DataFrame, rule_changes: DataFrame) -> DataFrame:
    """(kind, key): planned changes whose row is no longer as planned; empty means every one will be written."""
    now = items.select(*LINE_KEY, F.lit(True).alias("_there"), "category")
    lines = line_changes.join(now, LINE_KEY, "left").where(
        F.col("_there").isNull() | ~F.col("category").eqNullSafe(F.col("old_category"))).select(
        F.lit("line").alias("kind"), line_name().alias("key"))
    changed = rule_changes.where("operation != 'unchanged'").join(rules.select("product_key", "category", "source", "updated_at"), "product_key", "left")
    return lines.unionByName(changed.where(~_rule_as_planned()).select(F.lit("rule").alias("kind"), F.col("product_key").alias("key")))


def migration_apply(items: DataFrame, rules: DataFrame, line_changes: DataFrame, rule_changes: DataFrame,
                    now: str) -> tuple[DataFrame, DataFrame]:
    """New lines and rules. A line or a rule changes only if it still is as planned;
    publish the result only where migration_drift is empty."""
    change = line_changes.select(*LINE_KEY, F.col("old_category").alias("_old"), F.col("new_category").alias("_new"))
    hit = F.col("_new").isNotNull() & F.col("category").eqNullSafe(F.col("_old"))
    new_items = items.join(change, LINE_KEY, "left").withColumn(
        "category", F.when(hit, F.col("_new")).otherwise(F.col("category"))).select(*items.columns)
    stamp = F.lit(now).cast("timestamp")
    moved = rule_changes.where("operation != 'unchanged'").select(
        "product_key", "old_category", "old_source", "old_updated_at", F.col("new_category").alias("_new"))
    fits = F.col("_new").isNotNull() & _rule_as_planned()
    new_rules = rules.join(moved, "product_key", "full").select(
        "product_key", F.when(fits, F.col("_new")).otherwise(F.col("category")).alias("category"),
        F.coalesce("source", F.lit("manual")).alias("source"), F.coalesce("created_at", stamp).alias("created_at"),
        F.when(fits, stamp).otherwise(F.col("updated_at")).alias("updated_at")).where("category IS NOT NULL")
    return new_items, new_rules


def migration_summary(line_changes: DataFrame) -> DataFrame:
    return line_changes.groupBy(F.coalesce("old_category", F.lit("")).alias("source"), F.col("new_category").alias("target")).agg(
        F.count("*").alias("lines"))
