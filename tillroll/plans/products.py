"""Product names: search, resolution, merge catalogue, duplicate suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.columns import not_blank, settled
from tillroll.functions.identity import identity
from tillroll.functions.names import features, fold_diacritics, multipack, normalize, significant_tokens, variants
from tillroll.functions.similarity import ORDERED, similar_pairs
from tillroll.operators.snapshots import row_digest
from tillroll.session import stored


def matches(text: str, *fields: str) -> Column:
    """Substring search over several columns; `%` and `_` stay wildcards."""
    test = F.lit(False)
    for field in fields:
        test = test | F.coalesce(F.col(field).ilike(f"%{text}%"), F.lit(False))
    return test


def search_products(items: DataFrame, text: str, n: int = 10) -> DataFrame:
    found = items.withColumn("identity", identity()).where(
        matches(text, "identity", "name", "normalized_name")).select("identity").distinct()
    return found.where(not_blank(F.col("identity"))).orderBy(
        F.when(F.col("identity") == text, 0).otherwise(1), F.lower("identity"), "identity").limit(n)


def resolve_names(asked: DataFrame, items: DataFrame) -> DataFrame:
    """`asked` names to identities: an exact identity, else an alias of exactly one product."""
    named = items.select("name", identity().alias("identity")).distinct()
    exact = named.select(F.col("identity").alias("asked"), F.col("identity").alias("exact")).distinct()
    alias = named.groupBy(F.col("name").alias("asked")).agg(
        F.min("identity").alias("a"), F.max("identity").alias("b")).where("a = b").select("asked", F.col("a").alias("alias"))
    return asked.join(exact, "asked", "left").join(alias, "asked", "left").select(
        "asked", F.coalesce("exact", "alias").alias("identity"))


def merge_catalogue(items: DataFrame, text: str = "") -> DataFrame:
    """Products with their line and receipt counts. A product has at most one non-blank manual name."""
    lines = items.withColumn("product", identity())
    if text:
        lines = lines.where(matches(text, "product", "name", "canonical_name"))
    return lines.groupBy("product").agg(
        F.count("*").alias("item_count"), F.countDistinct("receipt_id").alias("receipt_count"),
        F.max(F.nullif(F.col("canonical_name"), F.lit(""))).alias("canonical_name"))


def name_features(names: DataFrame) -> DataFrame:
    """Search form, measures, multipack and tokens of every distinct name."""
    df = names.select("name").where(F.col("name").isNotNull()).distinct().withColumn("normalized", normalize(F.col("name")))
    return df.withColumn("f", features(F.col("normalized"))).select(
        "name", "normalized", "f.volume_ml", "f.weight_g", F.col("f.percentage").cast("double").alias("percentage"),
        multipack(F.col("name")).alias("multipack"), F.array_join(significant_tokens(F.col("normalized")), " ").alias("tokens"))


def catalogue(items: DataFrame, text: str = "") -> DataFrame:
    """Distinct spellings of products with counts.

    Receipts are counted by a digest of the spelling and its texts once per spelling, so a line
    moves as three numbers; exact but for collisions of 128 bits.
    """
    lines = items.withColumn("identity", identity())
    if text:
        lines = lines.where(matches(text, "identity", "name", "normalized_name"))
    spelling = ["name", "normalized_name", "identity", "category"]
    lines = lines.select("name", F.coalesce("normalized_name", F.lit("")).alias("normalized_name"), "identity",
                         F.nullif(F.col("category"), F.lit("")).alias("category"), "receipt_id")
    digests = [row_digest(spelling, salt).alias(name) for salt, name in ((1, "_a"), (2, "_b"))]
    texts = lines.groupBy(*spelling).agg(F.count("*").alias("item_count")).select("*", *digests)
    receipts = lines.select(*digests, "receipt_id").groupBy("_a", "_b").agg(F.countDistinct("receipt_id").alias("receipt_count"))
    return texts.join(receipts, ["_a", "_b"]).drop("_a", "_b")


def with_match_features(products: DataFrame) -> DataFrame:
    normalized = F.when(F.col("normalized_name") != "", F.col("normalized_name")).otherwise(normalize(F.col("name")))
    # settled, as Spark moves a test of grouped columns below the aggregation, to parts and lines
    df = products.withColumn("normalized", settled(normalized)).where("normalized != ''")
    df = df.withColumn("folded", fold_diacritics(F.col("name")))
    df = df.withColumn("comparison", normalize(F.col("folded")))
    df = df.withColumn("comparison", F.when(F.col("comparison") != "", F.col("comparison")).otherwise(F.col("normalized")))
    return df.select(
        F.md5(F.to_json(F.struct("name", "normalized_name", "identity", "category"))).alias("pid"),
        "name", "normalized", "identity", "category", "item_count", "receipt_count", "comparison",
        significant_tokens(F.col("comparison")).alias("tokens"), features(F.col("normalized")).alias("f"),
        multipack(F.col("name")).alias("pack"), variants(F.col("comparison"), F.col("folded")).alias("variants"))


def comparison_blocks(products: DataFrame) -> DataFrame:
    """(block, pid, comparison, side): products that may be one good share a block.

    Multipack and variants must be equal. A product with a volume or a weight meets those
    with the same one (side 2); one without any, or with a zero, meets all (side 2 in a
    block where the others are side 1).
    """
    kind = F.to_json(F.struct("pack", F.array_join("variants", "|").alias("variants")), {"ignoreNullFields": "false"})
    zero = (F.col("f.volume_ml") == 0) | (F.col("f.weight_g") == 0)
    unmeasured = F.col("f.volume_ml").isNull() & F.col("f.weight_g").isNull()
    rows = products.select(kind.alias("kind"), "pid", "comparison", "f.volume_ml", "f.weight_g",
                           (unmeasured | F.coalesce(zero, F.lit(False))).alias("open"))
    measures = F.array_compact(F.array(F.concat(F.lit("v"), F.col("volume_ml")), F.concat(F.lit("w"), F.col("weight_g"))))
    measured = rows.where("not open").select("kind", F.explode(measures).alias("measure"), "pid", "comparison").select(
        F.concat_ws("/", "kind", "measure").alias("block"), "pid", "comparison", F.lit(2).alias("side"))
    return measured.unionByName(rows.select(F.concat("kind", F.lit("/")).alias("block"), "pid", "comparison",
                                            F.when(F.col("open"), 2).otherwise(1).alias("side")))


def _compatible(l: str, r: str) -> Column:  # noqa: E741
    """No evidence that the two are different goods."""
    a, b = (lambda f: F.col(f"{l}.{f}")), (lambda f: F.col(f"{r}.{f}"))
    measured = lambda x: x("f.volume_ml").isNotNull() | x("f.weight_g").isNotNull()
    kind = lambda f: a(f).isNotNull() & b(f).isNotNull()
    same_kind = kind("f.volume_ml") | kind("f.weight_g")
    agree = [F.coalesce((a(f) == 0) | (b(f) == 0) | (a(f) == b(f)), F.lit(True)) for f in ("f.volume_ml", "f.weight_g")]
    return (a("pack").eqNullSafe(b("pack")) & ~(measured(a) & measured(b) & ~same_kind) & agree[0] & agree[1]
            & F.coalesce(F.abs(a("f.percentage") - b("f.percentage")) <= F.lit("0.05").cast("decimal(4,2)"), F.lit(True))
            & (a("variants") == b("variants")))


def duplicate_suggestions(products: DataFrame, limit: int | None = None, confidence: str | None = None,
                          ordered: int = ORDERED) -> DataFrame:
    """Pairs of products that are probably one: all compatible pairs that reach the score.

    `products` comes from with_match_features. Pairs are looked up in an index of letter pairs and
    words; `ordered` bounds the frequencies that order it, not the result.
    """
    products = stored(products)
    l, r = products.alias("l"), products.alias("r")  # noqa: E741
    pairs = similar_pairs(comparison_blocks(products), V.POSSIBLE_SCORE, ordered).select("left_pid", "right_pid", F.struct("score", "symmetric").alias("s"))
    scored = pairs.join(l, F.col("left_pid") == F.col("l.pid")).join(r, F.col("right_pid") == F.col("r.pid")).where(
        _compatible("l", "r") & ~((F.col("l.normalized") == F.col("r.normalized")) & (F.col("l.identity") == F.col("r.identity"))))
    left_first = (F.col("l.item_count") > F.col("r.item_count")) | (
        (F.col("l.item_count") == F.col("r.item_count")) & (F.lower("l.identity") <= F.lower("r.identity")))
    side = lambda f: [F.when(left_first, F.col(f"{x}.{f}")).otherwise(F.col(f"{y}.{f}")).alias(f"{n}_{f}")
                      for x, y, n in (("l", "r", "left"), ("r", "l", "right"))]
    shared = lambda f: F.when(F.col(f"l.f.{f}") == F.col(f"r.f.{f}"), F.col(f"l.f.{f}"))
    high = (F.col("s.score") >= V.HIGH_SCORE) & (F.col("l.tokens") == F.col("r.tokens"))
    term = F.array_min(F.filter(F.array_intersect("l.tokens", "r.tokens"), lambda t: ~t.isin(list(V.VARIANT_WORDS))))
    result = scored.select(
        *side("identity"), *side("normalized"), *side("item_count"), *side("receipt_count"), *side("category"),
        F.round("s.score", 2).alias("score"), F.round("s.symmetric", 2).alias("symmetric_score"),
        F.when(high, "high").otherwise("possible").alias("confidence"),
        shared("volume_ml").alias("volume_ml"), shared("weight_g").alias("weight_g"),
        shared("percentage").cast("double").alias("percentage"),
        F.when(F.col("l.pack") == F.col("r.pack"), F.col("l.pack")).alias("multipack"),
        (F.col("l.tokens") == F.col("r.tokens")).alias("same_words"),
        F.coalesce(F.col("l.category") == F.col("r.category"), F.lit(False)).alias("same_category"),
        F.coalesce(term, F.split_part(F.when(left_first, F.col("l.identity")).otherwise(F.col("r.identity")), F.lit(" "), F.lit(1))).alias("merge_term"))
    if confidence in ("high", "possible"):
        result = result.where(F.col("confidence") == confidence)
    if limit is not None:
        result = result.orderBy(F.desc("score"), F.desc(F.col("left_item_count") + F.col("right_item_count")),
                                "left_identity", "right_identity").limit(min(max(limit, 10), 200))
    return result


def high_confidence_count(suggestions: DataFrame) -> DataFrame:
    return suggestions.where("confidence = 'high'").agg(F.count("*").alias("n"))
