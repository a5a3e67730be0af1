"""Category labels and the fail-closed name classifier."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tillroll import vocabulary as V
from tillroll.functions.columns import first_true, is_blank, lookup, settled


def reporting_label(category: Column) -> Column:
    """Read side: legacy labels count as unresolved, unknown ones stay as they are."""
    value = F.lower(F.trim(category))
    return F.when(is_blank(category) | value.isin(list(V.LEGACY_CATEGORIES)), F.lit(V.UNRESOLVED)).otherwise(value)


def write_label(category: Column) -> Column:
    """Write side: legacy labels become the label that replaced them."""
    value = F.lower(F.trim(category))
    return F.when(is_blank(category), F.lit(V.UNRESOLVED)).otherwise(lookup(V.LEGACY_CATEGORIES, value, value))


def is_unresolved(category: Column, strict_reference: bool = False) -> Column:
    """NULL, blank, not canonical or, unless strict, stored as the unresolved label."""
    known = V.CANONICAL_CATEGORIES if strict_reference else V.CANONICAL_CATEGORIES[:-1]
    return is_blank(category) | ~F.lower(F.trim(category)).isin(known)


def is_legacy(category: Column) -> Column:
    """A non-blank label outside the canonical vocabulary."""
    return ~is_blank(category) & ~F.lower(F.trim(category)).isin(V.CANONICAL_CATEGORIES)


def classifier_text(name: Column) -> Column:
    """Letters only, lower case, one blank before and after every word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(
        F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


@cache
def _keyword_tree() -> dict:
    """The keywords letter by letter; a node lists, under an empty key, the categories of a keyword that ends there."""
    root: dict = {}
    for at, category in enumerate(V.CATEGORY_PRIORITY):
        for pattern in V.keyword_patterns()[category]:
            node = root
            for letter in pattern:
                node = node.setdefault(letter, {})
            node.setdefault("", []).append(at)
    return root


def keyword_places(text: str) -> list[int]:
    """Where a keyword of each category first begins in the padded text, from 1; 0 without any.

    Every keyword begins with a blank, so the tree is entered once per word and left at the first
    letter that no keyword has there.
    """
    root, places = _keyword_tree(), [0] * len(V.CATEGORY_PRIORITY)
    at = text.find(" ")
    while at >= 0:
        node, i = root, at
        while i < len(text) and (node := node.get(text[i])) is not None:
            for category in node.get("", ()):
                places[category] = places[category] or at + 1
            i += 1
        at = text.find(" ", at + 1)
    return places


@pandas_udf(T.ArrayType(T.IntegerType()))
def _places(texts: pd.Series) -> pd.Series:
    return texts.map(keyword_places)


def classify(df: DataFrame, name: str = "name", out: str = "predicted") -> DataFrame:
    """Add `out`: the category the name alone supports, else the unresolved label.

    Narrow. Names repeat, so callers classify distinct names and join the labels back.
    """
    keep = [c for c in df.columns if c != out]
    df = df.withColumn("_text", classifier_text(F.col(name))).withColumn("_at", _places("_text"))
    text = F.col("_text")

    def place(category):
        return F.get("_at", V.CATEGORY_PRIORITY.index(category))

    def word(*words):
        return text.rlike(" (?:" + "|".join(words) + ") ")

    def begins(*starts):
        return text.rlike(" (?:" + "|".join(starts) + ")")

    hits = {c: place(c) > 0 for c in V.CATEGORY_PRIORITY}
    # Words that only mean something together.
    baby = F.coalesce(F.col(name), F.lit("")).rlike(r"(?U)(?<!\d)\d{1,2}\s*\+") & begins("biez", "putr", "pire")
    fries = word("frī", "fri") & begins("kartupeļ", "kartupel", "kartup")
    noodles = begins("nūd", "nud") & word("zupa", "ramyun", "instant")
    bag = begins("maisiņ", "maisin") & ~begins("atkritum")
    buns = begins("burgeru") & F.contains(text, F.lit("maiz"))
    hits[V.BABY] = hits[V.BABY] | baby
    hits[V.FROZEN] = hits[V.FROZEN] | fries
    hits[V.READY_MEALS] = ~buns & (hits[V.READY_MEALS] | noodles)
    hits[V.SERVICE] = hits[V.SERVICE] | bag
    # One array computed once per row; each hit is then a lookup.
    df = df.withColumn("_s", F.array(*[hits[c] for c in V.CATEGORY_PRIORITY]))

    def hit(category):
        return F.get("_s", V.CATEGORY_PRIORITY.index(category))

    sauce_form = begins("mērc", "merc", "majon", "kečup", "kecup", "konserv") | F.contains(
        text, F.lit("tomātu pasta")) | F.contains(text, F.lit("tomatu pasta"))
    closed = (
        (word("hortex") & ~hit(V.FROZEN))
        | (begins("humoss") & ~hit(V.SAUCES))
        | (begins("kuskus") & ~hit(V.READY_MEALS))
        | (begins("vārīt", "varit") & hit(V.PRODUCE) & ~hit(V.READY_MEALS))
        | (begins("salāt", "salat") & hit(V.SAUCES) & ~sauce_form)
        | begins("pankūk", "pankuk")
        | (word("uzkoda") & hit(V.DAIRY) & ~hit(V.SNACKS))
        | (word("pulveris") & hit(V.PRODUCE) & ~hit(V.SOFT_DRINKS))
    )
    # The type named first wins; each rule sees what the rules before it left over.
    alive = {c: hit(c) for c in V.CATEGORY_PRIORITY}
    for first, second in ((V.MEAT, V.DAIRY), (V.MEAT, V.BAKERY), (V.SNACKS, V.DAIRY), (V.SOFT_DRINKS, V.DAIRY)):
        earlier = place(first) <= place(second)
        clash = alive[first] & alive[second]
        step = {"_first": alive[first] & ~(clash & ~earlier), "_second": alive[second] & ~(clash & earlier)}
        tag = f"{len(df.columns)}"
        df = df.withColumns({k + tag: v for k, v in step.items()})
        alive[first], alive[second] = F.col("_first" + tag), F.col("_second" + tag)
    label = first_true([(closed, F.lit(V.UNRESOLVED)),
                        *[(alive[c], F.lit(c)) for c in V.CATEGORY_PRIORITY],
                        (F.lit(True), F.lit(V.UNRESOLVED))])
    return df.select(*keep, settled(label).alias(out))


def label_source(category: Column) -> Column:
    return F.when(category == V.UNRESOLVED, "fallback").otherwise("rule")


def classify_names(df: DataFrame, name: str = "name", out: str = "predicted") -> DataFrame:
    """Classify every distinct name once and join the label back."""
    labels = classify(df.select(F.col(name).alias("_name")).where(F.col(name).isNotNull()).distinct(), "_name", out)
    return df.join(labels, F.col(name) == F.col("_name"), "left").drop("_name").withColumn(
        out, F.coalesce(F.col(out), F.lit(V.UNRESOLVED)))
