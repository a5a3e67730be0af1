"""Product names: normal form, measures, tokens, variants, structural checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tillroll import vocabulary as V
from tillroll.functions.columns import UNICODE, UNICODE_FOLD, first_group

# --- fixed values: letters kept in a normal form, words dropped from it -------------------
LETTERS = "a-zāčēģīķļņōŗšūž"
DROPPED_WORDS = ["d", "pet", "sk"]
MEASURE = r"(\d+(?:\.\d+)?)\s*(ml|l|kg|gr|g|gab)\.?\b"
BASE_UNIT = {"l": "ml", "ml": "ml", "kg": "g", "g": "g", "gr": "g", "gab": "gab"}

_OPEN, _SPLIT, _CLOSE = "\u0001", "\u0002", "\u0003"


def _folded_measure(marked: Column) -> Column:
    """`value<SPLIT>unit` in base units; counts keep up to two decimals."""
    value = F.split_part(marked, F.lit(_SPLIT), F.lit(1)).cast("double")
    unit = F.split_part(marked, F.lit(_SPLIT), F.lit(2))
    scaled = F.when(unit.isin("l", "kg"), value * 1000).otherwise(value)
    whole = F.bround(scaled, 0).cast("decimal(38,0)").cast("string")
    count = F.regexp_replace(F.bround(value, 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.when(unit == "gab", F.concat(F.when(count == "", "0").otherwise(count), F.lit("gab"))).when(
        unit.isin("l", "ml"), F.concat(whole, F.lit("ml"))).otherwise(F.concat(whole, F.lit("g")))


def normalize(name: Column) -> Column:
    """Lower-case search form with measures in ml, g or gab."""
    text = F.lower(F.coalesce(name, F.lit("")))
    text = F.regexp_replace(text, r"(?<=\d),(?=\d)", ".")
    text = F.regexp_replace(text, r"[-_/]+", " ")
    text = F.regexp_replace(text, rf"{UNICODE}[^0-9{LETTERS}%.\s]", " ")
    text = F.trim(F.regexp_replace(text, UNICODE + r"\s+", " "))
    # regexp_replace cannot calculate, so measures are marked, cut out and folded one by one.
    marked = F.regexp_replace(text, UNICODE + MEASURE, f"{_OPEN}$1{_SPLIT}$2{_CLOSE}")
    pieces = F.transform(F.split(marked, f"[{_OPEN}{_CLOSE}]"), lambda piece: F.when(
        F.contains(piece, F.lit(_SPLIT)), _folded_measure(piece)).otherwise(piece))
    text = F.when(F.contains(marked, F.lit(_OPEN)), F.array_join(pieces, "")).otherwise(text)
    text = F.regexp_replace(text, r"(\d+(?:\.\d+)?)\s*%", "$1%")
    words = F.transform(F.split(text, " "), lambda word: F.regexp_replace(word, r"^\.+|\.+$", ""))
    return F.trim(F.regexp_replace(
        F.array_join(F.filter(words, lambda word: ~word.isin(DROPPED_WORDS)), " "), " +", " "))


def features(normalized: Column) -> Column:
    """Volume, weight and percentage read from a normal form."""
    return F.struct(
        first_group(normalized, UNICODE + r"\b(\d+)ml\b").try_cast("bigint").alias("volume_ml"),
        first_group(normalized, UNICODE + r"\b(\d+)g\b").try_cast("bigint").alias("weight_g"),
        first_group(normalized, UNICODE + r"\b(\d+(?:\.\d+)?)%").try_cast("decimal(18,4)").alias("percentage"),
    )


@pandas_udf(StringType())
def fold_diacritics(names: pd.Series) -> pd.Series:
    """Compatibility decomposition has no built-in counterpart; one Arrow batch at a time."""
    return names.map(lambda name: None if name is None else "".join(
        c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)))


def significant_tokens(normalized: Column) -> Column:
    """Distinct words of two or more letters, sorted."""
    words = F.regexp_extract_all(F.coalesce(normalized, F.lit("")), F.lit(
        UNICODE + rf"\b((?!\d+(?:ml|g|gab)?\b)(?!\d+(?:\.\d+)?%\b)[{LETTERS}]{{2,}})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(words))


def variants(comparison_name: Column, folded_name: Column) -> Column:
    """Sorted markers that tell products apart: flavour, grade, egg size, caliber."""
    lowered = F.lower(folded_name)
    words = F.transform(significant_tokens(comparison_name),
                        lambda word: F.try_element_at(F.create_map(
                            *[F.lit(x) for pair in V.VARIANT_WORDS.items() for x in pair]), word))
    extra = F.array(
        F.when(comparison_name.rlike(UNICODE + r"\bl\s+l\s+galu\b"), F.lit("beef")),
        F.concat(F.lit("quality-grade:"), first_group(lowered, UNICODE + r"\b(\d+)\s*\.\s*sk\.?\b")),
        F.concat(F.lit("egg-size:"), first_group(lowered, UNICODE + r"\b([lm])\s*\.?\s*izm\.?\b")),
        F.concat(F.lit("caliber:"), first_group(lowered, UNICODE + r"\b(\d+)\+\s*(?:mm|mu)\b")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(words, extra))))


def multipack(name: Column) -> Column:
    """`count x size unit` in base units, NULL for a single pack."""
    pattern = UNICODE_FOLD + r"(?<!\d)(\d+)\s*[xх×]\s*(\d+(?:[.,]\d+)?)\s*(gab|ml|kg|gr|g|l)\b"
    value = F.replace(F.regexp_extract(name, pattern, 2), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(F.regexp_extract(name, pattern, 3))
    size = F.bround(F.when(unit.isin("l", "kg"), value * 1000).otherwise(value), 0).cast("bigint")
    base = F.try_element_at(F.create_map(*[F.lit(x) for p in BASE_UNIT.items() for x in p]), unit)
    return F.when(name.rlike(pattern), F.concat_ws(
        " ", F.regexp_extract(name, pattern, 1), F.lit("x"), size.cast("string"), base))


def is_valid_item_name(name: Column) -> Column:
    """Three characters or more and not a bare unit or measure."""
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (F.length(text) >= 3) & ~text.isin("gab", "gab.") & ~text.rlike(r"^\d+(g|ml|gab|kg|l)\.?$")
