"""Small column helpers: lenient parsing, exact decimals, literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
AMOUNT = "decimal(18,4)"
CONFIDENCE = "decimal(4,2)"
# Java needs these flags for Unicode-aware \w, \b, \d and case folding.
UNICODE = "(?U)"
UNICODE_FOLD = "(?iuU)"
# Two blanks, or a character that may be white space but is no blank; no white space is in the ranges.
_SPACED = r"  |[^ -~\x{a1}-\x{167f}]"


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def not_blank(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def one_space(value: Column) -> Column:
    """Trimmed text with every run of white space as one blank; the costly pattern runs only where it may match."""
    text = F.coalesce(value, F.lit(""))
    return F.trim(F.when(text.rlike(_SPACED), F.regexp_replace(text, UNICODE + r"\s+", " ")).otherwise(text))


def parse_decimal(value: Column, as_type: str = AMOUNT) -> Column:
    """Number from text with a decimal comma or point; NULL when it is not a number."""
    return F.replace(value.cast("string"), F.lit(","), F.lit(".")).try_cast(as_type)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, NULL where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def first_true(rules) -> Column:
    """Value of the first condition that holds, NULL when none does."""
    rules = list(rules)
    chain = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain


def codes(rules) -> Column:
    """Sorted codes of all conditions that hold; each code is listed once."""
    joined = F.concat_ws(",", *[F.when(condition, F.lit(code)) for code, condition in sorted(
        rules, key=lambda rule: rule[0])])
    return F.when(joined != "", F.split(joined, ",")).otherwise(F.array().cast("array<string>"))


def e4(value: Column) -> Column:
    """Decimal as a whole number of 1e-4 units: exact to add, compare and halve."""
    return (value.cast(AMOUNT) * 10000).cast("bigint")


def from_e4(value: Column) -> Column:
    return (value.cast("decimal(20,0)") / F.lit(10000).cast("decimal(5,0)")).cast(AMOUNT)


def month_of(date_text: Column) -> Column:
    """`yyyy-MM`, NULL for a date that does not parse."""
    return F.date_format(iso_date(date_text), "yyyy-MM")


def iso_date(date_text: Column) -> Column:
    """Calendar date of a strict `yyyy-MM-dd` text, NULL for anything else."""
    return F.when(date_text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date_text, "yyyy-MM-dd"))


def day_number(date_text: Column) -> Column:
    return F.unix_date(iso_date(date_text))


def settled(value: Column) -> Column:
    """The value behind a one-element generator.

    A filter above a projection is rewritten in terms of what the projection reads. Over a
    long chain of derived columns that copies the whole chain, many times over. A generator
    stops it: the chain is evaluated once per row and the filter tests the result.
    """
    return F.explode(F.array(value))


def apart(name: str) -> Column:
    """The column unchanged, by way of a lambda, for a step of many derived columns.

    Spark compiles neighbouring projections to one method, which the JVM does not optimise once
    it is large. A projection with a lambda is compiled by itself, in methods of limited size;
    only the lambda is evaluated node by node, so it holds a plain column.
    """
    return F.get(F.transform(F.array(name), lambda value: value), 0).alias(name)
