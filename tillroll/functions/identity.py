"""The three product keys; each has its own use and they are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.columns import not_blank
from tillroll.functions.names import normalize

#: The columns that identities and keys are made of.
SPELLING = ["name", "normalized_name", "canonical_name"]


def identity(name: str = "name", canonical: str = "canonical_name") -> Column:
    """User-facing product: the manual name, untrimmed, else the name on the receipt."""
    return F.when(not_blank(F.col(canonical)), F.col(canonical)).otherwise(F.col(name))


def trimmed_identity(name: str = "name", canonical: str = "canonical_name") -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(canonical)), F.lit("")), F.col(name))


def product_key(name: str = "name", normalized: str = "normalized_name",
                canonical: str = "canonical_name") -> Column:
    """Key of category rules and of conflict groups."""
    return F.when(not_blank(F.col(canonical)), normalize(F.col(canonical))).when(
        not_blank(F.col(normalized)), F.trim(F.col(normalized))).otherwise(normalize(F.col(name)))
