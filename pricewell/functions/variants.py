"""Strict reads of JSON leaves held as VARIANT: a wrong JSON type is an error, never a cast.

A leaf is NULL when its path is missing or its parent is no object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.times import parse_instant

VOID = "VOID"
LAST_MILLIS = 253_402_300_799_999  # the end of year 9999


def has_type(leaf: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(leaf).isin(*kinds), F.lit(False))


def is_string(leaf: Column) -> Column:
    return has_type(leaf, "STRING")


def is_number(leaf: Column) -> Column:
    kind = F.schema_of_variant(leaf)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))


def is_optional(leaf: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(leaf), F.lit(VOID)).isin(VOID, kind)


def all_strings(leaves: Column) -> Column:
    return F.coalesce(F.forall(leaves, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))


def value(leaf: Column, kind: str) -> Column:
    return F.try_variant_get(leaf, "$", kind)


def instant(leaf: Column) -> Column:
    """ISO text, or a number of epoch milliseconds; NULL otherwise."""
    millis = value(leaf, "double").try_cast("bigint")
    moment = F.when(millis.between(-LAST_MILLIS, LAST_MILLIS), F.timestamp_millis(millis))
    return F.when(is_string(leaf), parse_instant(value(leaf, "string"))).when(is_number(leaf), moment)
