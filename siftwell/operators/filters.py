"""Metadata filters: a conjunction of equalities and memberships."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fields of a chunk that a filter may name; every other key is metadata
FIELDS = ("id", "doc_id", "text", "index", "char_start", "char_end", "page_start", "page_end")
#: fields that no chunk lacks: they are compared as they are, in the scan if the store is Parquet
ALWAYS = ("id", "doc_id", "text", "index")
#: longer memberships become a semi join
INLINE_VALUES = 1000


def _resolve(df: DataFrame, key: str) -> Column:
    """The column, or where it is absent or null the metadata entry, as text."""
    found = []
    if key in df.columns and key != "metadata":
        found.append(F.col(key).cast("string"))
    if "metadata" in df.columns:
        found.append(F.try_element_at("metadata", F.lit(key)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _text(value: Any) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    return None if value is None else str(value)


def _typed(df: DataFrame, key: str, values: list) -> Column | None:
    """The column itself, where it and all values are numbers, or all are text."""
    if key not in df.columns or key == "metadata":
        return None
    kind = df.schema[key].dataType
    numbers = isinstance(kind, T.NumericType) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    return F.col(key) if numbers or (isinstance(kind, T.StringType) and all(isinstance(v, str) for v in values)) else None


def predicate(df: DataFrame, filters: Mapping[str, Any] | None) -> Column:
    """True for rows that meet every entry; an expected None meets a missing value.

    Numbers are compared as numbers, so 1 meets 1.0; metadata is text.
    """
    parts = []
    for key, expected in (filters or {}).items():
        several = isinstance(expected, (list, tuple, set, frozenset))
        known = [x for x in (expected if several else [expected]) if x is not None]
        typed = _typed(df, key, known) if known else None
        value = _resolve(df, key)
        hit = F.coalesce(value.isin([_text(x) for x in known]), F.lit(False)) if known else F.lit(False)
        if typed is not None:
            own = typed.isin(known) if len(known) > 1 else typed == known[0]
            hit = own if key in ALWAYS else F.coalesce(own, F.lit(False)) | (typed.isNull() & hit)
        parts.append(hit | value.isNull() if len(known) < (len(expected) if several else 1) else hit)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def matching(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """df filtered; memberships of many values are joined and not listed in the plan."""
    short = {}
    for key, expected in (filters or {}).items():
        if isinstance(expected, (list, tuple, set, frozenset)) and len(expected) > INLINE_VALUES and None not in expected:
            values = df.sparkSession.createDataFrame([(_text(x),) for x in set(expected)], "__value string")
            df = df.withColumn("__value", _resolve(df, key)).join(values, "__value", "left_semi").drop("__value")
        else:
            short[key] = expected
    return df.where(predicate(df, short)) if short else df
