"""Literals of the graph script, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In this order: the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def text(value: Column) -> Column:
    for raw, escaped in ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit("'"), value, F.lit("'"))


def number(value: Column, kind: str) -> Column:
    if kind == "float":
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null")).otherwise(value.cast("string"))
    return value.cast("string")


def boolean(value: Column) -> Column:
    return F.when(value, F.lit("true")).otherwise(F.lit("false"))


def listing(value: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(value, text), ", "), F.lit("]"))


def literal(value: Column, kind: str) -> Column:
    """A value of one of the catalog's property types; null is ``null``."""
    out = {"string": text, "boolean": boolean, "string[]": listing}.get(kind, lambda v: number(v, kind))(value)
    return F.coalesce(out, F.lit("null"))


def mapping(pairs: Column) -> Column:
    """An array of (key, literal) as a map literal."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), p["literal"])), ", "), F.lit("}"))
