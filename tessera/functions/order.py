"""Keys that sort or compare like the typed codecs where Spark's own order differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_key(s: Column) -> Column:
    """Strings by UTF-16 code units rather than by code points."""
    return F.encode(s, "UTF-16BE")


def null_last_key(a: Column) -> Column:
    """Arrays whose null elements are greatest rather than least."""
    return F.transform(a, lambda x: F.struct(x.isNull().alias("n"), x.alias("x")))


def uuid_key(msb: Column, lsb: Column) -> Column:
    """UUIDs by their signed halves, not by their text."""
    return F.struct(msb.cast("long").alias("msb"), lsb.cast("long").alias("lsb"))


def float_key(x: Column) -> Column:
    """Doubles with -0.0 below 0.0 and NaN greatest."""
    negative_zero = (x == 0) & (x.cast("string") == "-0.0")
    return F.struct(x.alias("x"), F.when(negative_zero, 0).otherwise(1).alias("z"))


def decimal_key(unscaled: Column, scale: Column) -> Column:
    """Unbounded decimals for equality: two are equal only with equal scales."""
    return F.struct(unscaled.alias("unscaled"), scale.alias("scale"))
