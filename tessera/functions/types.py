"""The registry of typed codecs: logical name, Spark type and fixed size in bytes (-1: variable)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bits import big_endian


class Codec(NamedTuple):
    name: str
    spark: str
    size: int


#: The codecs' names and sizes.
CODECS = {
    c.name: c
    for c in (
        Codec("boolean", "boolean", 1),
        Codec("byte", "tinyint", 1),
        Codec("char", "int", 2),
        Codec("short", "smallint", 2),
        Codec("integer", "int", 4),
        Codec("integer_packed", "int", -1),
        Codec("integer_delta", "int", -1),
        Codec("long", "bigint", 8),
        Codec("long_packed", "bigint", -1),
        Codec("long_delta", "bigint", -1),
        Codec("recid", "bigint", -1),
        Codec("float", "float", 4),
        Codec("double", "double", 8),
        Codec("date", "timestamp", 8),
        Codec("string", "string", -1),
        Codec("string_ascii", "string", -1),
        Codec("string_intern", "string", -1),
        Codec("string_nosize", "string", -1),
        Codec("string_orig_hash", "string", -1),
        Codec("string_delta", "string", -1),
        Codec("string_delta2", "string", -1),
        Codec("byte_array", "binary", -1),
        Codec("byte_array_nosize", "binary", -1),
        Codec("byte_array_delta", "binary", -1),
        Codec("byte_array_delta2", "binary", -1),
        Codec("class", "string", -1),
        Codec("big_integer", "decimal(38,0)", -1),
        Codec("java", "binary", -1),
        Codec("char_array", "array<int>", -1),
        Codec("int_array", "array<int>", -1),
        Codec("long_array", "array<bigint>", -1),
        Codec("recid_array", "array<bigint>", -1),
        Codec("short_array", "array<smallint>", -1),
        Codec("float_array", "array<float>", -1),
        Codec("double_array", "array<double>", -1),
        Codec("uuid", "struct<msb:bigint,lsb:bigint>", 16),
        Codec("big_decimal", "struct<unscaled:binary,scale:int>", -1),
    )
}


def codec(name: str) -> Codec:
    """A codec by its name; an error for an unknown one. ``array(codec)`` and tuples are ARRAY and STRUCT of their parts."""
    return CODECS[name]


def codec_for(spark_type: str) -> Codec | None:
    """The first codec that stores a Spark type, or None."""
    return next((c for c in CODECS.values() if c.spark == spark_type.lower()), None)


def serialize(x: Column, name: str) -> Column:
    """A value's bytes by its codec: integers, dates (milliseconds) and recids big-endian, booleans as 0 or 1, text as UTF-8, uuids as
    their halves. Null gives null; codecs without a byte form here are an error."""
    if name in ("string", "string_ascii", "string_intern", "string_nosize", "string_orig_hash"):
        return F.encode(x, "UTF-8")
    if name in ("byte_array", "byte_array_nosize"):
        return x
    if name == "boolean":
        return F.unhex(F.when(x, "01").when(~x, "00"))
    if name == "uuid":
        return F.unhex(F.concat(big_endian(x["msb"], 8), big_endian(x["lsb"], 8)))
    if name == "date":
        return F.unhex(big_endian(F.unix_millis(x), 8))
    if name in ("byte", "char", "short", "integer", "long", "recid"):
        return F.unhex(big_endian(x, 8 if name == "recid" else codec(name).size))
    raise ValueError(f"no byte form for {name}")


def binary_equal(a: Column, b: Column, name: str) -> Column:
    """Whether two values have the same bytes; null equals null."""
    return serialize(a, name).eqNullSafe(serialize(b, name))
