"""Atomic records as running sums, last values and folds over OPS(seq, name, ...).

A name may have a large share of all operations: sums and last values are made inside slices of ``seq`` and carried from
slice to slice by a table of one row a name and slice; the fold of compare-and-set keeps one value at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bits import wrap32, wrap64
from tessera.operators.fold import LIVE, run_ops
from tessera.plans.numbering import last_before, sliced

#: Initial values by type; a "var" has none.
INITIAL = {"string": "", "long": 0, "int": 0, "boolean": False}


def running_add(ops: DataFrame, initial: int = 0, *, bits: int = 64) -> DataFrame:
    """``ops(seq, name, delta)`` with ``get_and_add`` and ``add_and_get``, which wrap around like the type of so many bits.

    ``seq`` is an integer without repeats in a name; a null delta adds nothing. Sums are exact up to 38 digits before they
    wrap. An empty table gives an empty result.
    """
    delta = F.coalesce(F.col("delta"), F.lit(0)).cast("decimal(38,0)")
    rows = sliced(ops, "seq").rows
    inside = Window.partitionBy("name", "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(F.col("name").alias("_name"), F.col("_slice").alias("_at")).agg(F.sum(delta).alias("_own"))
    earlier = Window.partitionBy("_name").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_name", "_at", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).cast("decimal(38,0)").alias("_before"))
    met = rows.withColumn("_in", F.sum(delta).over(inside)).join(sums, F.col("name").eqNullSafe(F.col("_name")) & (F.col("_slice") == F.col("_at")))
    total = F.col("_before") + F.col("_in") + F.lit(initial)
    wrap = (lambda x: wrap64(x)) if bits == 64 else (lambda x: wrap32(wrap64(x)))
    return met.select(*ops.columns, wrap(total - delta).alias("get_and_add"), wrap(total).alias("add_and_get"))


def get_and_set(ops: DataFrame, initial) -> DataFrame:  # noqa: ANN001
    """``ops(seq, name, value)`` with ``old``: what each set replaced. A value may be null, and so may what replaced it be."""
    rows = sliced(ops.withColumn("_boxed", F.struct("value")), "seq").rows
    found = last_before(rows, ["name"], "seq", "_boxed", "_old")
    old = F.when(F.col("_old").isNull(), F.lit(initial)).otherwise(F.col("_old.value"))
    return found.select(*ops.columns, old.alias("old"))


def numeric_views(value: Column) -> dict[str, Column]:
    """A number as the other types that its record can be read as: narrowed and widened as casts do, and as text."""
    wide = value.cast("long")
    narrow = lambda n: F.pmod(wide + (1 << (n - 1)), F.lit(1 << n)) - (1 << (n - 1))
    return {
        "byte_value": narrow(8).cast("byte"),
        "short_value": narrow(16).cast("short"),
        "int_value": wrap32(wide),
        "long_value": wide,
        "float_value": value.cast("float"),
        "double_value": value.cast("double"),
        "string_value": value.cast("string"),
    }


def compare_and_set(ops: DataFrame, initial) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """``name, value`` at the end, and ``seq, name, swapped, value`` after each of ``ops(seq, name, expected, value)``.

    Null equals null and NaN equals NaN. Of equal ``seq`` in a name the smaller values come first.
    """
    kind = ops.schema["value"].dataType
    state = ops.select("name").distinct().select(F.col("name").alias("key"), F.lit(LIVE).alias("state"), F.lit(initial).cast(kind).alias("payload"))
    todo = ops.select(F.col("name").alias("key"), "seq", F.lit("cas").alias("op"), F.col("value").alias("arg"), "expected")
    done = run_ops(state, todo, nulls=True)
    after = done.where("op = 'cas'").select("seq", F.col("key").alias("name"), (F.col("status") == "OK").alias("swapped"), F.col("new").alias("value"))
    return done.where("op = 'end'").select(F.col("key").alias("name"), F.col("new").alias("value")), after
