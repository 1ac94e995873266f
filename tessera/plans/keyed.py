"""Keyed tables (k, v): what hash-map containers do, as joins on the key.

Keys of ``have`` are unique, as every function leaves them. Of rows of ``new`` that repeat a key the greatest one counts. Null
keys match nothing and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _once(new: DataFrame) -> DataFrame:
    others = [c for c in new.columns if c != "k"]
    return new.groupBy("k").agg(F.max(F.struct(*others)).alias("_r")).select("k", *(F.col(f"_r.{c}").alias(c) for c in others))


def _beside(have: DataFrame, new: DataFrame, how: str) -> DataFrame:
    """Columns k, old, and those of ``new`` with its value as ``new``; ``hit`` where it has the key."""
    return have.select("k", F.col("v").alias("old")).join(_once(new).withColumnRenamed("v", "new").withColumn("hit", F.lit(True)), "k", how)


def contains_key(have: DataFrame, keys: DataFrame) -> DataFrame:
    """``k, found`` of every row of ``keys(k)``."""
    return keys.select("k").join(have.select("k", F.lit(True).alias("_hit")), "k", "left").select("k", F.col("_hit").isNotNull().alias("found"))


def contains_value(have: DataFrame, value: Column) -> bool:
    """Whether any key has the value."""
    return not have.where(F.col("v").eqNullSafe(value)).isEmpty()


def put(have: DataFrame, new: DataFrame) -> DataFrame:
    return _beside(have, new, "full").select("k", F.when(F.col("hit"), F.col("new")).otherwise(F.col("old")).alias("v"))


def put_if_absent(have: DataFrame, new: DataFrame) -> DataFrame:
    return have.unionByName(_once(new).select("k", "v").join(have, "k", "left_anti"))


def replace(have: DataFrame, new: DataFrame) -> DataFrame:
    """New values for keys that are there."""
    return _beside(have, new, "left").select("k", F.when(F.col("hit"), F.col("new")).otherwise(F.col("old")).alias("v"))


def replace_if(have: DataFrame, new: DataFrame) -> DataFrame:
    """``replace`` where the value equals ``new``'s ``expected``."""
    swap = F.col("hit") & F.col("old").eqNullSafe(F.col("expected"))
    return _beside(have, new, "left").select("k", F.when(swap, F.col("new")).otherwise(F.col("old")).alias("v"))


def remove(have: DataFrame, keys: DataFrame) -> DataFrame:
    return have.join(keys.select("k"), "k", "left_anti")


def remove_if(have: DataFrame, keys: DataFrame) -> DataFrame:
    """``remove`` where the value equals ``expected``."""
    asked = keys.select(F.col("k").alias("_k"), "expected")
    return have.join(asked, (F.col("k") == F.col("_k")) & F.col("v").eqNullSafe(F.col("expected")), "left_anti")
