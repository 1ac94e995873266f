"""Equi-joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import partitions


def heavy_keys(left: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``on`` and ``_shares`` of the keys that hold more than 1 / (2 * shuffle width) of the rows of ``left``.

    There are fewer than twice the shuffle width of them, whatever the input, and their shares are at most four times it
    in all; so the table may be broadcast. ``counts(on, n)`` may give the keys' numbers of rows if they are known.
    """
    per = max(1, left.count() // (2 * partitions(left.sparkSession)))
    counts = left.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts.select(*on, "n")
    return counts.where(F.col("n") > per).select(*on, F.ceil(F.col("n") / per).cast("int").alias("_shares"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, heavy: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for ``how`` "inner" or "left", with the rows of heavy keys dealt over many tasks.

    A heavy key's rows of ``left`` are dealt by a hash of all their columns, and its rows of ``right`` are repeated for each
    share; no row is lost or doubled. ``left`` is read twice or more, so it should be a written table. Null keys match
    nothing, as in any join, and aren't dealt. An empty side is joined as usual.
    """
    heavy = F.broadcast(heavy_keys(left, on, counts) if heavy is None else heavy)
    shares = F.coalesce("_shares", F.lit(1))
    dealt = left.join(heavy, on, "left").withColumn("_share", F.pmod(F.xxhash64(*left.columns), shares).cast("int")).drop("_shares")
    repeated = right.join(heavy, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return dealt.join(repeated, [*on, "_share"], how).drop("_share")
