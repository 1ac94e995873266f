"""Work in a total order without a window over all rows: consecutive numbers, running sums, last values.

Rows are dealt to slices of the order's range, in which windows run. What happened before a slice is told by a table with a
row a slice, of which there is a bounded number, whatever the input; it is made on the driver and sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


@dataclass
class Sliced:
    """``rows`` with ``_slice``, and the slices that have rows, in order, as rows of (_slice, n, low, high)."""

    rows: DataFrame
    slices: list[Row]


def sliced(df: DataFrame, order: str, buckets: int = 2048) -> Sliced:
    """``df`` dealt to slices of ``order``, an integer column without nulls.

    The range is cut into equal widths; a slice with more than two in ``buckets`` of all rows is cut again, within its own
    range, as often as it takes (each cut narrows a range ``buckets`` times at least, so at most six times for 64 bits).
    Only rows that are equal in ``order`` can make a larger slice. No more than ``buckets`` slices are cut at a time.
    """
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return Sliced(df.withColumn("_slice", F.lit(0).cast("long")), [])
    most = max(1, 2 * ends["n"] // buckets)
    rows, todo = df.withColumn("_slice", F.lit(0).cast("long")), [Row(_slice=0, n=ends["n"], low=ends["low"], high=ends["high"])]
    first = True
    while True:
        cut, name = [], 0
        for s in todo:
            # A slice to be cut again gets as many parts as its rows ask for; the others stay one part. Names follow the order.
            parts = min(buckets, -(-4 * s["n"] // most)) if s["n"] > most and s["high"] > s["low"] else 1
            width = -(-(s["high"] - s["low"] + 1) // parts)
            cut.append((s["_slice"], name, Decimal(s["low"]), Decimal(width)))
            name += -(-(s["high"] - s["low"] + 1) // width)
        if name == len(todo) and not first:
            return Sliced(rows, todo)
        first = False
        table = F.broadcast(df.sparkSession.createDataFrame(cut, "_slice long, _name long, _low decimal(20,0), _width decimal(20,0)"))
        inside = F.floor((F.col(order).cast("decimal(20,0)") - F.col("_low")) / F.col("_width")).cast("long")
        rows = rows.join(table, "_slice").withColumn("_slice", F.col("_name") + inside).drop("_name", "_low", "_width")
        counts = rows.groupBy("_slice").agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
        todo = sorted(counts.collect(), key=lambda r: r["_slice"])


def _beside(s: Sliced, table: list[tuple], schema: str) -> DataFrame:
    return s.rows.join(F.broadcast(s.rows.sparkSession.createDataFrame(table, f"_slice long, {schema}")), "_slice")


def numbered(df: DataFrame, order: str, name: str, buckets: int = 2048) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... by ascending ``order``, an integer column. Rows that repeat a value are numbered too, in
    any order among themselves. An empty table gives an empty result."""
    s = sliced(df, order, buckets)
    before, table = 0, []
    for x in s.slices:
        table.append((x["_slice"], before))
        before += x["n"]
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    return _beside(s, table, "_before long").withColumn(name, F.col("_before") + inside).drop("_slice", "_before")


def running(df: DataFrame, order: str, value: Column, buckets: int = 2048) -> DataFrame:
    """``df`` with ``_slice``, ``_nth`` (the row's number), ``_sum`` (of ``value``, up to and with the row), ``_least`` (the least
    such sum so far, 0 at most) and ``_least_before`` (that of the row before). ``order`` has no repeats."""
    s = sliced(df, order, buckets)
    own = Window.partitionBy("_slice").orderBy(order)
    rows = s.rows.withColumn("_in", F.sum(value.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = {r["_slice"]: r for r in rows.groupBy("_slice").agg(F.min("_in").alias("low"), F.sum(value.cast("long")).alias("sum")).collect()}
    n = total = least = 0
    table = []
    for x in s.slices:
        r = found[x["_slice"]]
        table.append((x["_slice"], n, total, least))
        n, least, total = n + x["n"], min(least, total + r["low"]), total + r["sum"]
    before = df.sparkSession.createDataFrame(table, "_slice long, _n long, _total long, _floor long")
    rows = rows.withColumn("_low", F.min("_in").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_low_before", F.min("_in").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_nth", F.row_number().over(own)).join(F.broadcast(before), "_slice")
    rows = rows.withColumn("_nth", F.col("_n") + F.col("_nth")).withColumn("_sum", F.col("_total") + F.col("_in"))
    rows = rows.withColumn("_least", F.least("_floor", F.col("_total") + F.col("_low"))).withColumn("_least_before", F.least("_floor", F.col("_total") + F.col("_low_before")))
    return rows.drop("_in", "_low", "_low_before", "_n", "_total", "_floor")


def last_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, *, of: Column | None = None) -> DataFrame:
    """``rows(_slice, ...)`` with ``name``: the ``value`` of the row before in ``order`` among those with equal ``keys``; null for the first.

    A key's rows are compared inside their slice; the first of a slice takes the last value of the key's slice before, from
    a table of one row a key and slice.
    """
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    ends = rows.groupBy(*keys, "_slice").agg(F.max(F.struct(order, F.col(value).alias("v"))).alias("last"))
    ends = ends.withColumn("_carried", F.lag("last.v").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("last")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*keys, "_slice"]]
    met = rows.withColumn("_nth", F.row_number().over(inside)).withColumn(name, F.lag(value).over(inside)).alias("r").join(ends.alias("e"), on, "left")
    own = [c for c in rows.columns if c != name]
    return met.select(*(F.col(f"r.{c}") for c in own), F.when(F.col("r._nth") == 1, F.col("e._carried")).otherwise(F.col(f"r.{name}")).alias(name))
