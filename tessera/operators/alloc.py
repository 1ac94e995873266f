"""Allocation of recids for puts, reusing those that deletes freed: the last freed one first, or the first one.

A batch's order is global, but what a row does follows from two running numbers, the sum of adds less takes and its least
value so far. Both compose over slices of the order, so no task sees more than a slice. A batch's deletes name recids that
were live before it, and its ``seq`` has neither nulls nor repeats; payloads join back afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.numbering import last_before, running


def _balanced(log: DataFrame, adds: str) -> DataFrame:
    """``log`` with ``free``, what is available after each row, ``fresh``, whether it takes where nothing was, and ``fresh_so_far``."""
    log = running(log, "seq", F.when(F.col("op") == adds, 1).otherwise(-1))
    # A take from nothing sinks the sum to a new least value and leaves nothing behind.
    return log.select("*", (F.col("_sum") - F.col("_least")).alias("free"), (F.col("_least") < F.col("_least_before")).alias("fresh"), (-F.col("_least")).alias("fresh_so_far"))


def _last_added(log: DataFrame, adds: str, value: str, name: str) -> DataFrame:
    """``log`` with, for rows that take, the value of the last add that is still there: the one that filled the level which the row empties."""
    level = F.when(F.col("op") == adds, F.col("free")).otherwise(F.col("free") + 1)
    return last_before(log.withColumn("level", level), ["fresh", "level"], "seq", value, name)


def allocate(log: DataFrame, max_recid: int, *, first_freed: bool = False) -> DataFrame:
    """``seq, op, recid`` of ``log(seq, op, recid)`` with the recids of its ops "put" filled in; "delete" rows have theirs.

    A put takes a freed recid if there is one (the last freed, or with ``first_freed`` the first), else the next above
    ``max_recid``. An empty log gives an empty result.
    """
    log = _balanced(log.select("seq", "op", "recid"), "delete")
    deleted = F.col("op") == "delete"
    if first_freed:
        # The n-th put that reuses takes the n-th delete's recid; the row's number and sum tell how many there were of each.
        adds, takes = F.floor((F.col("_nth") + F.col("_sum")) / 2), F.floor((F.col("_nth") - F.col("_sum")) / 2)
        log = log.withColumn("nth", F.when(deleted, adds).otherwise(takes - F.col("fresh_so_far")))
        log = log.join(log.where(deleted).select("nth", F.col("recid").alias("reused")), "nth", "left")
    else:
        log = _last_added(log, "delete", "recid", "reused")
    recid = F.when(deleted, F.col("recid")).when(F.col("fresh"), F.lit(max_recid) + F.col("fresh_so_far")).otherwise(F.col("reused"))
    return log.select("seq", "op", recid.cast("long").alias("recid"))


def stack_pops(log: DataFrame) -> DataFrame:
    """``seq, op, value`` of ``log(seq, op, value)`` with ops "push" and "pop": what a last-in-first-out stack pops, 0 when empty."""
    log = _last_added(_balanced(log.select("seq", "op", "value"), "push"), "push", "value", "popped")
    popped = F.when(F.col("op") == "push", F.col("value")).when(F.col("fresh"), F.lit(0)).otherwise(F.col("popped"))
    return log.select("seq", "op", popped.cast("long").alias("value"))
