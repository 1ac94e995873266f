"""A record store over immutable snapshots: every operation is a set operation that gives a new store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bits import size_class
from tessera.operators.fold import apply_ops_streamed
from tessera.operators.state import IS_PREALLOC, LIVE, MISMATCH, NOT_FOUND, NOT_PREALLOC, NULL_VALUE, OK, PREALLOC, TOO_LARGE, VOID, RecordError, record_size, verify
from tessera.plans.numbering import numbered


@dataclass
class RecordStore:
    """STATE(recid, state, payload) and the highest recid ever allocated, which survives deletes.

    ``freed`` holds the recids that deletes gave back, the smallest of which the next puts take; None if nothing is known to be
    free. Values are not null and not larger than ``max_record_size`` bytes: writes of others are refused with a status.
    ``size_limit`` bounds the bytes of all records and is checked when the store is committed.
    """

    state: DataFrame
    max_recid: int | None = None
    max_record_size: int = (1 << 31) - 1
    on_close: list[Callable[[], None]] = field(default_factory=list)
    freed: DataFrame | None = None
    size_limit: int | None = None
    #: Where ``max_recid`` is None: what the highest recid is at least.
    floor: int = 0

    # reading

    def get_all(self) -> DataFrame:
        """Live records by ascending recid."""
        return self.state.where(F.col("state") == LIVE).select("recid", "payload").orderBy("recid")

    def get(self, recids: DataFrame) -> DataFrame:
        """``recid, status, payload`` of every row of ``recids(recid)``."""
        found = recids.join(self.state, "recid", "left")
        status = F.when(F.col("state") == LIVE, OK).when(F.col("state") == PREALLOC, IS_PREALLOC).otherwise(NOT_FOUND)
        return found.select("recid", status.alias("status"), "payload")

    def get_one(self, recid: int):  # noqa: ANN201
        """One payload; raises for a missing or preallocated record."""
        row = self.state.where((F.col("recid") == recid) & (F.lit(recid) > 0)).first()
        if row is None or row["state"] != LIVE:
            raise RecordError(NOT_FOUND if row is None else IS_PREALLOC, recid)
        return row["payload"]

    def is_empty(self) -> bool:
        return self.state.isEmpty()

    def highest(self) -> int:
        """The highest recid that was ever allocated."""
        return self.max_recid if self.max_recid is not None else max(self.floor, self.state.agg(F.max("recid")).first()[0] or 0)

    def free_recids(self) -> DataFrame:
        """Allocated recids that are void again."""
        spark = self.state.sparkSession
        return spark.range(1, self.highest() + 1).select(F.col("id").alias("recid")).join(self.state, "recid", "left_anti")

    def raw(self) -> DataFrame:
        """``recid, state, payload`` of every recid ever allocated, void ones too."""
        every = self.state.sparkSession.range(1, self.highest() + 1).select(F.col("id").alias("recid"))
        return every.join(self.state, "recid", "left").select("recid", F.coalesce("state", F.lit(VOID)).alias("state"), "payload")

    def _size(self, payload: Column) -> Column:
        return record_size(payload, self.state.schema["payload"].dataType).cast("long")

    def statistics(self, size: Column | None = None) -> DataFrame:
        """``size_class, records, bytes`` of live records, sizes in classes of 16 bytes; the payload's own size, or ``size``."""
        n = size if size is not None else self._size(F.col("payload"))
        return self.state.where(F.col("state") == LIVE).select(size_class(n).alias("size_class")).groupBy("size_class").agg(F.count("*").alias("records"), F.sum("size_class").alias("bytes"))

    def summary(self) -> DataFrame:
        """One row: live and preallocated records, free recids, the highest recid, bytes of payloads and of their size classes, and the limits."""
        live = F.when(F.col("state") == LIVE, self._size(F.col("payload")))
        top = self.highest()
        found = self.state.agg(
            F.count(live).alias("live"),
            F.count(F.when(F.col("state") == PREALLOC, 1)).alias("preallocated"),
            (F.lit(top) - F.count("*")).alias("free_recids"),
            F.coalesce(F.sum(live), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(size_class(live)).cast("long"), F.lit(0)).alias("class_bytes"),
        )
        return found.select("*", F.lit(top).cast("long").alias("max_recid"), F.lit(self.max_record_size).cast("long").alias("max_record_size"), F.lit(self.size_limit).cast("long").alias("size_limit"))

    def verify(self) -> DataFrame:
        return verify(self.state)

    # writing

    def _next(self, state: DataFrame, highest: int | None = None, freed: DataFrame | None = None) -> RecordStore:
        return replace(self, state=state, max_recid=highest if highest is not None else self.max_recid, freed=freed if freed is not None else self.freed)

    def _refused(self, value: Column) -> Column:
        """Why a value can't be stored, or null."""
        return F.when(value.isNull(), NULL_VALUE).when(self._size(value) > self.max_record_size, TOO_LARGE)

    def put(self, rows: DataFrame, order: str, payload: str) -> tuple[RecordStore, DataFrame]:
        """New records with recids in ascending ``order``, freed ones first, then fresh ones; also ``order, recid, status`` of each.

        A refused value gets no recid. Rows that repeat a value of ``order`` each get one.
        """
        return self._begin(rows, order, F.col(payload), LIVE)

    def preallocate(self, rows: DataFrame, order: str) -> tuple[RecordStore, DataFrame]:
        """Recids without a value, one for each row; also ``order, recid, status``."""
        return self._begin(rows, order, F.lit(None), PREALLOC)

    def _begin(self, rows: DataFrame, order: str, payload: Column, state: int) -> tuple[RecordStore, DataFrame]:
        top, kind = self.highest(), self.state.schema["payload"].dataType
        rows = rows.select(order, payload.cast(kind).alias("payload"))
        status = F.coalesce(self._refused(F.col("payload")), F.lit(OK)) if state == LIVE else F.lit(OK)
        rows = rows.withColumn("status", status)
        good = rows.where(F.col("status") == OK)
        n = good.count()
        placed, reusable = numbered(good, order, "_n"), 0
        if self.freed is not None:
            free = numbered(self.freed.distinct(), "recid", "_n").withColumnRenamed("recid", "_free")
            reusable = min(free.count(), n)
            placed = placed.join(free, "_n", "left").withColumn("recid", F.coalesce("_free", F.col("_n") + (top - reusable)))
        else:
            placed = placed.withColumn("recid", F.col("_n") + top)
        new = placed.select("recid", F.lit(state).alias("state"), "payload")
        after = self._next(self.state.unionByName(new), top + n - reusable, free.where(F.col("_n") > n).select(F.col("_free").alias("recid")) if self.freed is not None else None)
        given = placed.select(order, "recid", "status")
        return after, given.unionByName(rows.where(F.col("status") != OK).select(order, F.lit(None).cast("long").alias("recid"), "status"))

    def update(self, rows: DataFrame, *, only_if: Column | None = None, order: Column | None = None) -> tuple[RecordStore, DataFrame]:
        """Replace live payloads by those of ``rows(recid, new)``; also ``recid, status, old, new``.

        ``only_if`` compares (columns ``payload`` and those of ``rows``): a row that fails it is a mismatch. Rows that repeat a
        recid are each reported against the payload before; of those that are OK the one with the greatest ``order`` (else the
        greatest value) is what stays.
        """
        rows = rows.drop("state", "payload")
        value = F.col("new").cast(self.state.schema["payload"].dataType)
        met = F.when(F.lit(True) if only_if is None else only_if, OK).otherwise(MISMATCH)
        status = F.coalesce(F.when(F.col("state") == LIVE, self._refused(value)), F.when(F.col("state") == LIVE, met).when(F.col("state") == PREALLOC, IS_PREALLOC).otherwise(NOT_FOUND))
        result = rows.join(self.state, "recid", "left").select("recid", status.alias("status"), F.col("payload").alias("old"), "new")
        rank = F.col("new") if order is None else order
        win = F.max(F.when(status == OK, F.struct(rank.alias("rank"), value.alias("new"))))
        state = self.state.join(rows, "recid", "left").groupBy("recid").agg(F.first("state").alias("state"), F.first("payload").alias("payload"), win.alias("win"))
        return self._next(state.select("recid", "state", F.when(F.col("win").isNotNull(), F.col("win.new")).otherwise(F.col("payload")).alias("payload"))), result

    def compare_and_update(self, rows: DataFrame, *, order: Column | None = None) -> tuple[RecordStore, DataFrame]:
        """``update`` where the payload equals the row's ``expected``."""
        return self.update(rows, only_if=F.col("payload").eqNullSafe(F.col("expected")), order=order)

    def update_atomic(self, where: Column, transform: Callable[[Column], Column]) -> tuple[RecordStore, DataFrame]:
        """Live payloads changed by an expression; also ``recid, status, old, new`` of every record that ``where`` holds for.

        A result that is null or too large is refused and leaves its record as it was.
        """
        hit = (F.col("state") == LIVE) & F.coalesce(where, F.lit(False))
        value = transform(F.col("payload")).cast(self.state.schema["payload"].dataType)
        both = self.state.select("recid", "state", F.col("payload").alias("old"), F.when(hit, value).alias("new"), hit.alias("hit"))
        both = both.withColumn("status", F.when(F.col("hit"), F.coalesce(self._refused(F.col("new")), F.lit(OK))))
        after = F.when(F.col("status") == OK, F.col("new")).otherwise(F.col("old"))
        return self._next(both.select("recid", "state", after.alias("payload"))), both.where("hit").select("recid", "status", "old", after.alias("new"))

    def preallocate_put(self, rows: DataFrame) -> tuple[RecordStore, DataFrame]:
        """Values ``rows(recid, new)`` for preallocated records; also ``recid, status``.

        Of rows that repeat a recid the one with the greatest value is put; the others find it done (``NOT_PREALLOC``).
        """
        value = F.col("new").cast(self.state.schema["payload"].dataType)
        good = rows.select("recid", value.alias("new")).where(self._refused(value).isNull())
        chosen = good.groupBy("recid").agg(F.max("new").alias("_new"))
        nth = F.row_number().over(Window.partitionBy("recid").orderBy(F.col("refused").isNotNull(), F.col("new").desc()))
        asked = rows.select("recid", value.alias("new")).withColumn("refused", self._refused(F.col("new"))).withColumn("nth", nth)
        status = F.when(F.col("state") == PREALLOC, F.coalesce("refused", F.when(F.col("nth") == 1, OK).otherwise(NOT_PREALLOC))).otherwise(NOT_PREALLOC)
        result = asked.join(self.state.select("recid", "state"), "recid", "left").select("recid", status.alias("status"))
        fills = (F.col("state") == PREALLOC) & F.col("_new").isNotNull()
        state = self.state.join(chosen, "recid", "left").select("recid", F.when(fills, LIVE).otherwise(F.col("state")).alias("state"), F.when(fills, F.col("_new")).otherwise(F.col("payload")).alias("payload"))
        return self._next(state), result

    def delete(self, rows: DataFrame, *, only_if: Column | None = None) -> tuple[RecordStore, DataFrame]:
        """Live records of ``rows(recid)`` become void and their recids free; also ``recid, status, old``.

        Preallocated records can't be deleted. Rows that repeat a recid are each reported against the payload before.
        """
        rows = rows.drop("state", "payload")
        met = F.lit(True) if only_if is None else only_if
        status = F.when(F.col("state") == LIVE, F.when(met, OK).otherwise(MISMATCH)).when(F.col("state") == PREALLOC, IS_PREALLOC).otherwise(NOT_FOUND)
        result = rows.join(self.state, "recid", "left").select("recid", status.alias("status"), F.col("payload").alias("old"))
        gone = result.where(F.col("status") == OK).select("recid").distinct()
        state = self.state.join(rows.withColumnRenamed("recid", "_recid"), (F.col("recid") == F.col("_recid")) & (F.col("state") == LIVE) & met, "left_anti")
        return self._next(state, self.highest(), gone if self.freed is None else self.freed.unionByName(gone)), result

    def compare_and_delete(self, rows: DataFrame) -> tuple[RecordStore, DataFrame]:
        """``delete`` where the payload equals the row's ``expected``."""
        return self.delete(rows, only_if=F.col("payload").eqNullSafe(F.col("expected")))

    def apply(self, ops: DataFrame) -> tuple[RecordStore, DataFrame]:
        """A whole log of operations (see ``fold``); also a result row for each. Recids that end void are free."""
        done, top = apply_ops_streamed(self.state, ops, max_record_size=self.max_record_size), self.highest()
        ends = done.where("op = 'end'").select("recid", F.col("status").cast("int").alias("state"), F.col("new").alias("payload"))
        live, void = ends.where(F.col("state") != VOID), ends.where((F.col("state") == VOID) & (F.col("recid") > 0) & (F.col("recid") <= top)).select("recid")
        freed = void if self.freed is None else self.freed.unionByName(void).distinct().join(live, "recid", "left_anti")
        return replace(self, state=live, max_recid=None, floor=top, freed=freed), done.where("op <> 'end'")

    def compact(self) -> RecordStore:
        """Sorted by recid in ranges, so that point reads prune files; void rows are gone already."""
        return self._next(self.state.repartitionByRange("recid").sortWithinPartitions("recid"))

    def close(self) -> None:
        for listener in self.on_close:
            listener()
