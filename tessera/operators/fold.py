"""Batches of record operations, OPS(seq, recid, op, arg, expected), folded over STATE.

What an operation does depends on what the earlier ones on its recid left, so each recid's operations take effect in the
order of ``seq``; recids are independent. Rows are dealt by recid and sorted by seq inside each task, which then goes through
them once and keeps one record at a time: time is linear in the log, and memory does not grow with a recid's share of it.
Payloads are never turned into Python objects: the pass works on codes of equal values and on places in Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.state import IS_PREALLOC, LIVE, MISMATCH, NOT_FOUND, NOT_PREALLOC, NULL_VALUE, OCCUPIED, OK, PREALLOC, TOO_LARGE, VOID, record_size

#: The operations: those on live records, and those that begin a life.
ON_LIVE = ("get", "update", "cas", "cad", "delete")
BEGINS = ("put", "preallocate", "preallocate_put")
_WRITES = ("update", "cas", "put", "preallocate_put")
_STATUS = (OK, NOT_FOUND, IS_PREALLOC, NOT_PREALLOC, MISMATCH, OCCUPIED, NULL_VALUE, TOO_LARGE)
_OPS = ("begin", "end", *ON_LIVE, *BEGINS)


def _codes(values: pa.Array) -> list[int]:
    """Equal numbers for equal values: null equals null, NaN equals NaN, and the zeros are one."""
    if pa.types.is_null(values.type):
        return [-1] * len(values)
    if pa.types.is_floating(values.type):
        values = pc.add(values, pa.scalar(0, values.type))
    if pa.types.is_nested(values.type):
        seen: dict[str, int] = {}
        return [-1 if v is None else seen.setdefault(repr(v), len(seen)) for v in values.to_pylist()]
    found = pc.dictionary_encode(values)
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return pc.fill_null(found.indices, -1).to_pylist()


def run_ops(state: DataFrame, ops: DataFrame, *, nulls: bool = False, max_record_size: int | None = None) -> DataFrame:
    """``seq, key, op, status, old, new`` of every row of ``ops(key, seq, op, arg, expected)`` over ``state(key, state, payload)``.

    After a key's rows comes one with op "end": its state as status, its payload as new. A write of null is refused
    (``NULL_VALUE``) unless ``nulls``, and so is one of more than ``max_record_size`` bytes (``TOO_LARGE``), whatever the
    record's state. An unknown op is an error. Rows with equal key and seq take effect by op, then arg, then expected.
    """
    kind = state.schema["payload"].dataType
    null = F.lit(None).cast(kind)
    key = ops.schema["key"].dataType
    large = F.lit(False) if max_record_size is None else F.coalesce(record_size(F.col("arg").cast(kind), kind) > max_record_size, F.lit(False))
    part = lambda df, phase, seq, op, payload, expected, life, big: df.select(F.col("key").cast(key).alias("key"), F.lit(phase).alias("phase"), seq.cast("long").alias("seq"), op.alias("op"), payload.alias("payload"), expected.alias("expected"), life.cast("int").alias("state"), big.alias("large"))
    no, zero = F.lit(False), F.lit(0)
    begin = part(state, 0, zero, F.lit("begin"), F.col("payload"), null, F.col("state"), no)
    todo = part(ops, 1, F.col("seq"), F.col("op"), F.col("arg").cast(kind), F.col("expected").cast(kind), zero, large)
    ends = part(state.select("key").unionByName(ops.select("key")).distinct(), 2, zero, F.lit("end"), null, null, zero, no)
    rows = begin.unionByName(todo).unionByName(ends).repartition("key").sortWithinPartitions("key", "phase", "seq", "op", "payload", "expected")
    schema = f"seq long, key {key.simpleString()}, op string, status string, old {kind.simpleString()}, new {kind.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        life, held = VOID, None  # the record that the last batch ended in: its state, and its payload as an array of one
        names = pa.array(_OPS)
        to = {name: i for i, name in enumerate(_STATUS)}
        for batch in batches:
            n = batch.num_rows
            kinds = pc.index_in(batch.column("op"), names)
            if kinds.null_count:
                raise ValueError(f"unknown op {batch.column('op')[pc.index(pc.is_null(kinds), True).as_py()].as_py()!r}")
            payload = batch.column("payload")
            pool = pa.concat_arrays([held if held is not None else pa.nulls(1, payload.type), payload, pa.nulls(1, payload.type)])
            codes = _codes(pa.concat_arrays([pool, batch.column("expected").cast(payload.type)]))
            nothing, at = n + 1, 0  # places in the pool: 0 is what was held, n + 1 is null
            status, old, new = [0] * n, [nothing] * n, [nothing] * n
            lives, bigs = batch.column("state").to_pylist(), batch.column("large").to_pylist()
            for i, op in enumerate(kinds.to_pylist()):
                op = _OPS[op]
                old[i] = at
                if op == "begin":
                    life, at = lives[i], i + 1
                elif op == "end":
                    status[i], new[i] = -1 - life, at
                    life, at = VOID, nothing
                    continue
                elif op in _WRITES and codes[i + 1] < 0 and not nulls:
                    status[i] = to[NULL_VALUE]
                elif op in _WRITES and bigs[i]:
                    status[i] = to[TOO_LARGE]
                elif op == "preallocate_put":
                    if life == PREALLOC:
                        life, at = LIVE, i + 1
                    else:
                        status[i] = to[NOT_PREALLOC]
                elif op == "put":
                    if life == VOID:
                        life, at = LIVE, i + 1
                    else:
                        status[i] = to[OCCUPIED]
                elif op == "preallocate":
                    if life == VOID:
                        life = PREALLOC
                    else:
                        status[i] = to[OCCUPIED]
                elif life != LIVE:
                    status[i] = to[NOT_FOUND if life == VOID else IS_PREALLOC]
                elif op in ("cas", "cad") and codes[at] != codes[n + 2 + i]:
                    status[i] = to[MISMATCH]
                elif op in ("cad", "delete"):
                    life, at = VOID, nothing
                elif op != "get":
                    at = i + 1
                new[i] = at
            held = pool.slice(at, 1)
            keep = np.array(kinds) > 0  # without the begins
            words = pa.array([*_STATUS, *(str(s) for s in (VOID, PREALLOC, LIVE))]).take(pa.array([s if s >= 0 else len(_STATUS) - 1 - s for s in status]))
            out = pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("key"), batch.column("op"), words, pool.take(pa.array(old)), pool.take(pa.array(new))], ["seq", "key", "op", "status", "old", "new"])
            yield out.filter(pa.array(keep))

    return rows.mapInArrow(run, schema)


def apply_ops_streamed(state: DataFrame, ops: DataFrame, *, max_record_size: int | None = None) -> DataFrame:
    """RESULT as ``apply_ops`` gives it, plus for each recid a last row with op "end": its state as status, its payload as new."""
    done = run_ops(state.withColumnRenamed("recid", "key"), ops.withColumnRenamed("recid", "key"), max_record_size=max_record_size)
    return done.select("seq", F.col("key").alias("recid"), "op", "status", "old", "new")


def apply_ops(state: DataFrame, ops: DataFrame, *, max_record_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The new STATE, and RESULT(seq, recid, op, status, old, new) with a row for each operation.

    ``old`` and ``new`` are the payloads before and after. Records without operations pass unchanged; records that end
    void are dropped; recids aren't null. Null equals null and NaN equals NaN in comparisons.
    """
    done = apply_ops_streamed(state, ops, max_record_size=max_record_size)
    touched = done.where("op = 'end'").select("recid", F.col("status").cast("int").alias("state"), F.col("new").alias("payload"))
    return touched.where(F.col("state") != VOID), done.where("op <> 'end'")
