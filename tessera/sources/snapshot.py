"""Commit and reopen: Parquet snapshots with a manifest, and the flat record file for exchange.

A snapshot is written to a folder of its own, under a name that no other commit has; then its manifest is written aside and
moved to its number, which fails if another commit took that number first. So a reader sees a whole snapshot or the one
before, and two committers can't harm each other's. All of it goes through the session's file system, never through local
paths.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.state import LIVE, PREALLOC
from tessera.plans.store import RecordStore


def manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and place of every published snapshot's manifest, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*")) if fs.exists(root) else None
    return sorted((int(s.getPath().getName().split("-")[1]), s.getPath().toString()) for s in found or [])


def _checksum(state: DataFrame) -> tuple[int, int]:
    row = state.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(recid, state, payload))"), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


class CommitConflict(Exception):
    """Another commit published the same number first; what was written is removed, and the store may be committed again."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _publish(spark: SparkSession, path: str, version: int, text: str) -> None:
    """The manifest, written aside and renamed without overwriting."""
    fs, new = _files(spark, path)
    aside, to = new(f"{path}/.manifest-{uuid.uuid4().hex}"), new(f"{path}/manifest-{version}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(aside, to, never)
    except Exception as error:
        fs.delete(aside, False)
        if fs.exists(to):
            raise CommitConflict(f"manifest {version} of {path} is there already") from error
        raise


def commit(store: RecordStore, path: str) -> int:
    """Publish a snapshot under ``path``; its number. What was written without a manifest is never read: see ``rollback``.

    A store whose records take more bytes than its ``size_limit`` is refused, and nothing is published.
    """
    spark = store.state.sparkSession
    version = (manifests(spark, path) or [(0, "")])[-1][0] + 1
    folder = f"snapshot-{uuid.uuid4().hex}"
    store.state.repartitionByRange("recid").sortWithinPartitions("recid").write.parquet(f"{path}/{folder}")
    written = spark.read.parquet(f"{path}/{folder}")
    rows, checksum = _checksum(written)
    fs, new = _files(spark, path)
    try:
        if store.size_limit is not None and (held := replace(store, state=written).summary().first()["bytes"]) > store.size_limit:
            raise ValueError(f"the records take {held} bytes, the limit is {store.size_limit}")
        text = json.dumps({"version": version, "folder": folder, "rows": rows, "checksum": checksum, "max_recid": store.highest(), "max_record_size": store.max_record_size, "size_limit": store.size_limit})
        _publish(spark, path, version, text)
    except Exception:
        fs.delete(new(f"{path}/{folder}"), True)
        raise
    return version


def _manifest(spark: SparkSession, place: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(place).collect()))


def reopen(spark: SparkSession, path: str, version: int | None = None, *, check: bool = True) -> RecordStore:
    """The last published store, or an earlier one; an error if its rows aren't those that were committed (``check`` reads them).

    Recids that are void in it are free for the next puts.
    """
    named = dict(manifests(spark, path))
    manifest = _manifest(spark, named[version or max(named)])
    state = spark.read.parquet(f"{path}/{manifest['folder']}")
    if check and _checksum(state) != (manifest["rows"], manifest["checksum"]):
        raise ValueError("the snapshot is not what was committed")
    store = RecordStore(state, manifest["max_recid"], manifest["max_record_size"], size_limit=manifest["size_limit"])
    return replace(store, freed=store.free_recids()) if manifest["rows"] < manifest["max_recid"] else store


def rollback(spark: SparkSession, path: str) -> list[str]:
    """Remove what commits that never published left under ``path``; the names removed. Not while another commit is under way."""
    fs, new = _files(spark, path)
    if not fs.exists(new(path)):
        return []
    published = {_manifest(spark, place)["folder"] for _, place in manifests(spark, path)}
    removed = []
    for entry in fs.listStatus(new(path)):
        name = entry.getPath().getName()
        if name.startswith(".manifest-") or name.startswith("snapshot-") and name not in published:
            fs.delete(entry.getPath(), True)
            removed.append(name)
    return sorted(removed)


#: The flat file: a count, then for each record its recid, its size (-1: preallocated) and its bytes, all big-endian.
_HEAD, _RECORD = ">q", ">qi"


def export_flat(state: DataFrame, path: str) -> None:
    """Binary payloads as flat record files, one for each Arrow batch, each under its own count (Parquet rows of one BINARY value)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [struct.pack(_HEAD, batch.num_rows)]
            for r in batch.to_pylist():
                out += [struct.pack(_RECORD, r["recid"], -1 if r["state"] == PREALLOC else len(r["payload"])), b"" if r["state"] == PREALLOC else r["payload"]]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["flat"])

    state.select("recid", "state", F.col("payload").cast("binary")).mapInArrow(write, "flat binary").write.mode("overwrite").parquet(path)


def import_flat(flat: DataFrame) -> DataFrame:
    """STATE of ``flat(flat)``: flat record files as BINARY values, such as ``spark.read.format("binaryFile")`` gives in ``content``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                recid, state, payload, at = [], [], [], 8
                for _ in range(struct.unpack_from(_HEAD, data)[0]):
                    r, n = struct.unpack_from(_RECORD, data, at)
                    at += 12
                    recid.append(r)
                    state.append(PREALLOC if n < 0 else LIVE)
                    payload.append(None if n < 0 else data[at : at + n])
                    at += max(n, 0)
                yield pa.RecordBatch.from_arrays([pa.array(recid, pa.int64()), pa.array(state, pa.int32()), pa.array(payload, pa.binary())], ["recid", "state", "payload"])

    return flat.mapInArrow(read, "recid long, state int, payload binary")
