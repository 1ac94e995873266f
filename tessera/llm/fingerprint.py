"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

Sketches of any two texts are comparable and merge by union, whatever the texts' sizes; what two sketches have in
common, over the smaller one's size, estimates the containment of the smaller text. A text none of whose shingles falls
below the threshold keeps its smallest hash instead, so that only texts without shingles have an empty sketch; a merge
keeps the hashes below the threshold, or else the smallest one, which equals the sketch of the merged set. Such a stand-in
can be compared with another stand-in only: a sketch of hashes below the threshold says nothing about those above it, so
between the two the containment is not known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text
from tessera.llm.scratch import partitions

_U = np.uint64


def sketch(shingles: np.ndarray, scaled: int) -> np.ndarray:
    """The sorted hashes below 2**64 / ``scaled``, or the smallest one."""
    n = int(np.searchsorted(shingles, _U((1 << 64) // scaled)))
    return shingles[: max(n, 1)]


def merge(a: np.ndarray, b: np.ndarray, scaled: int) -> np.ndarray:
    """The sketch of the union of two shingle sets, from their sketches."""
    return sketch(np.union1d(a, b), scaled)


def containment(a: np.ndarray, b: np.ndarray, scaled: int) -> float | None:
    """Estimated containment of the smaller set in the other: 1 for two empty sketches, 0 if just one is empty.

    None where it isn't known: one of the sketches is a stand-in, and the other one isn't.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    limit = _U((1 << 64) // scaled)
    if (a[0] >= limit) != (b[0] >= limit):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def likeness(a: np.ndarray, b: np.ndarray, scaled: int) -> float:
    """``containment``, 0 where it isn't known."""
    return containment(a, b, scaled) or 0.0


def encode(hashes: np.ndarray) -> str:
    """16 lowercase hex digits for each hash, ascending."""
    return hashes.astype(">u8").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(_U)


def _sketches(texts: list[str], k: int, scaled: int) -> list[np.ndarray]:
    data, at = text.column(pa.array(texts, pa.large_string()))
    return [sketch(s, scaled) for s in text.shingle_sets(data, at, k)]


def _fingerprinted(batches: Iterator[pa.RecordBatch], k: int, scaled: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array([len(t) for t in part], pa.int64()), pa.array(map(encode, _sketches(part, k, scaled)), pa.string())], ["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame, *, k: int = 5, scaled: int = 8) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row of ``docs(doc_id, text)``, over word shingles of the whole text.

    A null text is empty and has the empty fingerprint; texts of any length are taken whole; repeated rows and rows without an
    id each have theirs; further columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _fingerprinted(b, k, scaled), "doc_id long, n_chars long, fingerprint string")


def edited(own: str, following: str) -> str:
    """``own`` with its last quarter (rounded down, in code points) replaced by as much of ``following`` as there is."""
    n = len(own) // 4
    return own[: len(own) - n] + following[:n]


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch], k: int, scaled: int) -> Iterator[pa.RecordBatch]:
    """Rows come as (range, doc_id, text, guest), sorted; a row's next one in its range is its next document, and a guest is only that."""
    held: tuple[int, int, str, bool] | None = None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = [(r, d, "" if t is None else t, g) for r, d, t, g in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)]
            rows = [held, *rows] if held else rows
            held = rows[-1]
            todo = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x[3]]
            changed = [edited(x[2], y[2]) for x, y in todo]
            by_row = {id(row): s for row, s in zip(rows, _sketches([r[2] for r in rows], k, scaled), strict=True)}
            other = _sketches(changed, k, scaled)
            own = [(by_row[id(x)], by_row[id(y)]) for x, y in todo]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[1] for x, _ in todo], pa.int64()), pa.array([len(x[2]) for x, _ in todo], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([encode(a) for a, _ in own], pa.string()), pa.array(map(encode, other), pa.string()),
                    pa.array([likeness(a, e, scaled) for (a, _), e in zip(own, other, strict=True)], pa.float64()),
                    pa.array([likeness(a, b, scaled) for a, b in own], pa.float64()),
                ],
                [c.split()[0] for c in _PAIR.split(", ")],
            )


def compared_with_next(docs: DataFrame, *, k: int = 5, scaled: int = 8) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document, by ascending doc_id.

    After the last document comes the first. Rows are dealt once to ranges of doc_id (by quantiles, so about even), each a
    task of its own, and sorted there; the first document of a range also goes to the range before it, as a guest, so nothing
    else is exchanged and no task sees more than its range. A null text is empty. Rows without an id come first; rows that
    repeat a doc_id follow each other in the order of their texts; an only row is its own next. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids, n = rows.select("key"), max(partitions(spark), 2)
    cuts = sorted(set(ids.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(key):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right"))

    # A row for each range that has rows: at most as many as the shuffle is wide.
    firsts = [(r["r"], r["key"]) for r in ids.groupBy(range_of("key").alias("r")).agg(F.min("key").alias("key")).orderBy("r").collect()]
    before = F.broadcast(spark.createDataFrame([(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)], "key long, range int"))
    # Of rows that repeat a range's first doc_id, the one with the smallest text is the guest.
    guests = rows.join(before, "key").groupBy("key", "range").agg(F.min(F.struct("text", "doc_id")).alias("r"))
    guests = guests.select("range", "key", F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), F.lit(True).alias("guest"))
    own = rows.select(range_of("key").alias("range"), "key", "doc_id", "text", F.lit(False).alias("guest"))
    dealt = own.unionByName(guests).repartitionById(n, F.col("range")).sortWithinPartitions("range", "guest", "key", "text")
    return dealt.select("range", "doc_id", "text", "guest").mapInArrow(lambda b: _pairs(b, k, scaled), _PAIR)
