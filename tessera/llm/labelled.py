"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, max_chars: int) -> pd.DataFrame:
    """``text, label`` of at most ``per_class`` rows a class, the first by a hash of the id, that aren't held out.

    Texts over ``max_chars`` code points are not learned from (they are scored, whole). The ids are picked from the
    labels alone; at most 2 * ``per_class`` of them then pick their texts, and of rows that repeat an id the smallest text
    counts, so no more rows than that come to the driver. Rows without an id aren't learned from.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = None
    for value in (0, 1):
        first = usable.where(F.col("label") == value).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = first if picked is None else picked.unionByName(first)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas()
    return rows.sort_values(["doc_id", "text"]).reset_index(drop=True)


def without_copies(rows: pd.DataFrame, k: int = 5, tries: int = 6) -> pd.DataFrame:
    """Rows of a sample whose text shares none of ``tries`` minima of permuted shingle hashes with an earlier row's.

    Copies and near copies of one labelled text would otherwise vouch for each other's every word.
    """
    data, at = text.column(pa.array(rows["text"], pa.large_string()))
    factor = text.mix(np.arange(1, tries + 1, dtype=np.uint64)) | np.uint64(1)
    seen: list[set[int]] = [set() for _ in range(tries)]
    keep = []
    for shingles in text.shingle_sets(data, at, k):
        least = [int((shingles * f).min()) for f in factor] if len(shingles) else [0] * tries
        keep.append(not any(x in s for x, s in zip(least, seen, strict=True)))
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return rows[np.array(keep, bool)]
