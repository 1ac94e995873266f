"""Hashes that no Spark expression computes: 32-bit XXH of bytes, and the bit patterns of floats. Arrow batches, never rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bits import wrap32
from tessera.functions.collections import fold_hash


def xxhash32(data: Column, seed: int = 0) -> Column:
    """The 32-bit XXH of a BINARY value as a signed INT; NULL for NULL."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda b: None if b is None else int(np.uint32(xxhash.xxh32_intdigest(bytes(b), seed & 0xFFFFFFFF)).astype(np.int32))).astype("Int32")

    return run(data)


def _bits(a: np.ndarray | None) -> np.ndarray | None:
    if a is None:
        return None
    x = np.array(a, np.float64)
    x[np.isnan(x)] = np.nan
    return x.view(np.int64)


def double_bits(a: Column) -> Column:
    """The IEEE bits of ARRAY<DOUBLE> elements as BIGINTs, one pattern for NaN."""

    @F.pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(_bits)

    return run(a)


def double_array_hash(a: Column, seed: int = 0) -> Column:
    """Fold of each element's (bits ^ bits >>> 32) as 32 bits."""
    return fold_hash(F.transform(double_bits(a), lambda b: wrap32(b.bitwiseXOR(F.shiftrightunsigned(b, 32)))), seed)
