"""Keyed records and their lifecycle: STATE(recid, state, payload), one row a recid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, NumericType, StringType

VOID, PREALLOC, LIVE = 0, 1, 2
OK, NOT_FOUND, IS_PREALLOC, NOT_PREALLOC, MISMATCH, OCCUPIED = "OK", "NOT_FOUND", "PREALLOC", "NOT_PREALLOC", "MISMATCH", "OCCUPIED"
NULL_VALUE, TOO_LARGE = "NULL_VALUE", "TOO_LARGE"
#: Recids up to this one are set aside by convention; allocation starts at 1 and does not enforce it.
MAX_RESERVED_RECID = 255


class RecordError(Exception):
    """Raised in strict mode; ``status`` is one of the status words."""

    def __init__(self, status: str, recid: int):
        super().__init__(f"{status}: recid {recid}")
        self.status, self.recid = status, recid


#: Bytes of the fixed-width types.
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 8, "timestamp": 8, "timestamp_ntz": 8}


def record_size(value: Column, kind: DataType) -> Column:
    """Bytes of a record: of text as UTF-8, of fixed-width types their width, of decimals their text, of nested values their JSON."""
    name = kind.simpleString()
    if name in _WIDTH:
        return F.when(value.isNotNull(), _WIDTH[name])
    if isinstance(kind, (BinaryType, StringType)):
        return F.octet_length(value)
    return F.octet_length(value.cast("string") if isinstance(kind, NumericType) else F.to_json(value))


def as_state(rows: DataFrame, recid: str, payload: str) -> DataFrame:
    """All rows as live records."""
    return rows.select(F.col(recid).cast("long").alias("recid"), F.lit(LIVE).alias("state"), F.col(payload).alias("payload"))


def verify(state: DataFrame) -> DataFrame:
    """``recid, problem`` of every row that breaks an invariant: no result means a sound store."""
    problem = (
        F.when(F.col("recid").isNull() | (F.col("recid") <= 0), "bad recid")
        .when(~F.col("state").isin(VOID, PREALLOC, LIVE) | F.col("state").isNull(), "bad state")
        .when((F.col("state") == LIVE) & F.col("payload").isNull(), "live without payload")
        .when((F.col("state") != LIVE) & F.col("payload").isNotNull(), "payload without life")
    )
    repeated = state.groupBy("recid").agg(F.count("*").alias("n")).where("n > 1").select("recid", F.lit("repeated recid").alias("problem"))
    return state.select("recid", problem.alias("problem")).where("problem IS NOT NULL").unionByName(repeated)
