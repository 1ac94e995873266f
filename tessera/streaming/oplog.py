"""A stream of operations applied batch by batch; the batch order is the order of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.snapshot import commit, manifests, reopen


def run_log(ops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of ``ops(seq, recid, op, arg, expected)`` into the store at ``path`` and publish it.

    A batch that is repeated after a failure would be applied twice; the snapshot's number is the batch's plus two (one
    for the first store), so a batch that was published already is passed over.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if manifests(spark, path)[-1][0] < number + 2:
            commit(reopen(spark, path, check=False).apply(batch)[0], path)

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
