"""Connected components of a link table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, release
from tessera.llm.skew import heavy_keys, skew_join


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``links(a, b)``; component is its smallest reachable node.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label, so
    a chain of n nodes needs about log2(n) rounds. A node with a large share of all links and a label that many nodes have
    are dealt over many tasks; links and labels stay distributed, and the driver sees one flag a round. Links of a node
    with itself and repeated ones don't count; a link with a null end is ignored; without links the result is empty.
    """
    whole = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(whole.select("a", "b").union(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hubs = materialize(heavy_keys(both, ["b"]), "hubs")
    written = labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = (
            skew_join(both, labels.select(F.col("node").alias("b"), "component"), ["b"], heavy=hubs)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        hooked = materialize(hooked, "hooked")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = skew_join(hooked, jump, ["next"], "left")
        after = materialize(moved.select("node", "was", F.least("next", F.coalesce("far", "next")).alias("component")), "labels")
        release(hooked, written)
        written, labels = after, after.select("node", "component")
        if written.where("component <> was").isEmpty():
            release(both, hubs)
            return labels
