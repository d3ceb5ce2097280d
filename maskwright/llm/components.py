"""Connected components as joins: smallest label spreads over edges, and labels jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize, prepare


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being the smallest node reachable.

    Self edges are harmless; no edges give no rows. Labels only fall, so a round without a change of their sum is
    the last one. Jumping halves the way to the root each round, so rounds grow with the logarithm of a chain's
    length. Nothing is collected but that sum.
    """
    prepare(edges.sparkSession)
    # both directions of an edge come from one reading: edges that are found anew may be others
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = materialize(edges.select(F.explode(F.array(there, back)).alias("e")).select("e.a", "e.b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", F.least("component", "heard").alias("component"))
        roots = near.select(F.col("node").alias("root"), F.col("component").alias("next"))
        after = materialize(near.join(roots, near["component"] == roots["root"]).select("node", F.col("next").alias("component")))
        now = after.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        discard(labels)
        labels = after
        if now == total:
            break
        total = now
    discard(both)
    return labels
