"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, cut_counting


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """node, label (the component's smallest node) of each node in ``edges`` (columns a and b; ``n`` rows, if known).

    Every round takes the smallest label among neighbours and then that label's
    own label, until none changes; lineage is cut each round and nothing but
    one count reaches the driver. Labels meet a hot node's edges in joins whose
    skewed side can be split.
    """
    ends = None if n is None else 2 * n
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), ends)
    labels = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), ends)
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("offer")), "other").groupBy("node").agg(F.min("offer").alias("offer"))
        nearer = labels.join(heard, "node").select("node", F.least("label", "offer").alias("mid"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("beyond"))
        new, changed = cut_counting(nearer.join(jump, "mid").select("node", F.least("mid", "beyond").alias("label"), "was"), F.col("label") != F.col("was"), rows=ends)
        labels = new.drop("was")
        if not changed:
            return labels
