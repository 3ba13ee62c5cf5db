"""Connected components over an edge table, distributed.

Labels start as the node itself. Each round, a node takes the least label among itself and
its neighbours, and then the label of its label (pointer jumping), so paths shrink by
doubling. Minima are aggregated before the shuffle. Labels are looked up by broadcast while
there are few; beyond that the edges of a hub and the members of a giant component, which
share a key, do not meet in one task (``lookup``). Each round's labels are checkpointed.

Defined results: null ends and loops join nothing; direction and repeats do not matter; without
edges there are no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import cut, lookup

#: Labels are broadcast below this many rows of two longs.
BROADCAST_LABELS = 100_000


def components(edges: DataFrame, limit: int = BROADCAST_LABELS) -> DataFrame:
    """(node, label) for edges (a, b): label is the least node of the component."""
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    rows = labels.count()
    while rows:
        of_b = labels.select(F.col("node").alias("b"), "label")
        near = lookup(both, of_b, "b", rows, limit=limit).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        new = cut(lookup(step, jump, "label", rows, limit=limit).select("node", "old", F.least("label", "jumped").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            break
    return labels
