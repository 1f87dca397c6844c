"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.session import cut


def connected(links: DataFrame, a: str = "a", b: str = "b", node: str = "node", label: str = "label") -> DataFrame:
    """(node, label) of every node in ``links``; the label is the least node of its component.

    A round takes the least label among neighbours and then the label of that label, and is written, so the
    number of rounds grows with the logarithm of the longest chain and a lost executor repeats one round.
    Sums by node are pre-aggregated, so a node with very many links is no hot key.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x") != F.col("y"))
    edges = cut(pairs.union(pairs.select("y", "x")).distinct())
    labels = cut(edges.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias(node), F.least("x", "m").alias(label)))
    while True:
        near = (edges.join(labels, edges["y"] == labels[node]).groupBy("x").agg(F.min(label).alias("m")))
        lower = labels.join(near, labels[node] == near["x"]).select(node, label, F.least(label, "m").alias("l"))
        lower = cut(lower)
        jump = lower.select(F.col(node).alias("j"), F.col("l").alias("jl"))
        new = cut(lower.join(jump, F.col("l") == F.col("j")).select(node, F.col(label).alias("old"), F.least("l", "jl").alias(label)))
        changed = not new.where(F.col("old") != F.col(label)).isEmpty()
        labels = new.select(node, label)
        if not changed:
            return labels
