"""Connected components by minimum labels with pointer jumping, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): undirected links between long ids. Returns (node, root) with the smallest reachable node.

    Only nodes that have a link are returned. Self links and repeated links do no harm; an empty input gives an empty
    result; NULL ends are ignored. Each round takes the smallest label among a node's neighbours and then follows that
    label once (pointer jumping), so that long chains take logarithmically many rounds; labels only sink, so it ends. Rounds are checkpointed.
    """
    both = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.least("root", "m").alias("r"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("r"), F.col("root").alias("far"))
        new = cut(step.join(jump, "r", "left").select("node", F.least("r", F.coalesce("far", "r")).alias("root"), "was"))
        labels = new.select("node", "root")
        if new.where("root <> was").limit(1).count() == 0:
            return labels


def stars(n: int, pairs) -> list[tuple[int, int]]:
    """(member, first member) for each component of n nodes under the pairs; single nodes are left out."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(i, r) for i in range(n) if (r := find(i)) != i]
