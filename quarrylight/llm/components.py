"""Connected components of a link table, by rounds of joins on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _pairs(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the least node that can be reached. Each round hooks every node that has a lower
    neighbour to the least one, follows the hooks to their ends by doubling, and puts the ends in the nodes' places. A link then
    joins two ends or falls away, so links always lie between whole regions. A round with a link removes at least one node, and
    with labels in random order a fixed share of them; rounds go on until no link is left. The least node of a component is never
    hooked, so it is the one that remains. Every round is written to the shared folder, which cuts lineage."""
    edges = written(_pairs(links), "edges")
    labels = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("component")), "labels")
    while edges.limit(1).count():
        hooks = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        moved = True
        while moved:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            new = written(hooks.select("node", "root").join(up, "root", "left").select("node", F.col("root").alias("old"), F.coalesce("higher", "root").alias("root")), "hooks")
            moved = new.where("old <> root").limit(1).count()
            discard(hooks)
            hooks = new
        at_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        at_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))  # every b has a lower neighbour
        ends = edges.join(at_b, "b").join(at_a, "a", "left").select(F.coalesce("root_a", "a").alias("a"), F.col("root_b").alias("b"))
        fewer = written(_pairs(ends), "edges")
        at = hooks.select(F.col("node").alias("component"), "root")
        new = written(labels.join(at, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        for old in (edges, labels, hooks):
            discard(old)
        edges, labels = fewer, new
    discard(edges)
    return labels
