"""Connected components of an edge table: least neighbour label, then a jump to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Loops and repeated edges do no harm; rows with nulls are skipped.
    """
    return _labelled(_both_ways(edges))


def _both_ways(edges: DataFrame) -> DataFrame:
    """The edges in both directions, each once, written; one pass over ``edges``, which may be costly, and one shuffle."""
    edges = edges.filter("a is not null and b is not null and a <> b")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return materialize(edges.select(ends.alias("ends")).select("ends.a", "ends.b").distinct(), "edges")


def _labelled(both: DataFrame) -> DataFrame:
    """Components of edges that stand in both directions.

    Every round takes for each node the least label of itself and its neighbours, then that label's
    label, and writes the labels to the shared folder, which cuts lineage and lets each join read plain
    tables, so Spark can split a hot node. Labels only fall; the loop ends with the first round that
    changes none.
    """
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("seen_by")).agg(F.min("component").alias("least"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("of_root"))
        lower = labels.join(seen, F.col("node") == F.col("seen_by")).select("node", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        lower = lower.join(roots, F.col("component") == F.col("root"), "left").select("node", "before", F.least("component", "of_root").alias("component"))
        lower = materialize(lower, "labels")
        changed = not lower.filter("before <> component").isEmpty()
        labels = lower.select("node", "component")
        if not changed:
            return labels


def grown(forest: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b); only what links components already known is worked on."""
    if forest is None:
        return connected_components(links)
    for end in ("a", "b"):
        known = forest.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        links = links.join(known, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_component", end)).select("a", "b")
    both = _both_ways(links)
    if both.isEmpty():
        return forest
    above = _labelled(both)
    raised = forest.join(above.select(F.col("node").alias("_node"), F.col("component").alias("_component")), F.col("component") == F.col("_node"), "left")
    raised = raised.select("node", F.coalesce("_component", "component").alias("component"))
    return materialize(raised.unionByName(above.join(forest.select("node"), "node", "left_anti")), "forest")
