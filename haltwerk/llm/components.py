"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import scratch


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the least node that each linked node can reach.

    ``links`` has columns a and b.  Each round takes the least label among a
    node's neighbours, then the label of that label, so that long chains close
    in a logarithm of their length.  Every round starts from a written table.
    Least values combine before they are shuffled, so a node with very many
    links is no hot key for them; joins on such a node are split at run time.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.written(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = scratch.written(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
        step = met.join(up, met["label"] == up["up"], "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        step = scratch.written(step, "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of ``components`` after more links: only the components that these join are relabelled."""

    def named(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))

    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
    ends = scratch.written(ends.distinct(), "links")
    if ends.isEmpty():
        return labels
    joined = components(ends)
    new = joined.select(F.col("node").alias("old"), F.col("label").alias("new"))
    kept = labels.join(new, labels["label"] == new["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")  # nodes that had no link before
    return scratch.written(kept.unionByName(fresh), "labels")
