"""Connected components as Spark joins: neighbours' least label, then a jump to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackstream.llm.common import cut, join_values


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Labels fall along links and along label pointers in turn, so long chains need few rounds. Every round is cut with
    ``checkpoint()``. The links of nodes that have very many, and the nodes of labels that have very many, are dealt over
    several tasks (``join_values``), so no star meets in one. No edges give no rows; repeated edges and loops change nothing.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.select(ways.alias("e")).select("e.*").where("a != b").distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"), F.count("*").alias("links")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        seen = join_values(both, labels.select(F.col("node").alias("b"), "label", "links"), "b", "links").groupBy("a").agg(F.min("label").alias("low"))
        lowered = cut(labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "links", F.col("label").alias("old"), F.least("label", "low").alias("label")))
        used = lowered.groupBy("label").agg(F.count("*").alias("n"))
        jump = used.join(lowered.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        labels = cut(join_values(lowered, jump, "label", "n").select("node", "links", "old", F.least("label", "further").alias("label")))
        if not labels.where("old != label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("old")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
