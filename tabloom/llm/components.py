"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """Rows (node, component): ``parents`` (node, component), whose components are nodes too and never greater, followed to their
    ends by doubling the step."""
    labels = parents
    while True:
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        new = cut_lineage(labels.join(jump, "component").select("node", F.col("lower").alias("component"), (F.col("lower") < F.col("component")).alias("moved")))
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): for every node of ``edges`` (columns a and b, BIGINT, not null) the
    smallest node it is connected with. In a round every node takes the least of itself and its neighbours as parent, trees
    of parents become their roots, and the edges go on between different roots, each once: what a round has connected no later one reads.
    When no edge is left, the roots of all rounds are followed. Every round's tables are written to the shared checkpoint
    folder. No row is collected."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not rounds or not both.isEmpty():
        parents = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
        rounds.append(_roots(parents))
        ends = [rounds[-1].select(F.col("node").alias(c), F.col("component").alias(f"root_{c}")) for c in ("a", "b")]
        over = both.join(ends[0], "a").where("root_a <> b").join(ends[1], "b").where("root_a <> root_b")
        both = cut_lineage(over.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        labels = cut_lineage(rounds.pop().join(later, "component", "left").select("node", F.coalesce("lower", "component").alias("component")))
    return labels
