"""Connected components over an edge table, without collecting edges, labels or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import stage_table


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(a, b) to (id, root): the smallest id reachable from each id that has an edge.

    Each round takes over the smallest label among neighbours and then the label's label, so the number of rounds is
    about the logarithm of the longest path. Both steps are joins and minima, which combine before they shuffle. Repeated edges and
    loops do no harm; no edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = stage_table(both.distinct(), "edges")
    labels = stage_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        taken = labels.join(near, labels["id"] == near["a"]).select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        taken = taken.join(jump, taken["root"] == jump["_i"]).select("id", "was", F.least("root", "_r").alias("root"))
        taken = stage_table(taken, "labels")
        labels = taken.select("id", "root")
        if taken.where("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
