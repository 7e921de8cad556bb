"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the undirected edges (a, b); root is the least node of the component.

    In each round every node hooks to its least neighbour, hooks are followed four times, and the edges are rewritten
    to the roots so far; edges within a root vanish. Ids should be hashes: then paths of falling ids are short and few
    rounds are needed. Rounds are cut by written tables; only the number of edges left comes to the driver.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    labels = None
    while True:
        both = written(edges.union(edges.select("b", "a")).toDF("a", "b"), "edges")
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        for _ in range(2):
            hooks = written(hooks, "hooks")
            up = hooks.select(F.col("node").alias("at"), F.col("root").alias("up"))
            hooks = hooks.join(up, hooks["root"] == up["at"]).select("node", F.col("up").alias("root"))
        hooks = written(hooks, "hooks")
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("at"), F.col("root").alias("up"))
            labels = labels.join(up, labels["root"] == up["at"], "left").select("node", F.coalesce("up", "root").alias("root"))
        a, b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = written(both.where("a < b").join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "contracted")
        if edges.isEmpty():
            return labels
