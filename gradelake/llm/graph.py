"""Connected components by alternating star rounds over an edge table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import discard, written


def components(edges: DataFrame, files: int | None = None, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round hooks every node onto the smallest node around it and then onto that node's own smallest one; the
    number of rounds grows with the logarithm of a component's diameter. Nodes' neighbours are only ever reduced to
    their minimum, so a node with any number of neighbours is no burden. Each round's table takes ``files`` files at most.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), "edges", files)
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels", files)
    used = [both, label]
    for _ in range(rounds):
        around = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A node's old root is told of the new one, then labels are followed one step.
        told = hooked.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("told"))
        hooked = hooked.join(told, "node", "left").select("node", "old", F.least("root", F.coalesce("told", "root")).alias("root"))
        hooked = written(hooked, "hooked", files)
        step = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = written(hooked.join(step, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels", files)
        if not new.filter("root <> old").limit(1).count():
            discard(*used, hooked)
            return new.select("node", "root")
        label = new.select("node", "root")
        used += [hooked, new]
    raise RuntimeError("the components did not settle")
