"""Connected components of a graph given as rows, by minimum labels with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_all


def components(edges: DataFrame, a: str = "a", b: str = "b", least: int = 100_000) -> DataFrame:
    """Rows (node, root): for each node of an edge the smallest node that it is connected with.

    Each round takes the smallest label among neighbours, then that label's own label; rounds go on until
    nothing changes, a few for shallow graphs. Each round's labels are checkpointed, so the lineage
    stays short and a lost executor costs one round. No edges give no rows.

    The centre of a star has all its edges, the root of a large component all its nodes: labels that over
    ``least`` rows of two numbers ask for are joined by a broadcast of bounded size (``join_all``), so that no such
    key fills a task. A graph that cannot have such a key, by its largest degree and its size, is joined plainly.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = checkpointed(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # n: how many neighbours ask for a node's label
    labels = checkpointed(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved"), "n"))
    size = labels.agg(F.count("*").alias("nodes"), F.sum("n").alias("pairs"), F.max("n").alias("most")).first()
    while not labels.where("moved").isEmpty():
        of = labels.select(F.col("node").alias("v"), F.col("root").alias("m"), "n")
        asked = join_all(pairs, of, "v", "n", size.pairs, least) if size.most > least else pairs.join(of.drop("n"), "v")
        near = asked.groupBy(F.col("u").alias("node")).agg(F.min("m").alias("m"))
        step = labels.select("node", "root", "n").join(near, "node").select("node", "root", "n", F.least("root", "m").alias("next"))
        # A root is the smallest node it has met, so its own label may have become smaller meanwhile.
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("above"))
        if size.nodes > least:
            step = checkpointed(step)
            up = checkpointed(step.groupBy("next").agg(F.count("*").alias("askers")).join(up, "next"))
            met = join_all(step, up, "next", "askers", size.nodes, least)
        else:
            met = step.join(up, "next")
        labels = checkpointed(met.select("node", F.least("next", "above").alias("new"), "root", "n").select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("moved"), "n"))
    return labels.select("node", "root")


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node of each one's component, for the edges of one task."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new
