"""Connected components of an edge table.

Up to ``FEW`` edges (counted) are joined by one task with union-find: a bounded table, and one job instead of many
rounds. Beyond, minimum labels spread with pointer jumping, all in Spark: each round costs joins and map-side
combined minima only, and is written to the shared folder, so lineage stays short and lost executors recompute one
round. Nothing is collected on the driver.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

if TYPE_CHECKING:  # workers that don't need it stay smaller without it
    import pandas as pd

#: Edges that one task may join (two longs each).
FEW = 1_000_000


def _union(edges: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    nodes, ends = np.unique(edges[["x", "y"]].to_numpy(np.int64), return_inverse=True)
    ends = ends.reshape(-1, 2)
    parent = list(range(len(nodes)))  # nodes ascend, so the smaller root is the smaller node
    for a, b in ends.tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(len(parent)):  # a parent is smaller, so it is final already
        parent[i] = parent[parent[i]]
    return pd.DataFrame({"node": nodes, "label": nodes[parent]}, columns=["node", "label"]).astype("int64")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(x, y) -> (node, label): label is the smallest node of the component; nodes without an edge are absent."""
    edges = edges.select("x", "y")
    if edges.count() <= few:
        return materialize(edges.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_union, "node long, label long"))
    pairs = materialize(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialize(pairs.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = labels.withColumnRenamed("node", "y")
        near = pairs.join(seen, "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, "node").join(jump, "label").select("node", F.col("label").alias("old"), F.least("label", "near", "jump").alias("label"))
        new = materialize(new)
        changed = new.where("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _ends(links: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    step = dict(zip(links["x"].tolist(), links["root"].tolist()))
    for x in list(step):
        path, at = [], x
        while at in step:
            path.append(at)
            at = step[at]
        for p in path[:-1]:
            step[p] = at
    return pd.DataFrame({"x": list(step), "root": list(step.values())}, columns=["x", "root"]).astype("int64")


def roots(links: DataFrame, few: int = FEW) -> DataFrame:
    """(x, root): the end of each chain of links (x, y); one link leaves each x, and chains end."""
    at = links.select("x", F.col("y").alias("root"))
    if at.count() <= few:
        return materialize(at.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_ends, "x long, root long"))
    while True:
        jump = at.select(F.col("x").alias("root"), F.col("root").alias("far"))
        new = materialize(at.join(jump, "root", "left").select("x", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = new.select("x", "root")
        if not new.where("moved").limit(1).count():
            return at
