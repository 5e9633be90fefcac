"""Connected components of links held in a DataFrame.

Up to ``ONE_TASK`` links are counted first and then joined in one executor task, by minima and pointer jumping. More
go through alternating large-star and small-star steps: every step is a grouped minimum and a join. Nothing is gathered on the driver but
a count and a checksum. Each round is written to the shared folder, so a lost executor costs one round at most and lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.frames import written


ONE_TASK = 400_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of one task's links reaches."""
    links = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not links:
        return
    u, v = (np.concatenate(x) for x in zip(*links))
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(flat, 2)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "root": pa.array(nodes[root])})


def _downward(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u long, v long) to ``(node, root)``: the smallest node that each linked node reaches.

    Repeated links, loops and both directions are allowed; null ends are dropped; no links give no rows.
    """
    edges, before = written(_downward(links.where("u IS NOT NULL AND v IS NOT NULL")), "links"), None
    if edges.count() <= ONE_TASK:
        return written(edges.coalesce(1).mapInArrow(_joined, "node long, root long"), "roots")
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if tuple(state) == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _downward(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = written(_downward(small), "links")
