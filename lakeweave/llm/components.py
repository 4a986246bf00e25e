"""Connected components of a graph of links: of few links in one task, of more by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_only

#: Links between numbers, 16 bytes each, that one task connects. Steps over more take many small shuffles, each with files and events for every task.
GATHERED = 1 << 20


def components(edges: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(node, component): for each end of the links (a, b) the least node that it is connected with, a row a node.

    Up to ``gathered`` links between longs are connected in one task. With more, or other nodes, each step is an
    aggregation by node and a join back, both of which bear a node with very many links; the number of rounds grows
    with the logarithm of the longest path. Nothing comes to the driver but a count or a checksum. ``gathered``
    changes the way, not the result.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if dict(now.dtypes)["u"] == "bigint" and now.count() <= gathered:
        return now.coalesce(1).mapInArrow(_connected, "node long, component long")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        now = cut(small)
        check = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == check:
            break
        before = check
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _connected(batches):
    keep_only()
    ends = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, code = np.unique(np.concatenate([x for pair in zip(*ends, strict=True) for x in pair]), return_inverse=True)
    label = least_reached(code[: len(code) // 2], code[len(code) // 2 :], len(nodes))
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[i : i + (1 << 16)]), "component": pa.array(nodes[label[i : i + (1 << 16)]])})


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` nodes the least that the links between ``a`` and ``b`` connect it with."""
    label = np.arange(n)
    while len(a):
        one, other = label[a], label[b]
        apart = one != other
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))  # roots only
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
