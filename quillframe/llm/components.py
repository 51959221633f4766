"""Connected components of an edge table, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: No more edges than this go to one task, which needs no rounds.
AT_ONCE = 100_000
#: A node's neighbours are dealt to so many parts, so that a hub's edges do not meet in one task.
PARTS = 32


def least_members(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each item's component, of items 0 to n - 1 linked by (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = np.concatenate([np.zeros((2, 0), np.int64), *([c.to_numpy() for c in b.columns] for b in batches)], 1)
    nodes, which = np.unique(ends, return_inverse=True)
    v, u = which.reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least_members(len(nodes), v, u)])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component): the least node that can be reached, for every node that has an edge.

    Large star: each node hands its greater neighbours to its least neighbour; small star: each node hands its lesser
    neighbours to the least of them. When no edge changes, every edge points to the component's least node. The least
    neighbour is found by parts of a node's neighbours and goes back to each part, so that the edges of a hub stay dealt.
    Edges that still change after so many rounds raise an error, as their components are not whole. Edges that are known to be
    few are joined in one task instead.
    """
    now = written(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v < u").distinct())
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if state[0] <= at_once:
        return now.select("v", "u").coalesce(1).mapInArrow(_whole, "node bigint, component bigint")
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
        parts = both.groupBy("u", "part").agg(F.min("v").alias("m"))
        least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
        of_part = parts.select("u", "part").join(least, "u")  # at most PARTS rows a node
        large = both.where("v > u").join(of_part, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("v < u")  # repeats go in the small star
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.where("v < u").distinct())
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    nodes = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
