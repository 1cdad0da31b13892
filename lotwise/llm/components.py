"""Distributed connected components (alternating large-star and small-star rounds, then union-find).

Edges live in Spark tables only: each round replaces every edge by an edge to the smallest known
neighbour, by aggregation and joins, until every node points straight at its smallest member.
Rounds grow with the logarithm of the longest path. A node with very many edges is one key of a
plain sort-merge join, which adaptive execution splits; nothing is gathered on the driver but two
numbers per round. Once no more than ``ONE_TASK`` edges are left (a few MB), a single task finishes them
by union-find: the same labels, without further rounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import cut_lineage


cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges that one task finishes by union-find.
ONE_TASK = 200_000


def _union_find(batches):
    """Arrow batches of edges (u, v) to one batch of (node, component), smallest node first."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.array(sorted(parent), dtype=np.int64)
    roots = np.array([find(x) for x in nodes.tolist()], dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def _both_ways(e: DataFrame) -> DataFrame:
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return e.select(F.explode(ends).alias("x")).select("x.u", "x.v")


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    # every edge points from the larger node u to a smaller one v; u and its other neighbours move
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return e.join(low, "u").select(F.explode(moved).alias("x")).select("x.u", "x.v").where("u <> v").distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(r)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges (u, v)`` with the smallest node it reaches.

    Nodes are longs. Self-loops, repeated and reversed edges and null ends are ignored.
    Returns ``(node, component)`` for nodes with at least one edge; an empty input gives an empty
    table. The result does not depend on partitioning.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut_lineage(e)
    before = _state(e)
    if before[0]:
        for _ in range(max_rounds):
            if before[0] <= ONE_TASK:
                return cut_lineage(e.select("u", "v").coalesce(1).mapInArrow(_union_find, "node long, component long"))
            e = cut_lineage(_small_star(_large_star(e)))
            now = _state(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("connected_components did not settle")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
