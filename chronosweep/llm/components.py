"""Connected components of an edge table, by alternating star contractions.

Large stars hang a node's larger neighbours on its least one, small stars its
smaller ones; each round is two joins and two sums, written to the shared
checkpoint folder, and the number of rounds grows with the logarithm of the
number of nodes.  Nothing is collected but one count and one checksum a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node), for every node that an edge names.  Edges with null ends are ignored."""
    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    now, seen = cut(ends.distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        # written, so that a hub's rows come from a plain shuffle that Spark can split
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        inner = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(inner, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        now = cut(small.where("hi != lo").distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components: what a task contracts before it hands links on."""
    parent = np.arange(n)
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(pu, pv)[apart], np.minimum(pu, pv)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
