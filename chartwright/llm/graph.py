"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component), component = smallest node reachable; only nodes with a link.

    Every step is a grouped minimum (pre-aggregated before its shuffle) and a join back by node, so a
    node with very many links is split by adaptive skew joins and never gathered. Each round is
    written to the shared folder, which bounds the lineage. Self-links and repeated pairs are ignored;
    null ends are dropped. An empty input gives an empty result.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo"))).distinct()
        after = materialize(small, "edges")
        found = _state(after)
        discard(now)
        now = after
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def union_roots(parent, i, j):
    """Merge, in a numpy parent array, the classes of i[k] and j[k] for every k; smaller roots win."""
    import numpy as np

    while True:
        ri, rj = parent[i], parent[j]
        open_ = ri != rj
        if not open_.any():
            return parent
        ri, rj = ri[open_], rj[open_]
        i, j = ri, rj
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
