"""Connected components of links too many for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WEIGHTY, array, groups, join_spread, materialize

#: So many links (16 bytes each) are followed by one task; the steps for more cost dozens of jobs.
FEW = 1 << 20


def _edges(df: DataFrame, label: str) -> DataFrame:
    """Distinct links as a table, with what tells two sets of them apart: their number and a sum of hashes."""
    return materialize(df.distinct(), label, links=F.count(F.lit(1)), hashes=F.bit_xor(F.xxhash64("u", "v")))


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links, ascending, and its smallest reachable one.

    Roots hang on smaller roots that a link leads to, and every node then on
    its root, until no link joins two roots.
    """
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(place.reshape(-1), 2)
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` for ``FEW`` links at most, and so for twice as many nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[array(b, x).to_numpy() for x in ("u", "v")] for b in batches if b.num_rows]
        if held:
            found = smallest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField(x, T.LongType()) for x in ("node", "component")]))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for each node with a link.

    ``links`` has ``u`` and ``v``, which are longs. ``FEW`` distinct links or
    less are followed by one task. More take large-star and small-star steps by turns
    (Kiveris et al., Connected Components in MapReduce and Beyond): each hangs
    neighbours on smaller ones until every node hangs on its component's
    smallest. A step is a minimum by node, which is combined before it is
    shuffled, and an equi-join that leaves the links of nodes with very many
    neighbours where they are (:func:`join_spread`). Links of a node with
    itself or with null do not count; repeated ones count once.
    """
    edges = _edges(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    for _ in range(most_rounds):
        if edges.seen["links"] <= FEW:
            return _in_one_task(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("low"), F.count("*").alias("held"))
        many = edges.seen["links"] > WEIGHTY  # else no node has many neighbours
        join = lambda left, right, label: join_spread(left, groups(right, label), ["u"]) if many else left.join(right.drop("held"), "u")  # noqa: B023, E731
        large = join(both.where("v > u"), low, "large-lows").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # large hangs u on v < u: the neighbours that small-star looks at.
        large = materialize(large, "large-star")
        lows = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("held"))
        near = join(large, lows, "small-lows").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = _edges(near.unionByName(lows.select("u", F.col("low").alias("v"))), "small-star")
        before, edges = edges.seen, after
        if edges.seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
