"""Connected components: of few edges in one task, of more by alternating large and small stars, on DataFrames.

Up to ``few`` edges (32 MB of ends) are solved together, since rounds of joins over them cost hundreds of times their work. Of more,
each round replaces a node's edges by edges to the least node it knows, until a round changes
nothing; every round but the last lowers the sum of the smaller ends, so the loop ends, and rounds are
logarithmic in practice. Each is two aggregations and joins that pre-aggregate and split hot nodes,
and each result is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Joins on the node and its hash: other keys than the aggregation's give both sides an exchange, so that a hot node's side can be split."""
    hashed = lambda df: df.withColumn("_h", F.hash("u"))
    return hashed(edges).join(hashed(least), ["u", "_h"]).drop("_h")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Large: links every larger neighbour of a node to its least one; small: the node and its smaller neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = _with_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node reachable from each. A root is hooked on its least neighbouring root, so each turn halves the roots that are left."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _together(edges: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            nodes, roots = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for at in range(0, len(nodes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (nodes, roots)], ["node", "root"])

    return written(edges.repartition(1).mapInArrow(run, "node long, root long"))


def connected_components(edges: DataFrame, few: int = 1 << 21) -> DataFrame:
    """edges: u, v of any ordered type, cheap to read twice. Returns ``node, root``: of every node with an edge, the least node reachable."""
    kind = edges.schema["u"].dataType.simpleString()
    edges = edges.select("u", "v").where("u <> v")
    if kind == edges.schema["v"].dataType.simpleString() == "bigint" and edges.count() <= few:
        return _together(edges)
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = written(_star(_star(now, True), False))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))
