"""Connected components without bringing a component into one task or to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges in a file of a round's table, at least: a small graph is written by one task, not by one for each partition.
#: A task contracts at most about twice as many at a time.
FILE_EDGES = 500_000


def stars_of(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by these edges), but for the nodes that are the least themselves."""
    nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    root = np.arange(len(nodes))
    while len(a):
        # roots go under the least root they have an edge to; in two rounds half of those that have one are gone
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contract(edges: DataFrame, files: int) -> DataFrame:
    """The stars of each part of the edges, in `files` parts; only one part shows the whole of every component."""
    most = 2 * FILE_EDGES

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars_of(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["v", "u"])

        held: list = []
        for b in batches:
            held.append(tuple(c.to_numpy() for c in b.columns))
            if sum(len(v) for v, _ in held) > most:
                yield out(held)
                held = []
        if held:
            yield out(held)

    found = edges.select("v", "u").coalesce(files).mapInArrow(contract, "v long, u long")
    return found if files == 1 else found.distinct().coalesce(files)


def _settled(edges: DataFrame) -> bool:
    """Whether the edges v -> u are stars: every v has one u, and no u is a v."""
    ends = edges.groupBy(F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).cast("long").alias("down"), F.lit(1).alias("up")).distinct())
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). node, component (smallest node reachable), one row per node that has an edge.

    Every part of the edges is contracted to its stars by one task; a graph of one part is done by that. Else that
    alternates with a large-star and a small-star step until only stars are left: these only take minima per node
    (partial aggregation) and join them back, so a node of many edges is no bottleneck. Loops and repeated edges do no
    harm.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    while True:  # every round lowers an edge, so there is a last one
        files = 1 + now.count() // FILE_EDGES
        held, now = now, materialize(_contract(now, files), "edges")
        discard(held)
        if files == 1 or _settled(now):
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: neighbours above a node go under the least of its neighbourhood
        large = now.join(least.withColumnRenamed("x", "u"), "u").select("v", F.col("m").alias("u")).distinct()
        # small star: of the nodes below v, all and v itself go under the least
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        new = materialize(small.where("u < v").distinct().coalesce(files), "edges")
        discard(now)
        now = new
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
