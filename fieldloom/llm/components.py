"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, written

#: Edges that one task contracts: at most about 100 bytes each are held.
TOGETHER = 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, contracted: each node with the smallest one that it reaches here."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        top = i
        while (up := root.get(top, top)) != top:
            top = up
        while i != top:
            root[i], i = top, root[i]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    made = [np.array(nodes, np.int64), np.array([find(i) for i in nodes], np.int64)]
    keep = made[0] != made[1]
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in made], names=["a", "b"])


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges, contracted within each partition and then within as many of these together as hold TOGETHER edges; whether that was one task, which settles them."""
    edges = written(edges.mapInArrow(_stars, "a long, b long"), "edges")
    tasks = max(1, -(-edges.count() // TOGETHER))
    return written(edges.coalesce(tasks).mapInArrow(_stars, "a long, b long"), "contracted"), tasks == 1


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs under one root, and no root under another."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    counts = ends.groupBy("u").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not counts.where("low > 1 or (low > 0 and top > 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node with an edge to a smaller one. edges: a, b long.

    Partitions contract their own edges first, and again after each step, a bounded number of edges a task; a graph that
    shrinks to one such task ends there. Each step is written to the shared folder; a hub's rows are dealt out, so no task
    sees a whole star.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, whole = _contracted(edges)
    while not (whole or _settled(edges)):
        total = edges.count()
        # large-star: larger neighbours of a node go to the smallest node around it
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("group_rows")).select("u", F.least("u", "m").alias("m"), "group_rows"), "least")
        large = attach(edges, least.withColumnRenamed("u", "b"), "b", F.col("a"), total).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        # small-star: a node and its smaller neighbours go to the smallest of these
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("group_rows")), "least")
        joined = attach(large, least, "a", F.col("b"), total)
        small = joined.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges, whole = _contracted(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
