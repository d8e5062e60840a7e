"""Connected components: union within partitions, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

LINKS_PER_TASK = 1_000_000


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the least of its component, and that least node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    under = root != np.arange(len(nodes))
    return nodes[under], nodes[root[under]]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = united(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, root) for every node of an undirected link other than the roots themselves.

    The root is the least node of a component. Nulls, loops and repeated links are ignored.
    Links are first united inside partitions of about `links_per_task`, like partial sums;
    what is left of several partitions is joined by star steps, in which every node moves to
    the least node near it. The table is written to the shared folder after each round, and
    rounds end when it no longer changes, after about log(longest path) of them.
    """
    edges = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
    )
    edges = common.stage(edges, "links")
    tasks = -(-edges.count() // links_per_task)
    if tasks == 0:
        return edges.toDF("node", "root")
    edges = common.stage(edges.coalesce(tasks).mapInArrow(_within, "u bigint, v bigint"), "united")
    if tasks == 1:
        return edges.toDF("node", "root")
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stage(large, "large")
        low = common.stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        near = large.join(low, "u")
        small = (
            near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = common.stage(small, "small")
        after = _state(edges)
        if after == before:
            return edges.toDF("node", "root")
        before = after
