"""Exact integer k-means whose assignments come from a vantage-point tree over the centroids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

LEAF = 2  # centroids of a leaf at most
LIMIT = 2**60  # components of this size or more take no part
LARGEST = 2**63 - 1
CENTROIDS = 100_000  # they are broadcast in each round, and their sums are collected
CELLS = 1_000_000  # vectors x nodes held at once


def is_wide(data: np.ndarray) -> bool:
    """Whether squared distances of such vectors may need more than 63 bits; they are then computed with Python integers."""
    return int(np.abs(data).max(initial=0)) >= math.isqrt(2**62 // max(1, data.shape[1])) // 2


def squared(data: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = data - point
    return (gap * gap).sum(axis=1)


class VantageTree:
    """Centroids split by their distance to one of them, again and again.

    An inner node holds a vantage centroid and, for each child, the least and the largest
    distance of its centroids to it. A leaf holds at most LEAF centroids.
    """

    def __init__(self, centres: np.ndarray):
        self.wide = is_wide(centres)
        self.centres = centres.astype(object) if self.wide else centres.astype(np.int64)
        self.members: list[np.ndarray] = []  # of leaves; the vantage alone for inner nodes
        self.children: list[list[tuple[int, float, float]]] = []
        self._grow(np.arange(len(centres)))

    def _grow(self, own: np.ndarray) -> None:
        waiting = [(own, None, 0.0, 0.0)]
        while waiting:
            own, parent, low, high = waiting.pop()
            node = len(self.members)
            self.children.append([])
            if parent is not None:
                self.children[parent].append((node, low, high))
            if len(own) <= LEAF:
                self.members.append(own)
                continue
            # a point at the rim separates better than one in the middle
            rim = own[squared(self.centres[own], self.centres[own[0]]).argmax()]
            rest = own[own != rim]
            far = np.sqrt(squared(self.centres[rest], self.centres[rim]).astype(np.float64))
            order = np.argsort(far, kind="stable")
            self.members.append(np.array([rim]))
            for part in np.array_split(order, 2):
                if len(part):
                    waiting.append((np.sort(rest[part]), node, float(far[part].min()), float(far[part].max())))

    def nearest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest centroid, the smaller of equally near ones, and the squared distance.

        Each vector opens the node with its least possible distance next and stops when none
        is within its best distance; nodes at exactly that distance are opened, as they may
        hold a smaller number. The vectors of a batch take their steps together.
        """
        if self.wide or is_wide(data):
            data = data.astype(object)
        step = max(1, CELLS // len(self.members))
        found = [self._search(data[i : i + step]) for i in range(0, len(data), step)]
        return tuple(np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        least = np.full((n, len(self.members)), np.inf)  # possible distance to what an open node holds
        least[:, 0] = 0.0
        which = np.full(n, len(self.centres), np.int64)
        best = np.full(n, LARGEST, data.dtype)
        if data.dtype == object:
            best[:] = 2**140
        active = np.arange(n)
        while len(active):
            node = least[active].argmin(axis=1)
            bound = least[active, node]
            radius = np.sqrt(best[active].astype(np.float64))
            still = bound <= radius  # inclusive
            active, node = active[still], node[still]
            for number in np.unique(node).tolist():
                rows = active[node == number]
                low = least[rows, number]
                least[rows, number] = np.inf
                for centre in self.members[number].tolist():
                    far = squared(data[rows], self.centres[centre])
                    nearer = (far < best[rows]) | ((far == best[rows]) & (centre < which[rows]))
                    best[rows[nearer]], which[rows[nearer]] = far[nearer], centre
                if self.children[number]:
                    reach = np.sqrt(far.astype(np.float64))
                    for child, inner, outer in self.children[number]:
                        slack = 1e-9 * (reach + outer)  # roots are rounded
                        least[rows, child] = np.maximum(low, np.maximum(inner - reach, reach - outer) - slack)
        return which, best


def kept_vectors(table: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and v, the components as integers floor(scale * x), of the rows that take part."""
    v = F.col("v")
    good = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size("v") == dimensions)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / scale))
    )
    return good.select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _rows(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def vantage_clusters(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10,
    dimensions: int = 64, scale: int = 1024, salt: str = "3",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors of another length than `dimensions`, null ones and those with null, non-finite
    or huge components (LIMIT after scaling) take no part. Components become floor(scale *
    x). The k rows with the smallest sha256 of `salt:key` start as centroids 0, 1, ...; among
    equal hashes (repeated keys) the smaller vector comes first, and null keys come last.
    Fewer vectors than k give fewer centroids. In each round every vector goes to the
    nearest centroid by squared distance (ties: the smaller number) and every centroid with
    vectors becomes the floor of their mean; then vectors are assigned once more. All
    numbers are exact; a distance or sum beyond 63 bits is null.

    A row of the table is a row of the result: repeated keys and vectors count as often as
    they come, a null key stays null, other columns are ignored, an empty table gives none.

    A round is one pass over the integer vectors, which are written once. The tree over the
    centroids (at most CENTROIDS of them) is broadcast; tasks return sums per centroid and
    component, so what is shuffled and collected grows with k and not with a cluster's size.
    """
    if not 1 <= k <= CENTROIDS:
        raise ValueError(f"k must be from 1 to {CENTROIDS}")
    spark = table.sparkSession
    rows = common.stage(kept_vectors(table, key, vector, dimensions, scale), "integers")
    first = rows.select("v", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    # at most k rows
    start = [r["v"] for r in first.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]
    result = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], result)
    centres = np.array(start, np.int64)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(VantageTree(centres))

        def totals(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            size = np.zeros(len(tree.centres), np.int64)
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                data = _rows(batch.column("v"), batch.num_rows)
                own, _ = tree.nearest(data)
                size += np.bincount(own, minlength=len(size))
                exact = data.astype(object) if is_wide(data) else data
                for cluster in np.unique(own).tolist():
                    # a batch's sum fits 64 bits, a partition's need not
                    total[cluster] = total.get(cluster, 0) + exact[own == cluster].sum(axis=0).astype(object)
            if total:
                width = len(next(iter(total.values())))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(list(total), width).astype(np.int32)),
                        pa.array(np.tile(np.arange(width), len(total)).astype(np.int32)),
                        pa.array(np.repeat([size[c] for c in total], width).astype(np.int64)),
                        pa.array([Decimal(int(x)) for sums in total.values() for x in sums], pa.decimal128(38, 0)),
                    ],
                    ["cluster", "place", "n", "total"],
                )

        partial = rows.mapInArrow(totals, "cluster int, place int, n bigint, total decimal(38,0)")
        # k x dimensions rows
        for r in partial.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            centres[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        sent.destroy()

    sent = spark.sparkContext.broadcast(VantageTree(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = sent.value.nearest(_rows(batch.column("v"), batch.num_rows)) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own, pa.int32()), pa.array([int(d) if d <= LARGEST else None for d in far], pa.int64())],
                ["vec_id", "cluster", "distance"],
            )

    assigned = common.stage(rows.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    summed = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("*") == F.count("distance")).alias("whole")
    )
    # at most k rows
    own = {r["cluster"]: int(r["total"]) if r["whole"] else LARGEST + 1 for r in summed.collect()}
    fits = lambda total: total if total <= LARGEST else None
    inertia = fits(sum(own.values()))
    digest = {c: hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest() for c in own}
    about = spark.createDataFrame(
        [(c, fits(total), inertia, digest[c]) for c, total in own.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """DuckDB SQL for the rows of `vantage_clusters` over the table `embeddings`."""

    def nearest(number: int) -> str:
        return f"""a{number} AS MATERIALIZED (
  SELECT id, vec_id, v, MIN({{'d': d, 'c': c}}) AS near FROM (
    SELECT i.id, i.vec_id, i.v, m.c,
      list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(i.v, m.v)])::BIGINT AS d
    FROM ints i CROSS JOIN c{number} m) GROUP BY id, vec_id, v)"""

    parts = [
        f"""ints AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER () AS id, vec_id, [CAST(FLOOR({scale} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dimensions}
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS c, v FROM ints
  ORDER BY sha256('{salt}:' || vec_id), v LIMIT {k})""",
    ]
    for number in range(rounds):
        parts += [
            nearest(number),
            f"""s{number} AS (
  SELECT c, list(m ORDER BY p) AS v FROM (
    SELECT near.c AS c, p, CAST(FLOOR(SUM(v[p]) / COUNT(*)) AS BIGINT) AS m
    FROM a{number}, (SELECT UNNEST(range(1, {dimensions + 1})) AS p) GROUP BY ALL) GROUP BY c)""",
            f"""c{number + 1} AS MATERIALIZED (
  SELECT o.c, COALESCE(n.v, o.v) AS v FROM c{number} o LEFT JOIN s{number} n ON n.c = o.c)""",
        ]
    parts.append(nearest(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(near.c AS INTEGER) AS cluster, near.d AS distance,
  CAST(SUM(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(SUM(near.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.near.c
"""
