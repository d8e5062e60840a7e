"""Nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

NEAREST = 20
CODES = 32  # centroids of each half, so at most CODES * CODES cells
SAMPLE = 20_000  # vectors that the centroids are fitted on
TRIALS = 300  # of them, searched to learn how far cells must be followed
RECALL = 0.97  # share of true neighbours that must lie in the cells followed
BLOCK = 1000  # vectors, and queries, compared at once
LEAST = 2000  # candidates of a query at least


def centroids(data: np.ndarray, codes: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's k-means, started from distinct rows chosen far apart."""
    draw = np.random.default_rng(seed)
    unique = np.unique(data, axis=0)
    found = [unique[draw.integers(len(unique))]]
    far = ((unique - found[0]) ** 2).sum(1)
    while len(found) < min(codes, len(unique)):
        found.append(unique[draw.choice(len(unique), p=far / far.sum())])
        far = np.minimum(far, ((unique - found[-1]) ** 2).sum(1))
    centre = np.array(found)
    for _ in range(rounds):
        own = nearest(data, centre)
        size = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, data)
        centre = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], centre)
    return centre


def nearest(data: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1) - 2 * data @ centre.T).argmin(1)


class MultiIndex:
    """Two codebooks, the number of vectors in each cell, and how many candidates a search follows."""

    def __init__(self, sample: np.ndarray, seed: int = 9):
        self.half = max(1, sample.shape[1] // 2)
        self.books = [centroids(part, CODES) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.sizes = np.zeros(self.cells, np.int64)
        self.share = self._share(sample, seed)

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def cell(self, data: np.ndarray) -> np.ndarray:
        one, two = nearest(data[:, : self.half], self.books[0]), nearest(data[:, self.half :], self.books[1])
        return one * len(self.books[1]) + two

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the two halves' inner products with their centroids.

        A heap holds the next pair of each opened row and column; a pair is opened once both
        pairs before it are taken, so each step costs the logarithm of the heap.
        """
        scores = [self.books[0] @ query[: self.half], self.books[1] @ query[self.half :]]
        ranks = [np.argsort(-s, kind="stable") for s in scores]
        one, two = (s[r].tolist() for s, r in zip(scores, ranks, strict=True))
        width = len(two)
        heap, taken = [(-(one[0] + two[0]), 0, 0)], set()
        while heap:
            _, i, j = heapq.heappop(heap)
            taken.add((i, j))
            yield int(ranks[0][i]) * width + int(ranks[1][j])
            if i + 1 < len(one) and (j == 0 or (i + 1, j - 1) in taken):
                heapq.heappush(heap, (-(one[i + 1] + two[j]), i + 1, j))
            if j + 1 < width and (i == 0 or (i - 1, j + 1) in taken):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))

    def _share(self, sample: np.ndarray, seed: int) -> float:
        """Share of all vectors to follow so that RECALL of the sample's true neighbours are met."""
        cells = self.cell(sample)
        sizes = np.bincount(cells, minlength=self.cells)
        needed = []
        for row in np.random.default_rng(seed).permutation(len(sample))[:TRIALS]:
            score = sample @ sample[row]
            score[row] = -np.inf
            best = np.argpartition(-score, min(NEAREST, len(score) - 1))[:NEAREST]
            met, seen = {}, 0
            for cell in self.order(sample[row]):
                seen += sizes[cell]
                met[cell] = seen
            needed += [met[c] for c in cells[best]]
        return float(np.quantile(needed, RECALL)) / len(sample) if needed else 1.0

    def follow(self, query: np.ndarray) -> list[int]:
        """The filled cells to search, nearest first."""
        wanted = max(LEAST, int(np.ceil(self.share * self.sizes.sum())))
        found, seen = [], 0
        for cell in self.order(query):
            if seen >= wanted:
                break
            if self.sizes[cell]:
                found.append(cell)
                seen += self.sizes[cell]
        return found


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, vector and a row number of the rows that take part, repeated ones as often as they come.

    Left out are null keys, null, empty and all-zero vectors, vectors with null or
    non-finite components, and vectors of another length than most have.
    """
    v = F.col("v")
    good = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    length = lengths.first()
    if length is None:
        good = good.where("false")
    else:
        good = good.where(F.size("v") == length["n"])
    return good.withColumn("row", F.monotonically_increasing_id())


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products for rows whose key is divisible by `every`.

    Every row is a candidate but the query's own; rows that repeat a key are rows of their
    own, both as candidates and as queries.

    Codebooks come from at most SAMPLE vectors, chosen by key hash; all vectors are indexed.
    Cells are cut into blocks of about BLOCK vectors by key hash, so a cell of any size is
    spread; queries meet them in blocks. Scores are computed in double precision from the
    original vectors, ties go to the smaller key. See `usable` for rows that take no part;
    fewer than k other vectors are all returned. Other columns are ignored.
    """
    spark = table.sparkSession
    rows = common.stage(usable(table, key, vector), "vectors")
    result = "query_id bigint, rank int, vec_id bigint, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toPandas()
    if len(sample) == 0:
        return spark.createDataFrame([], result)
    model = MultiIndex(np.stack(sample.v.to_numpy()).astype(np.float64))
    coded = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = _matrix(batch.column("v"), batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(coded.value.cell(data).astype(np.int32))], ["row", "vec_id", "v", "cell"]
                )

    index = common.stage(rows.mapInArrow(assign, "row bigint, vec_id bigint, v array<double>, cell int"), "index")
    # at most CODES * CODES rows
    for row in index.groupBy("cell").count().collect():
        model.sizes[row["cell"]] = row["count"]
    sized = spark.sparkContext.broadcast(model)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(sized.value.books[1])
        kind = pa.list_(pa.struct([("line", pa.int32()), ("columns", pa.list_(pa.int32()))]))
        for batch in batches:
            followed = []
            for query in _matrix(batch.column("v"), batch.num_rows):
                lines: dict[int, list[int]] = {}
                for cell in sized.value.follow(query):
                    lines.setdefault(cell // width, []).append(cell % width)
                followed.append([{"line": line, "columns": columns} for line, columns in lines.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(followed, kind)], ["asked", "query_id", "v", "lines"]
            )

    width = len(model.books[1])
    queries = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    probes = common.stage(queries.mapInArrow(probe, "asked bigint, query_id bigint, v array<double>, lines array<struct<line:int,columns:array<int>>>"), "probes")
    # at most CODES rows
    asked = {r["line"]: r["count"] for r in probes.select(F.explode("lines.line").alias("line")).groupBy("line").count().collect()}

    def blocks(counts: dict[int, int]) -> list[int]:
        return [-(-counts.get(line, 0) // BLOCK) or 1 for line in range(len(model.books[0]))]

    # cells with one first centroid travel together, so a query's vector is sent once for all of them
    line = F.floor(F.col("cell") / width).cast("int")
    held = blocks(dict(enumerate(model.sizes.reshape(-1, width).sum(1).tolist())))
    of = lambda sizes: F.element_at(F.lit(sizes), F.col("line") + 1)
    lined = index.select("row", "vec_id", "v", line.alias("line"), (F.col("cell") % width).alias("column"))
    entries = lined.groupBy("line", F.pmod(F.xxhash64("row"), of(held)).cast("int").alias("part")).agg(F.collect_list(F.struct("row", "vec_id", "column", "v")).alias("entries"))
    each = probes.select("asked", "query_id", "v", F.explode("lines").alias("l")).select("asked", "query_id", "v", F.col("l.line").alias("line"), F.col("l.columns").alias("columns"))
    groups = each.groupBy("line", F.pmod(F.xxhash64("asked"), of(blocks(asked))).alias("group")).agg(F.collect_list(F.struct("asked", "query_id", "columns", "v")).alias("queries"))
    spread = groups.select("line", "queries", F.explode(F.sequence(F.lit(0), of(held) - 1)).alias("part"))
    met = spread.join(entries, ["line", "part"]).select("queries", "entries")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                queries, entries = (batch.column(c)[i].values for c in ("queries", "entries"))
                numbers, ids, place = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "column"))
                data, best = _matrix(entries.field("v"), len(entries)), []
                asks = queries.field("asked").to_pylist()
                for ask, columns, vector in zip(asks, queries.field("columns"), _matrix(queries.field("v"), len(queries)), strict=True):
                    open_cells = np.zeros(width, bool)
                    open_cells[columns.values.to_numpy()] = True
                    best.append(_best(ask, vector, numbers, ids, data, open_cells[place], k))
                yield pa.RecordBatch.from_arrays([queries.field("asked"), queries.field("query_id"), pa.array(best, kind)], ["asked", "query_id", "best"])

    found = met.mapInArrow(compare, "asked bigint, query_id bigint, best array<struct<minus:double,vec_id:bigint,row:bigint>>")
    # k rows from each block that a query met
    merged = found.groupBy("asked", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score")
    )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _best(asked: int, vector: np.ndarray, numbers: np.ndarray, ids: np.ndarray, data: np.ndarray, allowed: np.ndarray, k: int) -> list[dict]:
    """The k best of a block's allowed rows, scores summed in one fixed order so that equal vectors tie exactly."""
    rough = data @ vector
    allowed = allowed & (numbers != asked)
    if allowed.sum() > k:
        kept = rough[allowed]
        least = np.partition(kept, len(kept) - k)[len(kept) - k]
        allowed &= rough >= least - 1e-9 * (1 + abs(least))
    near = np.flatnonzero(allowed)
    exact = (np.ascontiguousarray(data[near]) * vector).sum(1)
    order = np.lexsort((numbers[near], ids[near], -exact))[:k]
    return [{"minus": -float(exact[i]), "vec_id": int(ids[near][i]), "row": int(numbers[near][i])} for i in order]
