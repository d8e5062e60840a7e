"""Every pair of a bucket that holds several components, compared in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.components import united

BLOCK = 256  # members of a bucket that are met at once; a task holds two blocks
COLUMNS = 4096


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `one` has in common with each of `two`; sets are arrays without repeats."""
    out = np.zeros((len(one), len(two)), np.float32)
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s]), len(s)) for s in (one, two)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner, number in sides:
        held = np.isin(values, common)
        column, owner = np.searchsorted(common, values[held]), owner[held]
        order = np.argsort(column, kind="stable")
        placed.append((column[order], owner[order], number))
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        parts = []
        for column, owner, number in placed:
            a, b = np.searchsorted(column, (start, start + width))
            part = np.zeros((number, width), np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _linked(rows: list[dict], marks: Callable, least: float, confirm: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is similar among the pairs of one cell, as few as do."""
    words = [np.frombuffer(r["w"], "<u4").astype(np.uint64) for r in rows]
    sets = [np.unique(marks(w)) for w in words]
    ids, roots, parts, sides = (np.array([r[c] for r in rows], np.int64) for c in ("id", "root", "part", "p"))
    if rows[0]["x"] == rows[0]["y"]:
        i, j = np.arange(len(rows)), np.arange(len(rows))
    else:
        i, j = np.flatnonzero(sides == rows[0]["x"]), np.flatnonzero(sides == rows[0]["y"])
    none = np.zeros(0, np.int64)
    if not len(i) or not len(j):
        return none, none
    counts = shared_counts([sets[n] for n in i], [sets[n] for n in j])
    sizes = np.array([len(s) for s in sets], np.float32)
    total = sizes[i][:, None] + sizes[j][None, :] - counts
    near = (counts / np.maximum(total, 1) >= least - 1e-6) & (roots[i][:, None] != roots[j][None, :]) & (parts[i][:, None] != parts[j][None, :])
    a, b = np.nonzero(near)
    a, b = i[a], j[b]
    if rows[0]["x"] == rows[0]["y"]:
        a, b = a[a < b], b[a < b]
    if confirm is not None:
        # pairs that others already join need no proof
        joined = {int(r): int(r) for r in roots}

        def find(n: int) -> int:
            while joined[n] != n:
                joined[n] = n = joined[joined[n]]
            return n

        kept = []
        for m, n in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(int(roots[m])), find(int(roots[n]))
            if x != y and confirm(words[m], words[n]) >= least:
                joined[max(x, y)] = min(x, y)
                kept.append((m, n))
        a, b = (np.array(side, np.int64) for side in (zip(*kept, strict=True) if kept else ((), ())))
    return united(ids[a], ids[b]) if len(a) else (none, none)


def settled(members: DataFrame, words: DataFrame, marks: Callable, least: float, confirm: Callable | None = None) -> DataFrame:
    """(a, b) links between the members of open buckets whose similarity is at least `least`.

    `members` has key, id, root and part, `words` the id and 32-bit word hashes (w). In a
    bucket every pair of different roots and parts is compared: by the Jaccard similarity of
    the values that `marks` gives for the words, which must bound the one of `confirm`, and
    by that, if it is given. Links join what is linked, not all pairs of it are listed.
    Members of the root that holds most of a bucket only meet the others. Buckets are dealt
    into blocks and each pair of blocks that may hold links is a group of its own, so that no
    task holds a bucket. The number of pairs grows with the members times those outside the
    largest root.
    """
    roots = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("part").alias("t"), F.max("part").alias("u"))
    sizes = roots.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.min("t").alias("t"), F.max("u").alias("u")
    ).where("roots > 1 and t <> u").select(
        "key", F.col("top.root").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("others"),
    )
    placed = members.join(sizes, "key").withColumn("h", F.xxhash64("id", "key")).withColumn("own", F.col("root") == F.col("main"))
    # blocks of the largest root are numbered after those of the others
    placed = placed.withColumn("p", F.when(F.col("own"), F.col("others") + F.pmod("h", "mains")).otherwise(F.pmod("h", "others")).cast("int"))
    each = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("own"), 0).otherwise(F.col("mains")) - 1)))
    cells = each.select("key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "p", "id", "root", "part")
    full = cells.join(words.select("id", "w").hint("merge"), "id").select("key", "x", "y", "p", "id", "root", "part", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        cell = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = _linked(held, marks, least, confirm)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["key"], row["x"], row["y"]) != cell:
                    yield from close()
                    held, cell = [], (row["key"], row["x"], row["y"])
                held.append(row)
        yield from close()

    return full.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a bigint, b bigint")
