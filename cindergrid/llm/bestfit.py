"""Best-fit-decreasing packing into fixed-width matrices of token ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common
from cindergrid.llm.tokens import ChunkIds, default_vocabulary

LENGTH = 4096
BUFFER_TOKENS = 2_000_000  # tokens held at once, but for a longer document

SCHEMA = (
    "sequence_id bigint, n_tokens int, doc_ids array<bigint>, starts array<bigint>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


class Capacities:
    """Open bins by the room they have left; a segment tree finds the smallest room that fits."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the smallest room of at least `need`."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of at most `length`, as lists of item numbers: longest first, each into the tightest bin."""
    tree, bins = Capacities(length), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        found = tree.take(need)
        if found is None:
            found = (length, len(bins))
            bins.append([])
        room, number = found
        bins[number].append(item)
        if room > need:
            tree.add(room - need, number)
    return bins


class Buffer:
    """Pieces waiting for a bin; poorly filled bins wait for the next round."""

    def __init__(self, length: int, pad_id: int, fill: float):
        self.length, self.pad_id, self.fill = length, pad_id, fill
        self.sequence = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0
        self.pieces: list[tuple[int | None, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, key: int | None, ids: np.ndarray) -> list[tuple]:
        for start in range(0, len(ids), self.length):
            self.pieces.append((key, start, ids[start : start + self.length]))
        self.tokens += len(ids)
        return self.flush(False) if self.tokens >= BUFFER_TOKENS else []

    def flush(self, last: bool) -> list[tuple]:
        bins = [[self.pieces[i] for i in items] for items in best_fit([len(p[2]) for p in self.pieces], self.length)]
        sizes = [sum(len(p[2]) for p in own) for own in bins]
        least = 0 if last else self.fill * self.length
        # where more than half of the buffer would wait, the fullest bins go as well
        waiting, kept = sum(n for n in sizes if n < least), set()
        for i in sorted((i for i, n in enumerate(sizes) if n < least), key=lambda i: -sizes[i]):
            if waiting <= BUFFER_TOKENS // 2:
                kept.add(i)
            else:
                waiting -= sizes[i]
        rows = [self.row(own) for i, own in enumerate(bins) if i not in kept]
        self.pieces = [p for i, own in enumerate(bins) if i in kept for p in own]
        self.tokens = waiting
        return rows

    def row(self, own: list[tuple]) -> tuple:
        ends = np.cumsum([0] + [len(p[2]) for p in own])
        ids = np.full(self.length, self.pad_id, "<u4")
        ids[: ends[-1]] = np.concatenate([p[2] for p in own])
        positions = np.zeros(self.length, "<u4")
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        number = self.sequence
        self.sequence += 1
        return (number, int(ends[-1]), [p[0] for p in own], [p[1] for p in own], ends.tolist(), ids.tobytes(), positions.tobytes())


def pack_best_fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    end_id: int = 2,
    pad_id: int = 0,
    fill: float = 0.98,
) -> DataFrame:
    """One row per sequence: a padded row of ids, the segments' cumulative lengths and positions that restart.

    Documents longer than `length` are split without loss; the pieces are packed longest
    first into the bin with the least room that fits. Each partition packs its own
    documents, BUFFER_TOKENS at a time, without a shuffle; bins filled below `fill` wait for
    the next round, the emptiest first and half a buffer of them at most. `input_ids` and `position_ids` hold `length` little-endian unsigned
    32-bit numbers, `cu_seqlens` starts at 0 and ends at `n_tokens`.

    A null text is an empty one, and an empty text is the end id alone. A null key stays
    null in `doc_ids`; repeated rows are packed as often as they come. No rows in, no rows
    out. Other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    types = [
        pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
    ]
    names = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, buffer, end = ChunkIds(path), Buffer(length, pad_id, fill), np.array([end_id], "<u4")

        def batch(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for part, texts in common.text_rows(batches, "t"):
            rows = []
            for number, own in zip(part.column("k").to_pylist(), texts, strict=True):
                rows += buffer.add(number, np.concatenate([chunks.ids(own), end]))
            if rows:
                yield batch(rows)
        if rows := buffer.flush(True):
            yield batch(rows)

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return narrow.mapInArrow(run, SCHEMA)


def unpack(rows: DataFrame) -> DataFrame:
    """The documents' ids again, a row per piece: doc_id, start, ids_crc32, n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["input_ids"], "<u4")
                for key, start, a, b in zip(row["doc_ids"], row["starts"], row["cu_seqlens"], row["cu_seqlens"][1:], strict=False):
                    out.append((key, start, zlib.crc32(ids[a:b].tobytes()), b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "ids_crc32", "n_ids"])

    return rows.select("doc_ids", "starts", "cu_seqlens", "input_ids").mapInArrow(run, "doc_id bigint, start bigint, ids_crc32 bigint, n_ids bigint")
