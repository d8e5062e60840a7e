"""Order-preserving packing of documents into token sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common
from cindergrid.llm.tokens import ChunkIds, default_vocabulary

LENGTH = 4096
END = 2
BLOCK_TOKENS = 2_000_000  # tokens held at once, but for a longer document
GRID = 32  # cuts offered inside text without sentence ends

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def cut_points(lengths: list[int], ids: np.ndarray, ends: np.ndarray, sentence: float, truncation: float):
    """Positions where a window may end, and what a cut there costs.

    Document ends cost nothing, sentence ends `sentence`; where neither comes for
    GRID tokens, cuts inside a sentence are offered at `truncation`.
    """
    documents = np.cumsum(np.asarray(lengths, np.int64))
    sentences = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    natural = np.union1d(documents, sentences)
    before = np.concatenate([[0], natural[:-1]])
    extra = (natural - before - 1) // GRID
    rank = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    inside = np.repeat(before, extra) + (rank + 1) * GRID
    points = np.concatenate([natural, inside])
    costs = np.concatenate([np.full(len(natural), float(sentence)), np.full(len(inside), float(truncation))])
    order = np.argsort(points, kind="stable")
    points, costs = points[order], costs[order]
    costs[np.searchsorted(points, documents)] = 0.0
    return points, costs


def windows(points: np.ndarray, costs: np.ndarray, length: int) -> list[int]:
    """Ends of the windows that cover 0..points[-1] at the least padding plus cut penalties.

    With best[j] = min over i in reach of best[i] + (length - points[j] + points[i]) + costs[j],
    the bracket best[i] + points[i] does not depend on j: a monotone queue holds it, and each
    point enters and leaves once.
    """
    where, came = [0, *points.tolist()], [0] * (len(points) + 1)
    queue = deque([(0.0, 0)])
    for j, cost in enumerate(costs.tolist(), 1):
        reach = where[j] - length
        while where[queue[0][1]] < reach:
            queue.popleft()
        least, came[j] = queue[0]
        value = least + length + cost
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(points)
    while j:
        out.append(where[j])
        j = came[j]
    return out[::-1]


class Packer:
    """Packs one partition's documents in their order; holds one block of tokens."""

    def __init__(self, length: int, ends: np.ndarray, sentence: float, truncation: float, with_ids: bool):
        self.length, self.ends, self.sentence, self.truncation = length, ends, sentence, truncation
        self.with_ids = with_ids
        self.sequence = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0
        self.held: list[tuple[int | None, int, int, np.ndarray]] = []  # key, start, tokens of the document, ids
        self.tokens = 0

    def add(self, key: int | None, ids: np.ndarray) -> list[tuple]:
        self.held.append((key, 0, len(ids), ids))
        self.tokens += len(ids)
        return self.flush(False) if self.tokens >= BLOCK_TOKENS else []

    def flush(self, last: bool) -> list[tuple]:
        """The pieces of all windows; before the last block the unfinished window is kept."""
        if not self.held:
            return []
        ids = np.concatenate([item[3] for item in self.held])
        ends = windows(*cut_points([len(i[3]) for i in self.held], ids, self.ends, self.sentence, self.truncation), self.length)
        if not last:
            ends = ends[:-1]
        out, rest, at, k, begin = [], [], 0, 0, 0
        for key, start, total, own in self.held:
            done = 0
            while done < len(own):
                while k < len(ends) and ends[k] <= at:
                    begin, k = ends[k], k + 1
                    self.sequence += 1
                if k == len(ends):
                    rest.append((key, start + done, total, own[done:]))
                    at += len(own) - done
                    break
                take = min(len(own) - done, ends[k] - at)
                piece = own[done : done + take].tobytes()
                row = (key, start + done, take, zlib.crc32(piece), total, self.sequence, at - begin)
                out.append((*row, piece) if self.with_ids else row)
                done, at = done + take, at + take
        if k < len(ends):
            self.sequence += 1
        self.held, self.tokens = rest, sum(len(item[3]) for item in rest)
        return out


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    end_id: int = END,
    sentence_penalty: float = 4.0,
    truncation_penalty: float = 48.0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens, in the order of the rows.

    Each partition of the input is packed where it lies, without a shuffle. Windows end at
    document ends, sentence ends or, at a higher price, inside a sentence; dynamic
    programming picks the cuts with the least padding plus penalties. Every id lies in
    exactly one piece. `offset` counts within the sequence, which has no gaps.

    A null text is an empty one, and an empty text is the end id alone. A null key stays
    null; repeated rows and keys are packed as often as they come. Texts of any length are
    cut losslessly. No rows in, no rows out. Other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    types = ["int64"] * 7 + (["binary"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkIds(path)
        names = [part.split()[0] for part in SCHEMA.split(", ")] + ["ids"] * with_ids
        packer = Packer(length, chunks.sentence_ends(), sentence_penalty, truncation_penalty, with_ids)
        end = np.array([end_id], "<u4")

        def batch(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for part, texts in common.text_rows(batches, "t"):
            rows = []
            for number, own in zip(part.column("k").to_pylist(), texts, strict=True):
                rows += packer.add(number, np.concatenate([chunks.ids(own), end]))
            if rows:
                yield batch(rows)
        if rows := packer.flush(True):
            yield batch(rows)

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return narrow.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
