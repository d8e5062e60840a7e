"""Importance resampling towards a target distribution; the draw is a parallel sort by regular sampling."""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cindergrid.llm import common

BUCKETS = 10_000
LEAST_WORDS = 20
SEGMENT_ROWS = 500_000  # rows of a segment, about
SEGMENTS = 20_000  # of them at most; their bounds are broadcast
SAMPLES = 200_000  # regular samples at most, sorted on the driver for the bounds
SHORT = 64  # bytes of a word whose checksum is cached; longer ones are summed each time
CACHED = 300_000  # words of at most SHORT bytes, so some 50 MB
WORDS = 1_000_000  # words of short texts that are scored together, about

#: Bytes that separate words become blanks, A-Z become a-z.
FORM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def _byte_steps() -> np.ndarray:
    """What a zero byte does to each low byte of a checksum."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


STEP = _byte_steps()


def _shifts() -> np.ndarray:
    """For 0 to SHORT further bytes and each of a checksum's four bytes: what becomes of it."""
    made = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for byte in range(4):
        made[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(SHORT):
        made[n + 1] = STEP[made[n] & 255] ^ (made[n] >> np.uint32(8))
    return made


SHIFT = _shifts()


class WordSums(dict):
    """word -> its crc32, with its length in the upper half."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | len(word) << 32
        if len(word) <= SHORT:
            if len(self) >= CACHED:
                self.clear()
            self[word] = value
        return value


class Features:
    """Buckets of all words and word pairs of some texts."""

    def __init__(self, buckets: int):
        self.buckets, self.sums = buckets, WordSums()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; the bucket of each word; which text each pair is of, and its bucket."""
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.translate(FORM).split()
            counts[i] = len(own)
            words += own
        value = np.fromiter(map(self.sums.__getitem__, words), np.uint64, len(words))
        crc, length = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32), (value >> np.uint64(32)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        left = np.flatnonzero(owner[1:] == owner[:-1])
        # the checksum of two joined strings is the first's, carried over the second's length, plus the second's
        held = ~crc[left]
        blank = ~(STEP[(held ^ np.uint32(32)) & 255] ^ (held >> np.uint32(8)))
        size = np.minimum(length[left + 1], SHORT)
        pair = crc[left + 1]
        for byte in range(4):
            pair = pair ^ SHIFT[size, byte, (blank >> np.uint32(8 * byte)) & 255]
        for i in np.flatnonzero(length[left + 1] > SHORT).tolist():
            pair[i] = zlib.crc32(words[left[i] + 1], int(blank[i]))
        return counts, (crc % np.uint32(self.buckets)).astype(np.int64), owner[left], (pair % np.uint32(self.buckets)).astype(np.int64)

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Rows with their texts as bytes, a bounded number of bytes at a time but for a longer text."""
        for batch in batches:
            texts = batch.column("t")
            start, held = 0, 0
            for row in range(batch.num_rows):
                held += texts[row].as_buffer().size if texts[row].is_valid else 0
                if held > 6 * WORDS or row == batch.num_rows - 1:
                    part = batch.slice(start, row + 1 - start)
                    yield part, [t or b"" for t in part.column("t").to_pylist()]
                    start, held = row + 1, 0


def bucket_counts(table: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; `buckets` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for _, texts in features.parts(batches):
            _, ones, _, pairs = features.of(texts)
            total += np.bincount(ones, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    counted = table.select(F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much commoner each bucket is in the target, both smoothed by one."""
    size = float(len(target))
    t, s, all_t, all_s = target.astype(np.float64), source.astype(np.float64), float(target.sum()), float(source.sum())
    ratio = (t + 1) * (all_s + size) / ((s + 1) * (all_t + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", salt: str = "7") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and a row number of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = sent.value
        features, number = Features(len(array)), TaskContext.get().partitionId() << 33
        for part, texts in features.parts(batches):
            words, ones, owner, pairs = features.of(texts)
            total = np.zeros(len(texts) + 1, np.int64)
            np.cumsum(words, out=total[1:])
            running = np.concatenate([[0], np.cumsum(array[ones])])
            summed = running[total[1:]] - running[total[:-1]]
            np.add.at(summed, owner, array[pairs])
            n = np.maximum(2 * words - 1, 0)
            weight = np.where(n > 0, summed // np.maximum(n, 1), 0)
            keys = part.column("k").to_pylist()
            score = weight + np.array([noise(k, salt) for k in keys], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), *(pa.array(c) for c in (words, n, weight, score, np.arange(number, number + len(texts))))],
                ["doc_id", "n_words", "n_features", "weight", "score", "row"],
            )
            number += len(texts)

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return narrow.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint, row bigint")


def noise(key: int | None, salt: str) -> int:
    """floor(1000 g) for a Gumbel draw g fixed by the key."""
    drawn = int(hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def _order() -> list:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def _keys(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Sort keys of rows; no two are equal, as each row has a number of its own."""
    for score, key, row in zip(*(batch.column(c).to_pylist() for c in ("score", "doc_id", "row")), strict=True):
        yield (-score, key is None, key or 0, row)


def ranked(rows: DataFrame, drawn: int, size: int, segments: int | None = None) -> DataFrame:
    """The rows with `rank`: 1, 2, 3... by falling score for the first `drawn`, null for the others.

    Each partition is sorted for itself and gives regular samples of its run; the samples,
    sorted, give the bounds of segments. Rows are counted per segment where they lie, and
    only segments that hold drawn rows are exchanged and sorted, each in a task of its own.
    A row's rank is its place in its segment plus the rows of the segments before. `rows`
    is read twice and must give the same rows each time.
    """
    spark = rows.sparkSession
    if size == 0 or drawn == 0:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    if segments is None:
        # many more than tasks, so that a hash deals them evenly
        segments = max(-(-size // SEGMENT_ROWS), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    segments = max(1, min(segments, size, SEGMENTS))
    stride = max(1, size // min(SAMPLES, 16 * segments))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange((stride // 2 - passed) % stride, batch.num_rows, stride)))
            passed += batch.num_rows

    narrow = rows.select("score", "doc_id", "row")
    runs = narrow.sortWithinPartitions(*_order())
    # at most about SAMPLES rows and one for each run
    taken = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["row"]) for r in runs.mapInArrow(sample, narrow.schema).collect())
    bounds = [taken[i * len(taken) // segments] for i in range(1, segments)] if taken else []
    sent = spark.sparkContext.broadcast(sorted(set(bounds)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = sent.value
        for batch in batches:
            own = np.fromiter((bisect_right(limits, key) for key in _keys(batch)), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "segment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = common.stage(rows.mapInArrow(deal, f"{schema}, segment int"), "segments")
    # at most SEGMENTS rows
    held = sorted((r["segment"], r["count"]) for r in dealt.groupBy("segment").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in held])]).tolist()
    offsets = [(segment, start) for (segment, _), start in zip(held, before, strict=False) if start < drawn]
    last = offsets[-1][0]
    placed = spark.createDataFrame(offsets, "segment int, before bigint")
    within = F.row_number().over(Window.partitionBy("segment").orderBy(*_order()))
    first = dealt.where(F.col("segment") <= last).withColumn("place", within).join(F.broadcast(placed), "segment")
    rank = F.col("before") + F.col("place")
    names = rows.columns
    return first.select(*names, F.when(rank <= drawn, rank).alias("rank")).unionByName(
        dealt.where(F.col("segment") > last).select(*names, F.lit(None).cast("bigint").alias("rank"))
    )


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    share: tuple[int, int] = (25, 100), least_words: int = LEAST_WORDS, buckets: int = BUCKETS, salt: str = "7",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row; a null rank is not drawn.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII,
    A-Z lowered; features are the words and the pairs of consecutive ones, hashed by crc32
    into `buckets`. A bucket's gain compares its smoothed share of the target's features
    with that of all docs; a weight is the floored mean gain of a row's features, 0 without
    any. The score adds a Gumbel draw fixed by salt and key (a null key as an empty one).
    Of the N rows with `least_words` words or more the floor(share * N) with the highest
    scores are drawn; ties go to the smaller key, null keys last, and among repeated keys
    to the row that was read first.

    Null and empty texts have no features and are never drawn. An empty target has gains
    by rarity in the docs alone. Repeated rows count and are ranked each; other columns are
    ignored; empty docs give no rows. Texts are read twice and never shuffled; what is
    sorted is a few numbers for each row.
    """
    gain = gains(bucket_counts(target, target_text, buckets), bucket_counts(docs, text, buckets))
    found = common.stage(scores(docs, gain, key, text, salt), "scores")
    able = found.where(F.col("n_words") >= least_words)
    size = able.count()
    done = ranked(able, share[0] * size // share[1], size)
    rest = found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return done.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
