"""Text quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

LABELLED_ROWS = 6000  # most labelled rows that a model is fitted on
WORDS = 1 << 14  # buckets of hashed words
BINS = 12
RANK = 8
THRESHOLD = 0.3

CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "bang": b"!", "stop": b".", "comma": b",",
    "bar": b"|", "symbol": b"#$%&*+<=>@\\^_`{}~", "bracket": b"()[]\"'", "line": b"\n", "blank": b" \t", "wide": range(128, 256),
}
STATISTICS = [*CLASSES, "length", "word_length", "fresh_words", "top_word", "fresh_lines", "line_words", "plain_words"]
FEATURES = WORDS + BINS * len(STATISTICS)
MEMBER = np.zeros((len(CLASSES), 256))
for _row, _codes in enumerate(CLASSES.values()):
    MEMBER[_row, list(_codes)] = 1.0
PLAIN = re.compile(r"[^\W\d_]+[.,;:?!]?")


class Buckets(dict):
    """chunk -> bucket of its word, case and outer punctuation ignored, plus WORDS if it is letters only."""

    held = 0

    def __missing__(self, chunk: str) -> int:
        self.held += common.ENTRY_BYTES + len(chunk)
        if self.held > common.CACHE_BYTES:
            self.clear()
            self.held = common.ENTRY_BYTES + len(chunk)
        word = chunk.strip(common.WordHashes.EDGE).lower()
        code = self[chunk] = xxhash.xxh32_intdigest(word) % WORDS + WORDS * bool(PLAIN.fullmatch(chunk))
        return code


def features_of(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text: words scaled to length one, a bin for each statistic."""
    text = text or ""
    chunks = text.split()
    counts = Counter(chunks)
    codes = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    words = codes % WORDS
    times = np.fromiter(counts.values(), np.float64, len(counts))
    often = np.sqrt(times)
    tally = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    shares = (MEMBER @ tally) / max(1, tally.sum())
    lines = text.split("\n")
    n = max(1, len(chunks))
    plain = float(times[codes >= WORDS].sum()) / n
    rest = [
        min(1.0, np.log2(1 + len(text)) / 24), min(1.0, len(text) / n / 30), len(counts) / n, times.max(initial=0) / n,
        len(set(lines)) / len(lines), min(1.0, n / len(lines) / 200), plain,
    ]
    shares = np.concatenate([shares, rest])
    # bins are fine near 0 and near 1
    near = np.minimum(shares, 1 - shares)
    steps = np.minimum(BINS // 2 - 1, np.ceil(np.log2(1 + near * 512) / 1.5)).astype(np.int64)
    bins = np.where(shares <= 0.5, steps, BINS - 1 - steps)
    numbers = np.concatenate([words, WORDS + BINS * np.arange(len(STATISTICS)) + bins])
    values = np.concatenate([often / max(1e-9, np.linalg.norm(often)), np.full(len(STATISTICS), 0.5)])
    return numbers, values


class Machine:
    """Bias, weights and low-rank factors; pairwise terms by the sum-of-squares identity, in linear time."""

    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.factors = np.zeros((FEATURES, RANK)) if factors is None else factors

    def score(self, numbers: np.ndarray, values: np.ndarray) -> float:
        own = self.factors[numbers] * values[:, None]
        pairs = 0.5 * float((own.sum(0) ** 2).sum() - (own * own).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[numbers] @ values + pairs, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> Machine:
    """Log loss by mini-batches with adaptive steps. Without rows: one half for all texts; with one label: its smoothed share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Machine(float(np.log(share / (1 - share))))
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    epochs = int(np.clip(48_000 / len(rows), 8, 40))
    draw = np.random.default_rng(seed)
    model.factors = draw.normal(0, 0.05, (FEATURES, RANK))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-3), np.full((FEATURES, RANK), 1e-3), 1e-3
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        order = draw.permutation(len(rows))
        for begin in range(0, len(order), 64):
            own = order[begin : begin + 64]
            sizes = np.array([len(rows[i][0]) for i in own])
            numbers = np.concatenate([rows[i][0] for i in own])
            values = np.concatenate([rows[i][1] for i in own])
            starts = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(own)), sizes)
            scaled = model.factors[numbers] * values[:, None]
            sums = np.add.reduceat(scaled, starts)
            pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((scaled**2).sum(1), starts))
            raw = model.bias + np.add.reduceat(model.weights[numbers] * values, starts) + pairs
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) / len(own)
            unique, back = np.unique(numbers, return_inverse=True)
            slope_w = np.bincount(back, error[of] * values, len(unique)) + decay * model.weights[unique]
            each = (error[of] * values)[:, None] * (sums[of] - scaled)
            slope_v = np.stack([np.bincount(back, each[:, k], len(unique)) for k in range(RANK)], 1)
            slope_v += decay * model.factors[unique]
            slope_b = error.sum()
            seen_w[unique] += slope_w**2
            seen_v[unique] += slope_v**2
            seen_b += slope_b**2
            model.weights[unique] -= step * slope_w / np.sqrt(seen_w[unique])
            model.factors[unique] -= step * slope_v / np.sqrt(seen_v[unique])
            model.bias -= step * slope_b / np.sqrt(seen_b)
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held_out: int, most: int) -> DataFrame:
    """Features and label of at most `most` labelled texts, those with the least key hashes.

    Rows whose key's checksum is a multiple of `held_out` are never used; neither are null
    keys and labels. Several labels of a key count as their majority, ties as 1.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (common.checksum_rest(key, held_out) != 0))
        .groupBy(F.col(key).cast("bigint").alias("k"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(most)
    )
    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    # at most `most` rows of two numbers are sent to every executor
    found = texts.join(F.broadcast(chosen), "k").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for part, own in common.text_rows(batches, "t"):
            made = [features_of(t, buckets) for t in own]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("k"), part.column("y"), pa.array([m[0].astype("<i4").tobytes() for m in made], "binary"),
                    pa.array([m[1].astype("<f4").tobytes() for m in made], "binary"),
                ],
                ["k", "y", "numbers", "vals"],
            )

    return found.mapInArrow(run, "k bigint, y double, numbers binary, vals binary")


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    held_out: int = 5, most: int = LABELLED_ROWS,
) -> Machine:
    """A machine fitted on the driver to at most `most` labelled texts; only their features travel."""
    rows = labelled_features(docs, labels, key, text, label, held_out, most).toPandas().sort_values("k")
    data = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<f4").astype(np.float64)) for a, b in zip(rows.numbers, rows.vals, strict=True)]
    return fit(data, rows.y.to_numpy(np.float64))


def score_texts(docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for each row, or with `keep` the rows that are not rejected.

    Null and empty texts are scored like any other, by their structure alone. Repeated
    rows have equal scores; null keys stay null and are not held out. With `keep`, all
    columns of the input come back unchanged, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def scores(values: list[str | None], buckets: Buckets, machine: Machine) -> np.ndarray:
        return np.array([machine.score(*features_of(t, buckets)) for t in values], np.float64)

    if keep:

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets, machine = Buckets(), Machine(*shared.value)
            for part, own in common.text_rows(batches, text):
                yield part.filter(pa.array(scores(own, buckets, machine) >= THRESHOLD))

        return docs.mapInArrow(sift, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, machine = Buckets(), Machine(*shared.value)
        for part, own in common.text_rows(batches, "t"):
            found = scores(own, buckets, machine)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.coalesce(common.checksum_rest(key, 5) == 0, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("t"),
    )
    return narrow.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
