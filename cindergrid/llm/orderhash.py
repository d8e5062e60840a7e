"""Near-duplicates by order MinHash over word shingles, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import blocks, common
from cindergrid.llm.components import components

WIDTH = 5  # words in a shingle
SIMILARITY = 0.8
SKETCHES = 20
PICKED = 4  # least shingles of a sketch, kept in text order


def labelled(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Shingle hashes made unique: each carries how often it came before in the text."""
    found = common.shingles(words, width)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(fresh)
    count = np.empty(len(found), np.uint64)
    count[order] = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    return found + count * np.uint64(0x9E3779B97F4A7C15)


def sketches(marks: np.ndarray, number: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """A key for each sketch: its least shingles under a hash function of its own, in text order."""
    if len(marks) == 0:
        return np.zeros(0, np.int64)
    keys = np.empty(number, np.uint64)
    for i in range(number):
        values = common.mix(marks, i)
        at = np.argpartition(values, picked - 1)[:picked] if len(values) > picked else np.arange(len(values))
        at.sort()
        key = np.uint64(i + 1)
        for mark in marks[at]:
            key = np.uint64(((int(key) ^ int(mark)) * 0x9E3779B97F4A7C15) % 2**64)
            key ^= key >> np.uint64(31)
        keys[i] = key
    return keys.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, width: int = WIDTH, least: float = SIMILARITY) -> float:
    """Share of shingles that stand in the same order in both texts, of all shingles of either.

    Occurrence-labelled shingles are unique, so the longest common subsequence is the longest
    increasing run of matched places. Places further apart than texts of the wanted
    similarity can shift lie outside the band.
    """
    one, two = labelled(a, width), labelled(b, width)
    if min(len(one), len(two)) < least * max(len(one), len(two)):
        return 0.0
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    total = len(one) + len(two)
    needed = least / (1 + least) * total
    band = total - 2 * needed + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < needed - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (j[1:] > j[:-1]).all():
        tails: list[int] = []
        for place in j.tolist():
            k = bisect_left(tails, place)
            tails[k : k + 1] = [place]
        shared = len(tails)
    else:
        shared = len(j)
    return shared / (total - shared)


def _sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, hash of the words in two numbers (null for a null text), and the sketch keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for part, own in common.text_rows(batches, "t"):
            high, low, keys = [], [], []
            for t in own:
                words = hashes.of(t) if t is not None else None
                if words is None:
                    high.append(None), low.append(None), keys.append(None)
                    continue
                # texts without words are copies of each other only if they are equal
                digest = xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"text:" + t.encode("utf-8", "replace"))
                high.append(int.from_bytes(digest[:8], "big", signed=True))
                low.append(int.from_bytes(digest[8:], "big", signed=True))
                keys.append(sketches(labelled(words)))
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array(high, "int64"), pa.array(low, "int64"), pa.array(keys, pa.list_(pa.int64()))],
                ["k", "high", "low", "keys"],
            )

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null")
    return narrow.mapInArrow(run, "k bigint, high bigint, low bigint, keys array<bigint>")


def _words(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id and 32-bit word hashes of the wanted texts, one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for part, own in common.text_rows(batches, "t"):
            found = [(hashes.of(t or "") >> np.uint64(32)).astype("<u4").tobytes() for t in own]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, "binary")], ["id", "words"])

    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    # the list grows with the corpus, so it is merged, not broadcast
    return texts.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(run, "id bigint, words binary").dropDuplicates(["id"])


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(w.as_py(), "<u4").astype(np.uint64) for w in batch.column(c)] for c in ("one", "two"))
            keep = pa.array([aligned(x, y) >= SIMILARITY for x, y in zip(one, two, strict=True)])
            yield batch.select(["a", "b"]).filter(keep)

    with_two = pairs.join(words.select(F.col("id").alias("b"), F.col("words").alias("two")), "b")
    with_both = with_two.join(words.select(F.col("id").alias("a"), F.col("words").alias("one")), "a")
    return with_both.select("a", "b", "one", "two").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row with a key; the class is its least doc_id.

    Texts with the same words in the same order (case and outer punctuation ignored) are
    copies and are represented by the least id. Representatives that share an order-MinHash
    key are compared with the bucket's pivot, the member that shares most keys with others:
    of copies of one original, the original itself. In buckets that then hold several
    components, members outside the next pivot's, drawn by hash, are compared with it, until
    a round finds no link; then all pairs of different components that are left in a bucket
    are compared, in blocks, so that every bucket ends settled and none is capped. Links
    are pairs whose banded alignment keeps at least 0.8 of their five-word shingles; classes
    are their connected components.

    A null text is a class of its own, as is a text with fewer than five words but for equal
    ones; texts without words are copies only if equal. Rows with a null key are left out.
    Repeated rows come back as often. No rows in, no rows out. Other columns are ignored.
    """
    rows = common.stage(_sketch(docs, key, text), "sketches")
    copies = common.stage(
        rows.where("high is not null").groupBy("high", "low").agg(F.min("k").alias("rep")), "copies"
    )
    own = common.stage(
        rows.join(copies, ["high", "low"]).select("k", "rep", F.when(F.col("k") == F.col("rep"), F.col("keys")).alias("keys")),
        "members",
    )
    kept = common.stage(own.where("keys is not null").select("k", "keys").dropDuplicates(["k"]), "representatives")
    keyed = kept.select(F.col("k").alias("id"), F.explode("keys").alias("key"))
    sizes = common.stage(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = common.stage(keyed.join(sizes, "key"), "shared")
    # a member has at most SKETCHES keys; every member starts as the root of its own component
    members = shared.groupBy("id").agg(F.sum("size").alias("degree"), F.collect_list("key").alias("keys"))
    members = common.stage(members.withColumn("root", F.col("id")), "open")
    words = common.stage(_words(docs, key, text, members.select("id")), "words")
    links, roots, tried, number = None, None, None, 0
    while True:
        each = members.select("id", "degree", "root", F.explode("keys").alias("key"))
        rank = F.col("degree") if number == 0 else F.xxhash64("id", "key", F.lit(number))
        top = F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("minus"), "root")).alias("top")
        # a bucket whose members are all in one component is settled and has no pivot
        pivots = each.groupBy("key").agg(top, F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        pivots = common.stage(pivots.select("key", (-F.col("top.minus")).alias("pivot"), F.col("top.root").alias("pivot_root")), "pivots")
        done = pivots.select("key", F.col("pivot").alias("id"))
        tried = done if tried is None else tried.union(done)
        met = each.join(pivots, "key").where("root <> pivot_root")
        pairs = met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        found = common.stage(_verified(pairs, words), "verified")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        roots, number = components(links), number + 1
        members = members.drop("root").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        members = common.stage(members.withColumn("root", F.coalesce("root", "id")), "placed")
    # a pivot has met its whole bucket; what no pivot has joined is compared with each other
    rest = members.select("id", "root", F.col("id").alias("part"), F.explode("keys").alias("key"))
    rest = common.stage(rest.join(tried.distinct(), ["key", "id"], "left_anti"), "unsettled")
    more = blocks.settled(rest, words.withColumnRenamed("words", "w"), labelled, SIMILARITY, aligned)
    more = common.stage(more, "settled")
    if not more.isEmpty():
        roots = components(more if links is None else links.union(more))
    place = F.col("rep")
    members = own.select("k", "rep")
    if roots is not None:
        members = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        place = F.coalesce("root", "rep")
    grouped = members.select(F.col("k").alias("doc_id"), place.alias("class_id"))
    alone = rows.where("high is null").select(F.col("k").alias("doc_id"), F.col("k").alias("class_id"))
    return grouped.union(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is the least of its class, with all their columns.

    Rows with a null key are kept. Rows that repeat a kept key all stay: they are one
    document to this operator.
    """
    found = near_duplicates(docs, key, text)
    gone = common.stage(found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col(key).cast("bigint") == F.col("__gone"), "left_anti")
