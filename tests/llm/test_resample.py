"""Importance resampling and its parallel sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import prose

from cindergrid.llm import resample
from cindergrid.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, size=10_000):
    words = words_of(text)
    made = words + [" ".join(p) for p in zip(words, words[1:], strict=False)]
    return [zlib.crc32(m.encode()) % size for m in made]


def naive(docs, target):
    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(buckets_of(text))
    for text in target:
        wanted.update(buckets_of(text))
    all_s, all_t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * float(all_s + 10_000) / ((source[b] + 1) * float(all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for key, text in docs:
        own = buckets_of(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r) for r in rows]


def whole(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_features_are_checksums_of_words_and_pairs():
    texts = ["One two, THREE\x7ffour", "", "é日本 x" + "y" * 500 + " z " + "w" * 64 + " v" * 3, "...", "a", prose(2, 50), "k" * 65 + " " + "k" * 300]
    words, ones, owner, pairs = resample.Features(10_000).of([t.encode() for t in texts])
    at = 0
    for i, text in enumerate(texts):
        assert words[i] == len(words_of(text))
        assert ones[at : at + words[i]].tolist() + pairs[owner == i].tolist() == buckets_of(text)
        at += words[i]


def test_edge_documents(spark, edge_docs, no_docs):
    docs = edge_docs.union(edge_docs.selectExpr("doc_id + 100", *edge_docs.columns[1:])).union(edge_docs.selectExpr("doc_id + 200", *edge_docs.columns[1:]))
    target = spark.createDataFrame([(prose(4, 100),), (None,), ("",), (prose(9, 30),)], "text string")
    rows = resample.resample(docs, target).collect()
    expected = naive([(d.doc_id, d.text) for d in docs.collect()], [t.text for t in target.collect()])
    # repeated keys with equal scores may change places
    alike = lambda rows: whole((*r[:4], r[5]) for r in rows)
    assert alike(rows) == alike(expected)
    drawn = [tuple(r)[:4] for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)]
    assert drawn == [r[:4] for r in sorted((r for r in expected if r[4]), key=lambda r: r[4])]
    assert resample.resample(no_docs, target).collect() == []
    unaimed = resample.resample(docs, no_docs).collect()
    assert alike(unaimed) == alike(naive([(d.doc_id, d.text) for d in docs.collect()], []))


@pytest.mark.parametrize("segments", [1, 2, 7, 64, None])
def test_ranks_are_those_of_one_sort(spark, segments):
    draw = np.random.default_rng(5)
    made = [(int(s), None if k == 7 else int(k), i) for i, (s, k) in enumerate(zip(draw.integers(0, 4, 3000), draw.integers(0, 40, 3000), strict=True))]
    made += [(2, 5, 10_000 + i) for i in range(2000)]  # one key and score holds a large part
    table = spark.createDataFrame(made, "score bigint, doc_id bigint, row bigint").repartition(6, "row")
    order = sorted(made, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for drawn in (0, 1, 1250, 5000):
        rows = resample.ranked(table, drawn, 5000, segments).collect()
        assert len(rows) == 5000
        got = sorted((r["rank"], r.score, r.doc_id, r.row) for r in rows if r["rank"])
        assert got == [(i + 1, *r) for i, r in enumerate(order[:drawn])]


def test_segments_are_even(spark):
    """Regular samples of sorted runs give segments of about equal size, though one key and score holds half of all rows."""
    made = [(0, 1, i) for i in range(5000)] + [(i % 50, i, 5000 + i) for i in range(5000)]
    table = spark.createDataFrame(made, "score bigint, doc_id bigint, row bigint").repartition(8, "row")
    seen = []

    def staged(df, label, real=resample.common.stage):
        out = real(df, label)
        seen.append([r["count"] for r in out.groupBy("segment").count().collect()])
        return out

    before, resample.common.stage = resample.common.stage, staged
    try:
        resample.ranked(table, 10_000, 10_000, 50).count()
    finally:
        resample.common.stage = before
    assert len(seen[0]) == 50 and max(seen[0]) < 2 * 10_000 / 50


def test_query_is_the_naive_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [d.text for d in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = QUERIES["op13_importance_resampling"](spark, sf).collect()
    assert whole(rows) == whole(naive(docs, target))
