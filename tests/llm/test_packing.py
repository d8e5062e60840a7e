"""Order-preserving and best-fit packing."""

import random
import zlib

import numpy as np
import pytest

from cindergrid.llm import bestfit, packing
from cindergrid.llm.queries import QUERIES
from cindergrid.llm.tokens import ChunkIds, default_vocabulary


@pytest.fixture(scope="module")
def chunks():
    return ChunkIds(default_vocabulary(), entries=50)


ODD = [
    "Ça va? L'été d'Élan's don't 12a3 ŉ İstanbul ΣΑΣ ab-cd... x.y,z!!  tab\x1cq <|endoftext|> ﬁ ǅ aΣ, ² ½ 한국어.", "", "a b́",
    "ß.", "Ⅷ ⅷ. ªº", "naïve's", "THE'S,", "..a", "3.14, 1,000", "a.b,c d.", "ABC., x_.", "don't. 'S, it's,x'll.", "́x a", " a b\x85c",
]


@pytest.mark.parametrize("text", ODD)
def test_cached_ids_are_the_tokenizers(chunks, text):
    assert chunks.ids(text).tolist() == chunks.whole(text)


@pytest.mark.parametrize("seed", range(20))
def test_windows_are_the_cheapest(seed):
    draw = random.Random(seed)
    points = np.cumsum([draw.randint(1, 9) for _ in range(40)])
    costs = np.array([draw.choice([0.0, 3.0, 20.0]) for _ in points])
    length = 20
    ends = packing.windows(points, costs, length)
    where, best = [0, *points.tolist()], [0.0] + [float("inf")] * len(points)
    for j in range(1, len(where)):
        for i in range(j):
            if where[j] - where[i] <= length:
                best[j] = min(best[j], best[i] + length - where[j] + where[i] + costs[j - 1])
    price = dict(zip(points.tolist(), costs, strict=True))
    assert sum(length - (b - a) + price[b] for a, b in zip([0, *ends], ends, strict=False)) == pytest.approx(best[-1])
    assert all(b - a <= length for a, b in zip([0, *ends], ends, strict=False)) and ends[-1] == points[-1]


def check_pieces(rows, docs, chunks, length=4096):
    whole = {}
    for r in docs:
        whole.setdefault(r.doc_id, []).append([*chunks.whole(r.text or ""), 2])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert any(zlib.crc32(np.array(w[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(w) == r.doc_tokens for w in whole[r.doc_id])
    for key, own in by_doc.items():
        assert sum(r.length for r in own) == sum(map(len, whole[key]))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= length
    return by_sequence


def test_pieces_of_edge_documents(edge_docs, no_docs, chunks):
    check_pieces(packing.pack_documents(edge_docs).collect(), edge_docs.collect(), chunks)
    check_pieces(packing.pack_documents(edge_docs, length=64).collect(), edge_docs.collect(), chunks, 64)
    assert packing.pack_documents(no_docs).count() == 0


def test_blocks_do_not_break_sequences(edge_docs, chunks):
    ends = chunks.sentence_ends()
    before, packing.BLOCK_TOKENS = packing.BLOCK_TOKENS, 3000
    try:
        packer = packing.Packer(512, ends, 4.0, 48.0, False)
        docs = edge_docs.where("length(text) < 100000").collect()
        rows = [r for d in docs for r in packer.add(d.doc_id, np.array([*chunks.ids(d.text), 2], "<u4"))] + packer.flush(True)
    finally:
        packing.BLOCK_TOKENS = before
    assert sum(r[2] for r in rows) == sum(len(chunks.ids(d.text)) + 1 for d in docs)
    assert [r[5] for r in rows] == sorted(r[5] for r in rows)


def test_order_packing_query(spark, chunks):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sequences = check_pieces(QUERIES["op2_order_packing"](spark, sf).collect(), docs, chunks)
    tokens = sum(len(chunks.ids(d.text)) + 1 for d in docs)
    assert tokens / (4096 * len(sequences)) > 0.95


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_is_the_naive_one(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 50) for _ in range(80)]
    bins = bestfit.best_fit(lengths, 50)
    room, naive = [], []
    for i in sorted(range(80), key=lambda i: (-lengths[i], i)):
        fits = [b for b in range(len(room)) if room[b] >= lengths[i]]
        if fits:
            least = min(room[b] for b in fits)
            b = [b for b in fits if room[b] == least][-1]
        else:
            b = len(room)
            room.append(50)
            naive.append([])
        room[b] -= lengths[i]
        naive[b].append(i)
    assert sorted(sum(bins, [])) == list(range(80)) and len(bins) == len(naive)
    assert sorted(50 - sum(lengths[i] for i in b) for b in bins) == sorted(room)


def test_the_buffer_is_bounded(monkeypatch):
    """Documents that fill a bin by half leave in good time, and without loss."""
    monkeypatch.setattr(bestfit, "BUFFER_TOKENS", 50_000)
    buffer, rows, most = bestfit.Buffer(4096, 0, 0.98), [], 0
    for i in range(400):
        rows += buffer.add(i, np.full(2100, 7, "<u4"))
        most = max(most, buffer.tokens)
    assert most < 50_000 and len(rows) > 350
    rows += buffer.flush(True)
    assert sorted(k for r in rows for k in r[2]) == list(range(400)) and sum(r[1] for r in rows) == 400 * 2100


def test_best_fit_rows_are_lossless(edge_docs, no_docs, chunks):
    rows = bestfit.pack_best_fit(edge_docs, length=256)
    for r in rows.collect():
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert np.flatnonzero(positions[: r.n_tokens] == 0).tolist() == r.cu_seqlens[:-1]
        assert not ids[r.n_tokens :].any()
    total = sum(r.n_ids for r in bestfit.unpack(rows).collect())
    assert total == sum(len(chunks.ids(d.text)) + 1 for d in edge_docs.collect())
    found = {(r.doc_id, r.start): r.ids_crc32 for r in bestfit.unpack(rows).collect()}
    for d in edge_docs.where("doc_id is not null").collect():
        ids = np.array([*chunks.ids(d.text), 2], "<u4")
        for start in range(0, len(ids), 256):
            assert found[d.doc_id, start] == zlib.crc32(ids[start : start + 256].tobytes())
    assert bestfit.pack_best_fit(no_docs).count() == 0


def test_best_fit_query(spark, chunks):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = sum(len(chunks.ids(d.text)) + 1 for d in docs)
    assert sum(r.n_tokens for r in rows) == tokens and tokens / (4096 * len(rows)) > 0.95
    pieces = {(k, s) for r in rows for k, s in zip(r.doc_ids, r.starts, strict=True)}
    assert len(pieces) == sum(r.n_segments for r in rows) == sum(-(-(len(chunks.ids(d.text)) + 1) // 4096) for d in docs)
