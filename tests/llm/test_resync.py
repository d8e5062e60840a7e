"""Token counts by overlapping chunks."""

import random

import pytest
from samples import prose
from test_packing import ODD

from cindergrid.llm.queries import QUERIES
from cindergrid.llm.resync import Resynchroniser, count_tokens
from cindergrid.llm.tokens import default_vocabulary

LONG = [
    prose(1, 900), "x" * 3000, "x y" * 2000, "日本語 한국어 été " * 300, "日本語한국어" * 400, "a<|endoftext|>b " * 300, "<|endoftext|>" * 200,
    "don't 'S they'll " * 300, " ".join("'" * (i % 7) + "s" for i in range(900)), "word\n\n\tword  word " * 300, "   " * 900 + "end", "é ́e " * 500,
    "ΣΑΣ İstanbul ŉ ﬁ " * 300, "12 345 6-7 .. " * 300, "🙂 🙂🙂 " * 400, "z" * 700 + " " + "y" * 900 + " ab cd " + "q" * 2000 + " end of it",
]


@pytest.fixture(scope="module")
def small():
    return Resynchroniser(default_vocabulary(), chunk=200, overlap=50, huge=200)


@pytest.mark.parametrize("text", LONG + ODD)
def test_spliced_ids_are_the_whole_texts(small, text):
    assert small.ids(text) == small.whole(text)
    assert small.count(text) == len(small.whole(text))


@pytest.fixture(scope="module")
def one_chunk():
    return Resynchroniser(default_vocabulary(), huge=1_000_000)


@pytest.mark.parametrize("text", LONG + ODD)
def test_counts_of_one_chunk(one_chunk, text):
    assert one_chunk.count(text) == len(one_chunk.whole(text))


@pytest.mark.parametrize("seed", range(30))
def test_spliced_ids_of_random_texts(small, one_chunk, seed):
    draw = random.Random(seed)
    parts = ["a", "The", "'s", "'", " ", "  ", "\n", ".", "..", "<|endoftext|>", "<|", "|>", "é", "é", "́", "ß", "Σ", "日本", "7", " ", "　", "\x1c", "🙂", "long" * 30]
    text = "".join(draw.choice(parts) + draw.choice(["", " ", " "]) for _ in range(draw.choice([100, 600, 3000])))
    assert small.ids(text) == small.whole(text)
    assert one_chunk.count(text) == len(small.whole(text))


def test_chunks_stay_small_where_blanks_are(small):
    text = prose(3, 2000)
    windows = list(small.windows(text))
    assert len(windows) > 50 and max(w.end - w.start for w, _ in windows) <= 250


def test_overlaps_widen_and_chunks_double(small):
    blanks_far_apart = " ".join("w" * 180 for _ in range(30))
    windows = list(small.windows(blanks_far_apart))
    assert max(w.end - w.start for w, _ in windows) > 200 and len(windows) > 3
    assert len(list(small.windows("x" * 3000))) == 1


def test_other_vocabularies():
    import public_tokenizers

    coder = Resynchroniser(public_tokenizers.path("byte_bpe_50k.json"), chunk=200, overlap=50, huge=200)
    for text in LONG:
        assert coder.ids(text) == coder.whole(text)
        assert coder.count(text) == len(coder.whole(text))
        assert Resynchroniser(public_tokenizers.path("byte_bpe_50k.json")).count(text) == len(coder.whole(text))


def test_edge_documents(spark, edge_docs, no_docs, small):
    rows = count_tokens(edge_docs, chunk=300, overlap=80, huge=300, limit=100, with_ids=True).collect()
    docs = edge_docs.collect()
    assert len(rows) == len(docs)
    expected = [(d.doc_id, len((d.text or "").encode()), small.whole(d.text or "")) for d in docs]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_bytes, r.input_ids) for r in rows), key=order) == sorted(expected, key=order)
    assert all(r.n_tokens == len(r.input_ids) and r.over_limit == (r.n_tokens > 100) for r in rows)
    assert count_tokens(no_docs).collect() == []


def test_query_counts_as_the_library(spark, small):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op12_resync_tokens"](spark, sf).collect()
    expected = [(d.doc_id, len((d.text or "").encode()), len(small.whole(d.text or ""))) for d in docs]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == sorted(expected)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
