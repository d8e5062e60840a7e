"""Matroska packets: round trips, lacing, unknown sizes and damage."""

import hashlib
import random
import zlib

import pytest

from cindergrid.llm import matroska as M
from cindergrid.llm.queries import QUERIES


@pytest.mark.parametrize("style", range(4))
@pytest.mark.parametrize("seed", range(5))
def test_lacing_round_trip(style, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, 254, 255, 256, 600, 20_000]) for _ in range(draw.randint(2, 9))]
    if style == 2:
        sizes = [sizes[0] + 1] * len(sizes)
    if style == 0:
        sizes = sizes[:1]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    data = b"??" + M.lace(frames, style)
    found, at = M.lace_sizes(data, 2, len(data), style)
    assert found == sizes
    for frame, size in zip(frames, found, strict=True):
        assert data[at : at + size] == frame
        at += size


@pytest.mark.parametrize("size", [192, 384, 960, 1152, 7680, 76_800, 77_952, 500_160])
def test_file_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = M.write_file(payload)
    rows = M.packets_of(data)
    assert b"".join(data[r[10] : r[10] + r[11]] for r in rows) == payload
    assert all(r[4] for r in rows) and [r[9] for r in rows] == [i * 120_000_000 for i in range(len(rows))]
    assert {r[1] for r in rows} == {"A_PCM/INT/LIT"}


def file_of(body, doc=b"webm"):
    return M.element(M.EBML, M.element(M.DOC_TYPE, doc)) + body


def test_unknown_sizes_groups_and_two_tracks():
    def open_element(number, body):
        return number.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body

    tracks = M.element(M.TRACKS, b"".join(M.element(M.TRACK, M.unsigned(M.NUMBER, n) + M.element(M.CODEC, c)) for n, c in ((1, b"V_X"), (2, b"A_Y"))))
    one = M.unsigned(M.TIME, 5) + M.element(M.SIMPLE, b"\x81\x00\x02\x80abc")
    group = M.element(M.GROUP, M.element(M.BLOCK, b"\x82\xff\xff\x00de") + M.unsigned(M.REFERENCE, 1))
    two = M.unsigned(M.TIME, 9) + group
    data = file_of(open_element(M.SEGMENT, M.element(M.INFO, M.unsigned(M.SCALE, 2_000_000)) + tracks + open_element(M.CLUSTER, one) + open_element(M.CLUSTER, two)))
    rows = M.packets_of(data)
    assert [(r[0], r[1], r[2], r[8], r[9], data[r[10] : r[10] + r[11]]) for r in rows] == [
        (1, "V_X", 0, True, 14_000_000, b"abc"), (2, "A_Y", 1, False, 16_000_000, b"de"),
    ]


def test_damaged_files_keep_earlier_packets():
    data = M.write_file(b"s" * 96_000)
    whole = [r[:4] + r[5:] for r in M.packets_of(data)]
    for end in (0, 1, 10, 60, 200, 5000, 40_000, len(data) - 1):
        found = [r[:4] + r[5:] for r in M.packets_of(data[:end])]
        assert found == whole[: len(found)]
    assert len(M.packets_of(data[:90_000])) > 50
    assert M.packets_of(b"RIFF....") == M.packets_of(None) == M.packets_of(file_of(b"", b"other") + data) == []
    draw = random.Random(1)
    for _ in range(200):
        bad = bytearray(data[:3000])
        bad[draw.randrange(3000)] = draw.randrange(256)
        M.packets_of(bytes(bad))


def test_edge_documents(edge_docs, no_docs):
    docs, rows = edge_docs.collect(), M.media_features(M.text_media(edge_docs)).collect()
    assert len(docs) == len(rows)
    wanted = []
    for d in docs:
        own = (d.text or "").encode()
        own += b" " * (-len(own) % 192 or (0 if own else 192))
        wanted.append((d.doc_id, len((d.text or "").encode()), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:])))
    key = lambda r: (r[0] or 0, r[3])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(wanted, key=key)
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert M.media_features(M.text_media(no_docs)).count() == 0


def test_packet_table(spark, edge_docs):
    media = M.text_media(edge_docs.where("doc_id in (1, 8)"))
    rows = M.packets(media, "doc_id", "media").collect()
    sizes = {r.doc_id: r.n_bytes for r in media.collect()}
    for key, size in sizes.items():
        assert sum(r.size for r in rows if r.key == key) == size + -size % 192
    odd = spark.createDataFrame([(None, None), (1, b""), (2, b"junk")], "doc_id bigint, media binary")
    assert M.packets(odd, "doc_id", "media").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op6_matroska_packets"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert rows[d.doc_id].n_bytes == len(d.text.encode())


def test_features_of_null_foreign_and_damaged_files(spark):
    whole = M.store_text("a text of its own " * 8000)[2]
    files = [(1, 5, None), (2, 5, b""), (3, None, b"no media at all"), (None, 5, whole[: len(whole) // 2]), (5, 144_000, whole), (6, 1, whole[:20])]
    rows = {r.doc_id: r for r in M.media_features(spark.createDataFrame([(k, n, None if m is None else bytearray(m)) for k, n, m in files], "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert tuple(rows[1]) == (1, 5, None, None, None, None, None, None)
    assert all(rows[k].payload_bytes == 0 and rows[k].feature.startswith("packets=0;clusters=0;") for k in (2, 3, 6))
    assert rows[5].payload_bytes == 144_000 and 0 < rows[None].payload_bytes < 144_000
    assert M.media_features(spark.createDataFrame([], "doc_id bigint, n_bytes bigint, media binary")).count() == 0
