"""Matroska files as packet tables: variable-length EBML elements, clusters, lacing, cues."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

# Fixed values of the Matroska format: element identifiers.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK, NUMBER, UID, KIND, CODEC, DEFAULT_NS, LACED, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C, 0xE1
RATE, CHANNELS, DEPTH = 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")

FRAME, UNIT, FRAMES, CLUSTER_FRAMES, HERTZ = 960, 192, 8, 80, 8000

PACKETS = (
    "track int, codec string, cluster int, cluster_offset bigint, cued boolean, block int, frame int, lacing string, "
    "keyframe boolean, timestamp_ns bigint, offset bigint, size bigint"
)


def vint(value: int, width: int = 0) -> bytes:
    """A size or lace number; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], style: int) -> bytes:
    """The count and sizes of laced frames, and the frames."""
    sizes = [len(f) for f in frames]
    if style == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if style == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif style == 3:
        head += vint(sizes[0])
        for before, size in zip(sizes, sizes[1:-1], strict=False):
            step = size - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_file(payload: bytes) -> bytes:
    """8-bit mono sound in one track: clusters of laced blocks, and cues for every cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    milliseconds = len(payload) * 1000 / HERTZ
    info = element(INFO, unsigned(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", milliseconds)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))
    entry = unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT")
    entry += unsigned(DEFAULT_NS, FRAME * 1_000_000_000 // HERTZ) + unsigned(LACED, 1) + audio
    parts, cues = [info, element(TRACKS, element(TRACK, entry))], []
    at = sum(map(len, parts))
    for first in range(0, len(frames), CLUSTER_FRAMES):
        own = frames[first : first + CLUSTER_FRAMES]
        time = first * FRAME * 1000 // HERTZ
        body = [unsigned(TIME, time)]
        for k in range(0, len(own), FRAMES):
            laced = own[k : k + FRAMES]
            even = len({len(f) for f in laced}) == 1
            style = 0 if len(laced) == 1 else (1, 2, 3)[k // FRAMES % 3]
            style = 3 if style == 2 and not even else style
            relative = struct.pack(">h", k * FRAME * 1000 // HERTZ)
            body.append(element(SIMPLE, b"\x81" + relative + bytes([0x80 | style << 1]) + lace(laced, style)))
        cluster = element(CLUSTER, b"".join(body))
        places = element(CUE_TRACKS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))
        cues.append(element(POINT, unsigned(CUE_TIME, time) + places))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


class Broken(ValueError):
    """The bytes end inside an element or do not follow the format."""


def number_at(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and its width; identifiers keep the length bit. -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise Broken("no number here")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Broken("cut number")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value &= (1 << 7 * width) - 1
        value = -1 if value == (1 << 7 * width) - 1 else value
    return value, width


def elements(data: bytes, at: int, end: int, stop: tuple[int, ...] = (), whole: bool = True) -> Iterator[tuple[int, int, int]]:
    """(identifier, body start, body end) of the elements in a range; stops at an identifier in `stop`.

    An element that goes beyond the range is given up to there unless only `whole` ones count.
    """
    while at < end:
        number, a = number_at(data, at, True)
        if number in stop:
            return
        size, b = number_at(data, at + a, False)
        body = at + a + b
        last = end if size < 0 else body + size
        if last > end:
            if not whole:
                yield number, body, end
            raise Broken("cut element")
        yield number, body, last
        at = last


def lace_sizes(data: bytes, at: int, end: int, style: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins."""
    if style == 0:
        return [end - at], at
    if at >= end:
        raise Broken("cut lacing")
    count, at, sizes = data[at] + 1, at + 1, []
    if style == 2:
        if (end - at) % count:
            raise Broken("uneven fixed lacing")
        return [(end - at) // count] * count, at
    while len(sizes) < count - 1:
        if style == 1:
            size = 0
            while True:
                if at >= end:
                    raise Broken("cut lacing")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            value, width = number_at(data, at, False)
            at += width
            size = sizes[-1] + value - ((1 << 7 * width - 1) - 1) if sizes else value
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken("lacing is longer than its block")
    return sizes, at


def integer(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def packets_of(data: bytes | None) -> list[tuple]:
    """The packets of one file, in file order, as rows of PACKETS.

    Null, empty or foreign bytes have none. Of a damaged file, the packets before the
    damage are returned. Sizes may be unknown for the segment and for clusters.
    """
    rows: list[tuple] = []
    cued: set[int] = set()
    base = 0
    try:
        for number, body, end in elements(data or b"", 0, len(data or b""), whole=False):
            if number == EBML:
                kinds = [data[a:b] for n, a, b in elements(data, body, end) if n == DOC_TYPE]
                if kinds and kinds[0].rstrip(b"\0") not in (b"matroska", b"webm"):
                    return []
            elif number == SEGMENT:
                base = body
                _segment(data, body, end, rows, cued)
    except Broken:
        pass
    return [(*r[:3], r[3], r[3] - base in cued, *r[4:]) for r in rows]


def _segment(data: bytes, at: int, end: int, rows: list, cued: set) -> None:
    scale, tracks, cluster, block = 1_000_000, {}, -1, -1
    while at < end:
        number, a = number_at(data, at, True)
        size, b = number_at(data, at + a, False)
        begin, body = at, at + a + b
        last = end if size < 0 else min(body + size, end)
        cut = size >= 0 and body + size > end
        if number == INFO:
            scale = next((integer(data, x, y) for n, x, y in elements(data, body, last) if n == SCALE), scale)
        elif number == TRACKS:
            for _, x, y in elements(data, body, last):
                own = {n: (p, q) for n, p, q in elements(data, x, y)}
                codec = data[slice(*own[CODEC])].decode("ascii", "replace") if CODEC in own else ""
                tracks[integer(data, *own.get(NUMBER, (0, 0)))] = (codec, integer(data, *own.get(DEFAULT_NS, (0, 0))))
        elif number == CLUSTER:
            cluster, time, x = cluster + 1, 0, body
            for n, x, y in elements(data, body, last, (CLUSTER, CUES) if size < 0 else ()):
                if n == TIME:
                    time = integer(data, x, y)
                elif n in (SIMPLE, GROUP):
                    block += 1
                    key = None
                    if n == GROUP:
                        inner = {m: (p, q) for m, p, q in elements(data, x, y)}
                        if BLOCK not in inner:
                            continue
                        (x, y), key = inner[BLOCK], REFERENCE not in inner
                        _block(data, x, y, key, tracks, scale, time, cluster, begin, block, rows)
                        continue
                    _block(data, x, y, key, tracks, scale, time, cluster, begin, block, rows)
            if size < 0:
                x = body
                for _, _, x in elements(data, body, last, (CLUSTER, CUES)):
                    pass
                last = x
        elif number == CUES:
            for _, x, y in elements(data, body, last):
                for n, p, q in elements(data, x, y):
                    if n == CUE_TRACKS:
                        cued.update(integer(data, s, t) for m, s, t in elements(data, p, q) if m == CUE_CLUSTER)
        if cut:
            raise Broken("cut element")
        at = last


def _block(data, x, y, key, tracks, scale, time, cluster, begin, block, rows) -> None:
    track, width = number_at(data, x, False)
    if x + width + 3 > y:
        raise Broken("cut block")
    relative = int.from_bytes(data[x + width : x + width + 2], "big", signed=True)
    flags = data[x + width + 2]
    style = flags >> 1 & 3
    sizes, at = lace_sizes(data, x + width + 3, y, style)
    codec, step = tracks.get(track, ("", 0))
    key = bool(flags & 0x80) if key is None else key
    stamp = (time + relative) * scale
    for frame, size in enumerate(sizes):
        rows.append((track, codec, cluster, begin, block, frame, LACING[style], key, stamp + frame * step, at, size))
        at += size


def packets(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each packet of each file in a binary column; see packets_of for damaged files.

    Files without packets, null and empty ones have no rows. Null keys stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", *[part.split()[0] for part in PACKETS.split(", ")]]
        for batch in batches:
            rows = [(k.as_py(), *p) for k, m in zip(batch.column("k"), batch.column("m"), strict=True) for p in packets_of(m.as_py())]
            for i in range(0, len(rows), 50_000):
                columns = zip(*rows[i : i + 50_000], strict=True)
                types = [batch.schema.field("k").type, "int32", "string", "int32", "int64", "bool_", "int32", "int32", "string", "bool_", "int64", "int64", "int64"]
                types = [pa.bool_() if t == "bool_" else t for t in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kind = dict(media.dtypes)[key]
    narrow = media.select(F.col(key).alias("k"), F.col(column).alias("m"))
    return narrow.mapInArrow(run, f"key {kind}, {PACKETS}")


def store_text(text: str | None) -> tuple[int, bytes, bytes]:
    """Bytes of the text, the padded payload and the file that stores it."""
    own = (text or "").encode()
    payload = own + b" " * (-len(own) % UNIT if own else UNIT)
    return len(own), payload, write_file(payload)


def features_of(payload: bytes, rows: list[tuple]) -> str:
    """Whole numbers that describe the packets and the samples read back."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    energy = int((samples * samples).sum())
    styles = ",".join(f"{s}:{sum(r[7] == s for r in rows)}" for s in LACING)
    last = max((r[9] for r in rows), default=0) // 1_000_000
    return (
        f"packets={len(rows)};clusters={rows[-1][2] + 1 if rows else 0};cued={sum(r[4] for r in rows)};lacing={styles};last_ms={last};"
        f"sum={int(samples.sum())};energy={energy};crossings={crossings}"
    )


FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and each text stored as the samples of a Matroska file, in column `media`.

    A null text is an empty one and gives 192 blanks. Null keys and repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_rows(batches, "t"):
            made = [store_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array([m[0] for m in made], "int64"), pa.array([m[2] for m in made], "binary")],
                ["doc_id", "n_bytes", "media"],
            )

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read stored files back through their packet tables: payload, checksums and features, a row per file.

    A null file gives nulls. An empty, foreign or damaged one gives what its readable packets
    hold; without any, the payload is empty (0 bytes, features of no packets). A null key or
    n_bytes stays null, repeated rows come as often as they are, no files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FEATURES.split(", ")]
        types = ["int64", "int64", "int64", "string", "int64", "int64", "string", "string"]
        for batch in batches:
            out = []
            for key, size, cell in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                data = cell.as_py()
                if data is None:
                    out.append((key, size, *[None] * 6))
                    continue
                rows = packets_of(data)
                payload = b"".join([data[r[10] : r[10] + r[11]] for r in rows if r[0] == 1])
                out.append(
                    (key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features_of(payload, rows))
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return media.mapInArrow(run, FEATURES)
