"""Helpers shared by the corpus operators: stages in the shared folder, row keys, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_BYTES = 64_000_000  # a cache is emptied at about this size, which changes no result
ENTRY_BYTES = 170  # of an entry, without the letters of its key


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    A session on one machine that names none gets a fresh local folder; a cluster
    that names none is refused, as its executors would write where nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again, cutting the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stages that nothing lazy reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checksum_rest(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo: fixes which rows are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def text_rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches with their texts as Python strings, a bounded number of characters at a time."""
    for batch in batches:
        column = batch.column(text)
        start, held = 0, 0
        for row in range(batch.num_rows):
            held += column[row].as_buffer().size if column[row].is_valid else 0
            if held > 16_000_000:
                part = batch.slice(start, row + 1 - start)
                yield part, part.column(text).to_pylist()
                start, held = row + 1, 0
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, part.column(text).to_pylist()
    # workers are used again, perhaps by a stage that needs little
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """64-bit hashes of white-space separated chunks, case and outer punctuation ignored; 0 for none."""

    held = 0
    EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡·"

    def __missing__(self, chunk: str) -> int:
        self.held += ENTRY_BYTES + len(chunk)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = ENTRY_BYTES + len(chunk)
        word = chunk.strip(self.EDGE).lower()
        value = self[chunk] = (xxhash.xxh64_intdigest(word) | 1) if word else 0
        return value

    def of(self, text: str) -> np.ndarray:
        """The hashes of a text's words in order, as unsigned 64-bit numbers."""
        chunks = text.split()
        found = np.fromiter(map(self.__getitem__, chunks), np.uint64, len(chunks))
        return found[found != 0]


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ words[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A hash function of its own for each seed."""
    out = (values ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(29)
    return out
