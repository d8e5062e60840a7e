"""Fixity audit of replicas by Merkle trees over WARC records and their offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cindergrid.llm import common

PAGES_PER_FILE = 512
FANOUT = 16


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """file, offset, length, page_id and bytes of a WARC response record for each page.

    Files hold pages of PAGES_PER_FILE neighbouring ids, in order of id, address and body;
    pages without an id are dealt to files by their hash. Null addresses and bodies are
    written as empty. Repeated rows become records of their own. Other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col(body).cast("string"), F.lit("")), "UTF-8")
    number = F.col(key).cast("bigint")
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    http = F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8")
    rows = pages.select(
        number.alias("page_id"), address.alias("url"), F.concat(http, text).alias("block"),
        F.coalesce(F.floor(number / PAGES_PER_FILE), -1 - F.pmod(F.xxhash64(address, text), F.lit(4096))).alias("file"),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Type: application/http\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    made = rows.select("file", "page_id", "url", F.concat(F.encode(head, "UTF-8"), F.col("block"), end).alias("record"))
    return placed(made.withColumn("tie", F.sha2("record", 256)), ["page_id", "url", "tie"]).drop("url", "tie")


def placed(records: DataFrame, order: list[str]) -> DataFrame:
    """Records with their offset, length and number in their file."""
    rows = Window.partitionBy("file").orderBy(*order)
    length = F.octet_length("record").cast("bigint")
    return records.withColumns(
        {"length": length, "number": F.row_number().over(rows) - 1, "offset": F.sum(length).over(rows.rowsBetween(Window.unboundedPreceding, 0)) - length}
    )


def leaves(records: DataFrame) -> DataFrame:
    """One leaf for each record: its range of offsets and the hash of its place and bytes."""
    own = F.sha2("record", 256)
    return records.select(
        "file", F.col("number").cast("bigint").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"),
        own.alias("record_sha256"), _seal(F.col("offset"), F.col("offset") + F.col("length"), own).alias("hash"), "page_id",
    )


def _seal(first: Column, last: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", first.cast("string"), last.cast("string"), content).cast("binary"), 256)


def parents(level: DataFrame) -> DataFrame:
    """The next level: up to FANOUT neighbours make a node over their joint range."""
    up = F.floor(F.col("node") / FANOUT).alias("node")
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    rows = level.groupBy("file", up).agg(F.min("first").alias("first"), F.max("last").alias("last"), children.alias("children"))
    content = F.concat_ws("", F.transform("children", lambda c: c["hash"]))
    return rows.select("file", "node", "first", "last", _seal(F.col("first"), F.col("last"), content).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to one root for each file, each written to the shared folder."""
    levels = [common.stage(leaves(records), "leaves")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        levels.append(common.stage(parents(levels[-1]), "level"))
        top //= FANOUT
    return levels


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records in which two replicas differ: file, number, range, page and hash on either side.

    Both replicas' records are hashed into trees. Roots are compared first; only children of
    differing nodes are compared on each level below, down to the records. A record that one
    side lacks has nulls there. Files with equal roots are not descended into. A node has at
    most FANOUT children, so no group grows with the data. Empty replicas and equal ones
    give no rows.
    """
    trees = [tree(one), tree(two)]
    height = max(map(len, trees))
    suspects = None
    for at in range(height - 1, -1, -1):
        # a lower tree is compared from its own root down
        sides = [levels[at] if at < len(levels) else levels[-1].where("false") for levels in trees]
        if suspects is not None:
            own = suspects.withColumnRenamed("node", "parent")
            sides = [s.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(own, ["file", "parent"], "left_semi").drop("parent") for s in sides]
        a, b = (s.select("file", "node", *[F.col(c).alias(f"{c}_{n}") for c in s.columns if c not in ("file", "node")]) for s, n in zip(sides, "ab", strict=True))
        met = a.join(b, ["file", "node"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if at:
            suspects = common.stage(met.select("file", "node"), "suspects")
        else:
            return met.select(
                "file", F.col("node").alias("number"), F.coalesce("first_a", "first_b").alias("offset"),
                (F.coalesce("last_a", "last_b") - F.coalesce("first_a", "first_b")).alias("length"),
                F.coalesce("page_id_a", "page_id_b").alias("page_id"), F.col("record_sha256_a").alias("sha256_one"), F.col("record_sha256_b").alias("sha256_two"),
            )
    raise AssertionError("a tree has at least its leaves")


def decayed(records: DataFrame, every: int = 97, rest: int = 13) -> DataFrame:
    """A replica of the same records in which those of some pages have their last letter overwritten."""
    hit = F.coalesce(F.col("page_id") % every == rest, F.lit(False))
    size = F.octet_length("record")
    broken = F.concat(F.substring("record", 1, size - 5), F.encode(F.lit("~"), "UTF-8"), F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return records.withColumn("record", F.when(hit, broken).otherwise(F.col("record")))
