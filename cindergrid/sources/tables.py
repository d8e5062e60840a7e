"""Keyed tables: ordered unions, upserts, sample caches and cache checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_union(frames, columns, key, keep="last") -> DataFrame:
    """Union of many sources, one row per key: from the first or the last source.

    Absent columns become NULL. Only key and payload structs are shuffled, with
    map-side reduction, so a key repeated in every source costs one row each.
    """
    parts = [
        f.select(*[c for c in columns if c in f.columns]).withColumn("_source", F.lit(i))
        for i, f in enumerate(frames)
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in columns if c not in key]
    order = F.col("_source") if keep == "last" else -F.col("_source")
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """New rows replace old rows with the same key; other old rows stay."""
    kept = old.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def resolve_cache(request: DataFrame, cache: DataFrame, key, compute) -> tuple[DataFrame, DataFrame]:
    """Serve requests from a keyed cache and compute only what is missing.

    `compute` maps the distinct missing keys to rows shaped like the cache.
    Returns (requests with values, cache including the fresh rows).
    """
    wanted = request.select(*key).distinct()
    fresh = compute(wanted.join(cache.select(*key), list(key), "left_anti"))
    grown = cache.unionByName(fresh)
    return request.join(grown, list(key), "left"), grown


def cache_misses(request: DataFrame, cache: DataFrame, key) -> DataFrame:
    wanted = request.select(*key).distinct()
    missed = wanted.join(cache.select(*key).distinct(), list(key), "left_anti")
    counted = wanted.agg(F.count(F.lit(1)).alias("requested")).withColumn(
        "missing", missed.agg(F.count(F.lit(1))).scalar()
    )
    return counted.withColumn("resolved", F.col("requested") - F.col("missing"))


def is_multiset_subset(cached: DataFrame, current: DataFrame, key, label=None, min_positives=0):
    """One row: whether cached keys are a multiset subset of the current ones.

    Counts per key are compared instead of subtracting whole row sets.
    """
    have = cached.groupBy(*key).agg(F.count(F.lit(1)).alias("_have"))
    now = current.groupBy(*key).agg(F.count(F.lit(1)).alias("_now"))
    joined = have.join(now, list(key), "left")
    over = F.sum(F.greatest(F.col("_have") - F.coalesce("_now", F.lit(0)), F.lit(0)))
    out = joined.agg(
        F.coalesce(over, F.lit(0)).alias("excess_rows"),
        F.coalesce(F.sum("_have"), F.lit(0)).alias("cached_rows"),
    )
    positives = (
        cached.agg(F.coalesce(F.sum(label), F.lit(0)).alias("n")).scalar() if label else F.lit(0)
    )
    return out.withColumn("cached_positives", positives).withColumn(
        "valid", (F.col("excess_rows") == 0) & (F.col("cached_positives") >= min_positives)
    )


def content_hash(df: DataFrame, columns) -> DataFrame:
    """Order-insensitive fingerprint of a table: row count and summed row hashes."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("fingerprint"))
