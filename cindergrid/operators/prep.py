"""Train-only statistics and transforms of model inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.labels import finite
from cindergrid.functions.probability import clip, ratio
from cindergrid.operators.ranking import exact_quantiles


def numeric_statistics(train, columns, ddof=1) -> DataFrame:
    """median, mean and std of the median-filled column, one row per column.

    All columns share one exact-quantile pass over (column, value) counts.
    """
    melted = train.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("value")) for c in columns])
        ).alias("x")
    ).select("x.*")
    medians = exact_quantiles(melted, "value", {"median": 0.5}, ["column"])
    sums = melted.groupBy("column").agg(
        F.count(F.lit(1)).alias("_all"), F.count("value").alias("_n"),
        F.avg("value").alias("_m"), F.var_pop("value").alias("_v"),
    )
    joined = sums.join(medians, "column", "left")
    # statistics after filling the gaps with the median, from the moments before
    n, gap = F.col("_all"), F.col("_all") - F.col("_n")
    med = F.coalesce("median", F.lit(0.0))
    m0, v0 = F.coalesce("_m", F.lit(0.0)), F.coalesce("_v", F.lit(0.0))
    mean = (F.col("_n") * m0 + gap * med) / n
    ss = F.col("_n") * (v0 + (m0 - mean) * (m0 - mean)) + gap * (med - mean) * (med - mean)
    return joined.select(
        "column", med.alias("median"), mean.alias("mean"),
        F.sqrt(ss / F.when(n > ddof, n - ddof)).alias("std"), (gap > 0).alias("has_missing"),
    )


def _as_map(stats):
    """The statistics table (one row per column) as one map value."""
    return stats.agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct("median", "mean", "std", "has_missing")))
        ).alias("m")
    ).scalar()


def impute_and_scale(df, stats, columns, standardise=True, indicators=False) -> DataFrame:
    """Median fill, optional missing indicators and standardisation."""
    with_stats = df.withColumn("_st", _as_map(stats))
    out = {}
    for c in columns:
        s = F.col("_st")[c]
        v = F.coalesce(finite(c), s["median"])
        if indicators:
            out[f"{c}_missing"] = finite(c).isNull().cast("int")
        if standardise:
            safe = F.when(s["std"] > 0, s["std"]).otherwise(1.0)
            v = (v - s["mean"]) / safe
        out[c] = v
    return with_stats.withColumns(out).drop("_st")


def ordinal_codes(train, column, order) -> DataFrame:
    """Code of each category by its first appearance in a stable row order."""
    first = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    # one row per category
    return first.select(
        column, (F.row_number().over(Window.orderBy("_first", column)) - 1).alias("code")
    )


def encode_ordinal(df, codes, column, out=None, unseen=-1) -> DataFrame:
    named = codes.withColumnRenamed("code", "_code")
    return df.join(named, column, "left").withColumn(
        out or f"{column}_code", F.coalesce("_code", F.lit(unseen))
    ).drop("_code")


def categorical_block(train, df, columns, order, limit=10, missing="missing") -> DataFrame:
    """One-hot arrays for columns with few categories, ordinal codes for the others.

    Unknown categories are all zeros in a one-hot array and -1 as a code. The
    cardinality is settled inside the plan: both encodings come from the same
    code table and the unused one is NULL.
    """
    out = df
    for c in columns:
        filled = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        codes = ordinal_codes(train.withColumn(c, filled), c, order)
        k = codes.agg(F.count(F.lit(1))).scalar()
        out = encode_ordinal(out.withColumn(c, filled), codes, c, f"{c}_code").withColumn("_k", k)
        hot = F.transform(
            F.sequence(F.lit(0), (F.col("_k") - 1).cast("int")),
            lambda i: (i == F.col(f"{c}_code")).cast("int"),
        )
        out = out.withColumn(f"{c}_onehot", F.when(F.col("_k") <= limit, hot)).drop("_k")
    return out


def target_encoding(train, column, label="is_fire", smoothing=20.0) -> DataFrame:
    """(n * mean + s * g) / (n + s) per category."""
    g = train.agg(F.avg(label)).scalar()
    t = train.groupBy(column).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return t.withColumn("_g", g).select(
        column, ((F.col("_s") + smoothing * F.col("_g")) / (F.col("_n") + smoothing)).alias("encoded")
    )


def encode_target(train, df, column, label="is_fire", smoothing=20.0) -> DataFrame:
    g = train.agg(F.avg(label)).scalar()
    table = target_encoding(train, column, label, smoothing)
    return df.join(table, column, "left").withColumn("_g", g).withColumn(
        "encoded", F.coalesce("encoded", "_g")
    ).drop("_g")


def channel_statistics(train, column="series", per_day=True) -> DataFrame:
    """Median, mean and population std of every position (or the whole channel)."""
    flat = train.select(F.posexplode(column).alias("pos", "value"))
    if not per_day:
        flat = flat.withColumn("pos", F.lit(0))
    flat = flat.withColumn("value", finite("value"))
    med = exact_quantiles(flat, "value", {"median": 0.5}, ["pos"])
    filled = flat.join(med, "pos", "left").withColumn("value", F.coalesce("value", "median"))
    return filled.groupBy("pos").agg(
        F.max("median").alias("median"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )


def scale_channel(df, stats, column="series", per_day=True, out="scaled") -> DataFrame:
    lookup = stats.agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct("median", "mean", "std")))).alias("m")
    ).scalar()
    at = df.withColumn("_st", lookup)

    def scaled(v, i):
        s = F.col("_st")[i if per_day else F.lit(0)]
        x = F.coalesce(F.when(~F.isnan(v), v), s["median"])
        return (x - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0)

    return at.withColumn(out, F.transform(column, scaled)).drop("_st")


def weighted_statistics(df, columns, weight="eval_weight") -> DataFrame:
    """Weighted mean and std of each column."""
    w = F.col(weight)
    aggs = [F.sum(w).alias("_w")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.sum(w * x).alias(f"{c}__s"), F.sum(w * x * x).alias(f"{c}__q")]
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), ratio(f"{c}__s", "_w").alias("mean"),
                    ratio(f"{c}__q", "_w").alias("square"),
                )
                for c in columns
            ]
        )
    )
    return wide.select(rows.alias("x")).select(
        "x.column", F.col("x.mean").alias("mean"),
        F.sqrt(clip(F.col("x.square") - F.col("x.mean") * F.col("x.mean"), 0.0))
        .alias("std"),
    )


def back_transform(coefficients, stats, intercept: float) -> DataFrame:
    """Coefficients of standardised inputs in original units, with the intercept."""
    joined = coefficients.join(stats, "column").withColumn(
        "original", F.col("coefficient") / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    )
    shift = joined.agg(F.sum(F.col("original") * F.col("mean"))).scalar()
    return joined.withColumn("intercept", F.lit(float(intercept)) - shift).select(
        "column", F.col("original").alias("coefficient"), "intercept"
    )


def log_population(df, column="population") -> DataFrame:
    return df.withColumn(column, F.log1p(clip(finite(column), 0.0)))


def column_union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
