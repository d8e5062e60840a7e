"""Column-level jobs: filling, normalising, choosing, ablating and presenting columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.labels import finite
from cindergrid.functions.probability import clip


def drop_sea_rows(df, threshold=70.0, column="landseamask") -> DataFrame:
    return df.filter(F.col(column) < threshold) if column in df.columns else df


def clip_unit(x):
    return clip(x, 0.0, 1.0)


def minmax_scores(df, column, out) -> DataFrame:
    """Scores scaled to [0, 1] over the whole table (0.5 if constant), with raw statistics."""
    v = finite(column)
    stats = df.agg(
        F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"))
    ).scalar()
    with_stats = df.withColumn("_s", stats)
    span = F.col("_s.hi") - F.col("_s.lo")
    return with_stats.withColumns(
        {
            out: F.when(span > 0, (F.col(column) - F.col("_s.lo")) / span).otherwise(0.5),
            "raw_min": F.col("_s.lo"),
            "raw_max": F.col("_s.hi"),
            "raw_mean": F.col("_s.mean"),
        }
    ).drop("_s")


def lead_days(df, column, out) -> DataFrame:
    """Lead time in whole days; hours are recognised by name or by value."""
    v = finite(column)
    if "hour" in column.lower():
        return df.withColumn(out, F.rint(v / 24.0).cast("long"))
    hours = df.agg(
        F.coalesce((F.max(v) > 60) & F.bool_and(F.abs(v % 24) < 1e-8), F.lit(False))
    ).scalar()
    return df.withColumn(out, F.rint(F.when(hours, v / 24.0).otherwise(v)).cast("long"))


def fill_model_inputs(df, numeric, string_categories=(), numeric_categories=()) -> DataFrame:
    """Add missing model inputs and fill NULLs: mean, "Unknown" or 99."""
    for c in numeric:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    for c in string_categories:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    for c in numeric_categories:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("int"))
    means = df.agg(F.struct(*[F.avg(finite(c)).alias(c) for c in numeric])).scalar()
    filled = df.withColumn("_m", means)
    out = {c: F.coalesce(finite(c), F.col(f"_m.{c}"), F.lit(0.0)) for c in numeric}
    out |= {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in string_categories}
    out |= {c: F.coalesce(F.col(c).cast("int"), F.lit(99)) for c in numeric_categories}
    return filled.withColumns(out).drop("_m")


def normalise_categories(df, numeric, text, population=()) -> DataFrame:
    out = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in numeric}
    out |= {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in text}
    out |= {c: F.coalesce(finite(c), F.lit(0.0)) for c in population}
    return df.withColumns({c: e for c, e in out.items() if c in df.columns})


def select_columns(df, keep=None, exact=(), prefixes=(), ignored=()):
    """Model columns by rule -> (selected DataFrame, report of every named column)."""
    types = dict(df.dtypes)
    rows, chosen = [], []
    for c in keep if keep is not None else df.columns:
        if c not in types:
            status = "missing"
        elif c in ignored:
            status = "dropped_ignored"
        elif types[c].startswith(("date", "timestamp")):
            status = "dropped_datetime"
        elif c in exact:
            status = "dropped_exact"
        elif c.startswith(tuple(prefixes)) and prefixes:
            status = "dropped_prefix"
        else:
            status = "kept"
            chosen.append(c)
        rows.append((c, status))
    report = df.sparkSession.createDataFrame(rows, "column string, status string")
    return df.select(*chosen), report


def ablate_inputs(df, names=(), prefixes=(), drop=False) -> DataFrame:
    """Replace a feature family by zeros, or leave it out."""
    hit = [
        c for c in df.columns if c in names or (prefixes and c.startswith(tuple(prefixes)))
    ]
    if drop:
        return df.drop(*hit)
    return df.withColumns({c: F.lit(0).cast(dict(df.dtypes)[c]) for c in hit})


def present(table, rename, digits=None, order=(), limit=None) -> DataFrame:
    """Select, rename, round, sort and cut a report table."""
    digits = digits or {}
    cols = []
    for old, new in rename.items():
        c = F.col(old)
        cols.append((F.round(c, digits[new]) if new in digits else c).alias(new))
    out = table.select(*cols)
    if order:
        out = out.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order])
    return out.limit(limit) if limit else out


def global_rows(table, region="region"):
    return table.filter(F.col(region) == "global")


def regional_rows(table, region="region"):
    return table.filter(F.col(region) != "global")


def annual_rows(table, year="year"):
    return table.filter(F.col(year).isNotNull())


def combined_rows(table, year="year"):
    return table.filter(F.col(year).isNull())


# Detection-file country name -> polygon-layer country name.
POLYGON_NAMES = {
    "Russian_Federation": "Russia",
    "United_Kingdom": "United Kingdom",
    "Czech_Republic": "Czechia",
    "Bosnia_and_Herzegovina": "Bosnia and Herzegovina",
    "Serbia": "Republic of Serbia",
    "Dem_Rep_Korea": "North Korea",
    "Republic_of_Korea": "South Korea",
    "Macedonia_Former_Yugoslav_Republic_of": "North Macedonia",
}


def with_country_names(df, column="country") -> DataFrame:
    """Polygon-layer and display names of a detection-file country name."""
    pairs = [F.lit(x) for pair in POLYGON_NAMES.items() for x in pair]
    name = F.col(column)
    return df.withColumns(
        {
            "polygon_name": F.coalesce(F.try_element_at(F.create_map(*pairs), name), name),
            "display_name": F.replace(name, F.lit("_"), F.lit(" ")),
        }
    )


def match_any_name(df, names, columns) -> DataFrame:
    """Rows whose name appears in any of several name columns."""
    hits = [F.col(c).isin(list(names)) for c in columns if c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))
