"""Gridded series as long rows: (date, lat, lon, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.cells import in_box, wrap_longitude
from cindergrid.functions.labels import finite
from cindergrid.functions.probability import clip

CELL = ("lat_key", "lon_key")


def normalise_cube(df, lon="longitude", time="valid_time", keys=("latitude",), value="v",
                   order="seq") -> DataFrame:
    """Wrap longitudes, name the time column `date`, keep the first of repeated stamps."""
    wrapped = df.withColumn(lon, wrap_longitude(lon)).withColumnRenamed(time, "date")
    return wrapped.groupBy("date", *keys, lon).agg(F.min_by(value, order).alias(value))


def ensemble_mean(df, value="v", keys=("date", *CELL)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(finite(value)).alias(value))


def deaccumulate(df, value="v", cell=CELL, time="date") -> DataFrame:
    """Daily amounts of a running total: the first value, then non-negative steps."""
    w = Window.partitionBy(*cell).orderBy(time)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn(value, F.coalesce(clip(step, 0.0), F.col(value)))


def magnitude(u, v, keys=("date", *CELL), value="v", out="speed") -> DataFrame:
    """sqrt(u*u + v*v) of two cubes on the same grid; a cell in only one is an error."""
    both = u.select(*keys, F.col(value).alias("_u")).join(
        v.select(*keys, F.col(value).alias("_v")), list(keys), "full_outer"
    )
    mismatch = F.raise_error(F.lit("the two cubes cover different cells or dates"))
    safe = F.when(F.col("_u").isNull() | F.col("_v").isNull(), mismatch.cast("double"))
    return both.select(
        *keys, safe.otherwise(F.hypot("_u", "_v")).alias(out)
    )


def merge_shards(shards, time_range=None, bounds=None, half_cell=0.05, lat="latitude",
                 lon="longitude") -> DataFrame:
    """Union of temporal shards, clipped in time and to bounds padded half a cell."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    if time_range is not None:
        merged = merged.filter(F.col("date").between(*[F.lit(t) for t in time_range]))
    if bounds is not None:
        merged = merged.filter(in_box(lat, lon, bounds, half_cell))
    return merged


def fragment_catalogue(df, source="source", lat="lat_key", lon="lon_key", step=0.1) -> DataFrame:
    """Sources grouped by spatial grid: extent, steps, size and routing priority."""
    per_source = df.groupBy(source).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("date").alias("days"),
        F.min(lat).alias("lat_min"),
        F.max(lat).alias("lat_max"),
        F.count_distinct(lat).alias("n_lat"),
        F.min(lon).alias("lon_min"),
        F.max(lon).alias("lon_max"),
        F.count_distinct(lon).alias("n_lon"),
    )
    grid = ["lat_min", "lat_max", "n_lat", "lon_min", "lon_max", "n_lon"]
    fragments = per_source.groupBy(*grid).agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("days").alias("days"),
        F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"),
    )

    def spacing(axis):
        n = F.col(f"n_{axis}")
        return F.when(n > 1, (F.col(f"{axis}_max") - F.col(f"{axis}_min")) * F.lit(step) / (n - 1))

    area = (F.col("lat_max") - F.col("lat_min")) * (F.col("lon_max") - F.col("lon_min"))
    sized = fragments.withColumns({"lat_step": spacing("lat"), "lon_step": spacing("lon"),
                                   "area": area})
    # finer grids first, then the smaller area, then the name; one row per grid
    rank = Window.orderBy("lat_step", "lon_step", "area", "sources")
    return sized.withColumn("priority", F.row_number().over(rank))


def coverage_audit(fragments, variables, years, area, min_days_share=1.0) -> DataFrame:
    """Per (variable, year): does any fragment cover the area and every day?

    fragments: variable, first_date, last_date, days, extents, n_days_in_year.
    """
    want = variables.select("variable").distinct().withColumn(
        "year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))
    )
    lat0, lon0, lat1, lon1 = area
    covers = (
        (F.col("lat_min") <= lat0) & (F.col("lat_max") >= lat1)
        & (F.col("lon_min") <= lon0) & (F.col("lon_max") >= lon1)
    )
    expected = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    # both conditions must hold for one fragment; of several, the best one is reported
    enough = F.coalesce(covers, F.lit(False)) & (F.col("days") >= expected * min_days_share)
    order = F.struct(enough.alias("e"), F.coalesce(covers, F.lit(False)).alias("c"), F.col("days").alias("d"))
    got = fragments.groupBy("variable", "year").agg(F.max(order).alias("_best")).select(
        "variable", "year", F.col("_best.d").alias("days"), F.col("_best.c").alias("covers_area")
    )
    plan = want.join(got, ["variable", "year"], "left").withColumn("expected_days", expected)
    reason = (
        F.when(F.col("days").isNull(), "missing_file")
        .when(~F.col("covers_area"), "domain_too_small")
        .when(F.col("days") < F.col("expected_days") * min_days_share, "missing_days")
        .otherwise("complete")
    )
    order = (
        F.when(F.col("reason") == "missing_file", 0)
        .when(F.col("reason") == "domain_too_small", 1)
        .when(F.col("reason") == "missing_days", 2)
        .otherwise(3)
    )
    return (
        plan.withColumn("reason", reason)
        .withColumn("days", F.coalesce("days", F.lit(0)))
        .withColumn("repair_priority", order)
        .drop("covers_area")
        .orderBy("repair_priority", "variable", "year")
    )


def to_grid(scores, grid, x0, y0, step, value="score", lat="latitude", lon="longitude") -> DataFrame:
    """Scores placed on their grid cells; cells without a score stay NULL.

    A point is placed only where it lies within half a step of the cell centre.
    """
    placed = scores.select(
        F.rint((F.col(lat) - y0) / step).cast("long").alias("row"),
        F.rint((F.col(lon) - x0) / step).cast("long").alias("col"),
        value,
    )
    mean = placed.groupBy("row", "col").agg(F.avg(value).alias(value))
    return grid.join(mean, ["row", "col"], "left")


def pivot_rows(grid, value, columns) -> DataFrame:
    """Matrix form on demand: one row per grid row, one column per listed grid column."""
    return grid.groupBy("row").pivot("col", list(columns)).agg(F.first(value))
