"""Named boxes: membership, first match, and the implicit global region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("lat_min", "lat_max", "lon_min", "lon_max")


def _membership(rows, regions, name):
    """Rows with the array of (name, order) of the boxes that hold them.

    The catalogue is a configuration table; it is folded into one array value, so
    rows are neither shuffled nor multiplied before they are tested.
    """
    order = "r_regionkey" if "r_regionkey" in regions.columns else name
    boxes = regions.agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(order).alias("k"), F.col(name).alias("name"), *BOX))
        ).alias("boxes")
    ).scalar()
    held = F.filter(
        F.col("_boxes"),
        lambda b: F.col("lat_key").between(b.lat_min, b.lat_max)
        & F.col("lon_key").between(b.lon_min, b.lon_max),
    )
    return rows.withColumn("_boxes", boxes).withColumn("_in", held).drop("_boxes")


def region_names(rows, regions, name="r_name", include_global=False, out="_regions") -> DataFrame:
    """The names of the closed boxes holding each row, plus `global` if asked, as one array."""
    names = F.transform("_in", lambda b: b["name"])
    if include_global:
        names = F.concat(names, F.array(F.lit("global")))
    return _membership(rows, regions, name).withColumn(out, names).drop("_in")


def region_rows(rows, regions, name="r_name", include_global=False) -> DataFrame:
    """One copy of each row per closed box holding it, plus `global` if asked."""
    named = region_names(rows, regions, name, include_global)
    return named.withColumn("region", F.explode("_regions")).drop("_regions")


def first_region(rows, regions, name="r_name", default="other") -> DataFrame:
    """Label of the first box (by catalogue order) holding each row."""
    first = F.try_element_at(F.transform("_in", lambda b: b["name"]), F.lit(1))
    return _membership(rows, regions, name).withColumn(
        "region", F.coalesce(first, F.lit(default))
    ).drop("_in")
