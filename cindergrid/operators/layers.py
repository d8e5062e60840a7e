"""Static and dated layers attached to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.operators.raster import screen_radiance
from cindergrid.operators.spatial import nearest_index, nearest_year


def last_step(layer, values, keys=("i", "j"), time="date") -> DataFrame:
    """Last time step of every grid cell."""
    if time not in layer.columns:
        return layer
    pick = layer.groupBy(*keys).agg(F.max_by(F.struct(*values), time).alias("_v"))
    return pick.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def attach_layers(rows, layers, lat="latitude", lon="longitude") -> DataFrame:
    """Nearest-cell values of several static layers.

    layers: name -> (rows by grid index i, j; (lat axis, lon axis); values;
    fill values per output column). A column name already taken gets the layer
    name as suffix.
    """
    out = rows
    for name, (layer, (axis_lat, axis_lon), values, fill) in layers.items():
        flat = last_step(layer, values)
        renamed = {v: (f"{v}_{name}" if v in out.columns else v) for v in values}
        flat = flat.select(
            F.col("i").alias("_i"), F.col("j").alias("_j"),
            *[F.col(v).alias(r) for v, r in renamed.items()],
        )
        keyed = out.withColumns(
            {"_i": nearest_index(lat, *axis_lat), "_j": nearest_index(lon, *axis_lon)}
        )
        out = keyed.join(flat, ["_i", "_j"], "left").drop("_i", "_j")
        for column, value in fill.items():
            out = out.withColumn(column, F.coalesce(column, F.lit(value)))
    return out


def attach_lights(rows, static, tiles, years, transform, north=None, lat="latitude",
                  lon="longitude") -> DataFrame:
    """Dated light: nearest tile year, quality screening, static map as fallback."""
    x0, dx, y0, dy = transform
    keyed = nearest_year(rows, years).withColumns(
        {
            "r": F.floor((F.col(lat) - y0) / dy).cast("long"),
            "c": F.floor((F.col(lon) - x0) / dx).cast("long"),
        }
    )
    longs = {"r": F.col("r").cast("long"), "c": F.col("c").cast("long")}
    with_tile = keyed.join(tiles.withColumns(longs), ["source_year", "r", "c"], "left")
    with_map = with_tile.join(static.withColumns(longs), ["r", "c"], "left")
    return screen_radiance(
        with_map, north=north, fallback="static_light", lat=lat
    ).drop("static_light", "r", "c")
