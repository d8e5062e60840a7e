"""Candidate cells, cell-day grids and positive buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.cells import cell_coord, spread_to_neighbours
from cindergrid.operators.polygons import rings, unrolled
from cindergrid.operators.spatial import positions_in_polygons


def candidate_cells(polygons, bounds=None, resolution=0.1, name="n_name") -> DataFrame:
    """Cells whose centre lies in a polygon, clipped to bounds; country = first name.

    Only the cells of each ring's own box are generated, line by line.
    """
    each = rings(polygons, [name]).withColumn("_xs", unrolled())
    y = F.transform("_path", lambda v: v["y"].cast("double"))
    box = each.select(
        F.array_min(y).alias("y0"), F.array_max(y).alias("y1"), F.array_min("_xs").alias("x0"), F.array_max("_xs").alias("x1"),
    )
    if bounds is not None:
        lat0, lon0, lat1, lon1 = (float(b) for b in bounds)
        # a box beyond 180 degrees meets the bounds as it lies and a turn away
        turned = box.withColumn("_t", F.explode(F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)])))
        box = turned.select(
            F.greatest("y0", F.lit(lat0)).alias("y0"), F.least("y1", F.lit(lat1)).alias("y1"),
            F.greatest(F.col("x0") + F.col("_t"), F.lit(lon0)).alias("x0"), F.least(F.col("x1") + F.col("_t"), F.lit(lon1)).alias("x1"),
        ).filter("y0 <= y1 and x0 <= x1")
    # half a step of slack keeps cells whose centre rounds onto the border
    key = lambda c: (F.col(c) / resolution).cast("double")
    first = lambda c: F.ceil(key(c) - 1e-9).cast("long")
    last = lambda c: F.floor(key(c) + 1e-9).cast("long")
    lines = box.filter((first("y0") <= last("y1")) & (first("x0") <= last("x1"))).select(
        F.explode(F.sequence(first("y0"), last("y1"))).alias("lat_key"),
        first("x0").alias("_a"), last("x1").alias("_b"),
    )
    turn, half = round(360 / resolution), round(180 / resolution)
    column = F.explode(F.sequence("_a", "_b"))
    lon = F.when(F.col("_c").between(-half, half), F.col("_c")).otherwise(F.pmod(F.col("_c") + half, F.lit(turn)) - half)
    cells = lines.select("lat_key", column.alias("_c")).select("lat_key", lon.alias("lon_key")).distinct()
    spots = cells.withColumns(
        {
            "latitude": cell_coord("lat_key", resolution),
            "longitude": cell_coord("lon_key", resolution),
        }
    )
    held = positions_in_polygons(spots, polygons, [name])
    one = held.groupBy("longitude", "latitude").agg(F.min(name).alias("country"))
    return spots.join(one, ["longitude", "latitude"]).select("country", "lat_key", "lon_key")


def cell_dates(cells, start, end) -> DataFrame:
    """Every cell on every day of a closed period, generated next to its cell."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return cells.withColumn("date", F.explode(days))


def label_grid(grid, labels, on=("country", "lat_key", "lon_key", "date")) -> DataFrame:
    """0/1 labels by integer keys, each row standing for itself (weight 1)."""
    marked = labels.select(*on).distinct().withColumn("_hit", F.lit(1))
    return grid.join(marked, list(on), "left").withColumns(
        {"is_fire": F.coalesce("_hit", F.lit(0)), "eval_weight": F.lit(1.0)}
    ).drop("_hit")


def blocked_keys(positives, buffer_cells=1, buffer_days=1, date="date", cells=None) -> DataFrame:
    """Cell-days within the buffer of any positive, per country; only those of `cells`, if given."""
    base = positives.select("country", "lat_key", "lon_key", date).distinct()
    near = spread_to_neighbours(base, buffer_cells)
    if cells is not None:
        near = near.join(cells, ["country", "lat_key", "lon_key"], "left_semi")
    days = F.transform(
        F.sequence(F.lit(-buffer_days), F.lit(buffer_days)), lambda d: F.date_add(date, d)
    )
    return near.withColumn(date, F.explode(days)).distinct()


def drop_buffered(candidates, positives, buffer_cells=1, buffer_days=1, date="date") -> DataFrame:
    """Candidates farther than the buffer from every positive of their country."""
    on = ["country", "lat_key", "lon_key", date]
    return candidates.join(blocked_keys(positives, buffer_cells, buffer_days, date), on, "left_anti")


def static_strata(rows, cells, defaults, on=("country", "lat_key", "lon_key")) -> DataFrame:
    """Static columns of each row's cell, with defaults where the cell is unknown."""
    joined = rows.join(cells.select(*on, *defaults), list(on), "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    )


def per_unique_key(rows, key, job) -> DataFrame:
    """Run `job` once per distinct key and join its columns back to all rows."""
    return rows.join(job(rows.select(*key).distinct()), list(key), "left")


def assemble(anchors, blocks, key) -> DataFrame:
    """Feature blocks joined to the anchors in order; the first column of a name wins."""
    out = anchors
    for block in blocks:
        fresh = [c for c in block.columns if c not in out.columns]
        out = out.join(block.select(*key, *fresh), list(key), "left")
    return out


def replace_block(base, other, columns, key) -> DataFrame:
    """The same rows with a column family taken from a second source."""
    return base.drop(*columns).join(other.select(*key, *columns), list(key), "left").select(
        *base.columns
    )


def align_rows(rows, order, key) -> DataFrame:
    """Rows in a given key order; duplicate or missing keys are errors.

    The checks travel with the rows: a bad row raises while it is read.
    """
    counted = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rows.columns)).alias("_row")
    )
    joined = order.join(counted, list(key), "left")
    problem = (
        F.when(F.col("_n").isNull(), F.raise_error(F.lit("a requested key is missing")).cast("int"))
        .when(F.col("_n") > 1, F.raise_error(F.lit("a key is not unique")).cast("int"))
        .otherwise(F.col("_n").cast("int"))
    )
    rest = [c for c in rows.columns if c not in order.columns]
    return joined.withColumn("_ok", problem).filter("_ok = 1").select(
        *order.columns, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )
