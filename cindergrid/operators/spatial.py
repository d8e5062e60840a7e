"""Spatial joins: polygons, nearest grid values, radii and nearest events.

All of them reduce to equi-joins on coarse integer buckets followed by an exact
test, and all collapse repeated positions first, so one position holding a third
of the rows costs one lookup and is joined back by key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.cells import EARTH_RADIUS_KM
from cindergrid.functions.probability import clip
from cindergrid.operators.event_tree import event_tree, nearest, within
from cindergrid.operators.polygons import SHIFT, located, part_lists, polygon_index

XY = ("longitude", "latitude")

# --- polygons -------------------------------------------------------------------


def _bucket(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def positions_in_polygons(points, polygons, attrs, x=XY[0], y=XY[1], size=0.25) -> DataFrame:
    """(x, y, attrs) of every distinct position inside a polygon (`ring`, or `parts` with holes and islands).

    A row per polygon: equal attributes of two polygons come twice. See `polygons` for the
    index, which is built and written first.
    """
    index = polygon_index(polygons, attrs, size)
    return located(points.select(x, y).distinct(), index, x, y).select(x, y, *attrs)


def tag_points(
    points, polygons, key, attrs, how="left", x=XY[0], y=XY[1], size=0.25, unknown="Unknown"
) -> DataFrame:
    """Attributes of the polygon holding each point, one row per point.

    Overlapping polygons: the first attribute tuple in sort order. Unmatched
    points are dropped (inner) or labelled unknown (left).
    """
    hits = positions_in_polygons(points, polygons, attrs, x, y, size)
    one = hits.groupBy(x, y).agg(F.min(F.struct(*attrs)).alias("_a"))
    out = points.join(one, [x, y], how)
    fill = (lambda a: F.coalesce(F.col(f"_a.{a}").cast("string"), F.lit(unknown))) if (
        how == "left"
    ) else (lambda a: F.col(f"_a.{a}"))
    return out.select(*points.columns, *[fill(a).alias(a) for a in attrs])


def polygon_mean(
    points, polygons, value, radius_km, x=XY[0], y=XY[1], size=0.25
) -> DataFrame:
    """Mean of `value` over the polygons that meet a circle around each position.

    A polygon counts if it holds the position or one of its edges is within the
    radius (true metres on a local plane). Circles reach across 180 degrees.
    """
    per_deg = math.pi * EARTH_RADIUS_KM / 180.0
    index = polygon_index(_with_id(polygons), ["_poly", value], size)
    spots = points.select(x, y).distinct()
    inside = located(spots, index, x, y).select(x, y, "_poly", value)
    # pieces of the coarse buckets that a circle can reach, all the way round near a pole
    pad_lat = radius_km / per_deg
    far = F.abs(F.col(y)) + pad_lat
    pad_lon = F.when(far >= 89.0, 180.0).otherwise(F.least(F.lit(pad_lat) / F.cos(F.radians(far)), F.lit(180.0)))
    ring = round(360 / size)
    u, v = F.col(x) + (180.0 - SHIFT), F.col(y) + (90.0 - SHIFT)
    west = _bucket(u - pad_lon, size)
    east = F.least(_bucket(u + pad_lon, size), west + (ring - 1))
    reach = spots.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn(
        "_ay", F.explode(F.sequence(_bucket(v - pad_lat, size), _bucket(v + pad_lat, size)))
    ).withColumn("_ax", F.explode(F.transform(F.sequence(west, east), lambda b: F.pmod(b, F.lit(ring)))))
    px, py = F.pmod(u, F.lit(360.0)), v
    kx = F.cos(F.radians(F.col(y))) * per_deg

    def gap(e):
        """Distance of an edge on a local plane, its nearer copy round the globe."""
        turn = 360.0 * F.round(((e["a1"] + e["a2"]) / 2 - px) / 360.0)
        ax, ay = (e["a1"] - turn - px) * kx, (e["b1"] - py) * per_deg
        dx, dy = (e["a2"] - e["a1"]) * kx, (e["b2"] - e["b1"]) * per_deg
        along = -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        along = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        return F.hypot(ax + along * dx, ay + along * dy)

    pieces = index.pieces.filter("_edges is not null").select("_ax", "_ay", "_poly", value, "_edges")
    near = reach.join(pieces, ["_ax", "_ay"]).filter(F.exists("_edges", lambda e: gap(e) <= radius_km)).select(x, y, "_poly", value)
    met = near.unionByName(inside).distinct()
    return met.groupBy(x, y).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("polygons"))


def _with_id(polygons) -> DataFrame:
    if "_poly" in polygons.columns:
        return polygons
    return polygons.withColumn("_poly", F.xxhash64(part_lists(polygons)))


# --- grids and rasters ----------------------------------------------------------


def nearest_index(x, start: float, step: float, size: int) -> Column:
    """Index of the nearest axis value; halves go up; ends clamp. step may be negative."""
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    t = clip((v - F.lit(start)) / F.lit(step))
    # the upper neighbour in coordinate order is the lower index on a descending axis
    near = F.floor(t + 0.5) if step > 0 else F.ceil(t - 0.5)
    return clip(near, 0, size - 1).cast("long")


def nearest_on_axis(rows, x, axis, value="axis_value", out="nearest", size=None) -> DataFrame:
    """Nearest value of an irregular axis for each row; ties go to the upper neighbour.

    Every axis value owns the half-open range between the midpoints to its
    neighbours; ranges and positions meet in buckets one mean step wide.
    """
    w = Window.orderBy(value)
    cells = axis.select(value).distinct().withColumns(
        {"_prev": F.lag(value).over(w), "_next": F.lead(value).over(w)}
    )
    stats = axis.agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_distinct(value).alias("n")
    )
    frame = stats.select(
        F.struct("lo", "hi", (F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) / F.col("n"))
                 .alias("w"))
    ).scalar()
    owned = cells.withColumn("_f", frame).select(
        F.col(value).alias(out),
        F.coalesce((F.col("_prev") + F.col(value)) / 2, F.lit(float("-inf"))).alias("_from"),
        F.coalesce((F.col("_next") + F.col(value)) / 2, F.lit(float("inf"))).alias("_to"),
        "_f",
    )
    def slot(c):
        inside = F.least(F.greatest(c, F.col("_f.lo")), F.col("_f.hi"))
        return F.floor((inside - F.col("_f.lo")) / F.col("_f.w")).cast("long")

    ranges = owned.withColumn(
        "_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to"))))
    ).drop("_f")
    spots = rows.select(x).distinct().withColumn("_f", frame).withColumn("_slot", slot(F.col(x)))
    hit = spots.join(ranges, "_slot").filter(
        (F.col(x) >= F.col("_from")) & (F.col(x) < F.col("_to"))
    )
    return rows.join(hit.select(x, out).distinct(), x, "left")


def sample_raster(points, raster, transform, values, prefix="", x=XY[0], y=XY[1]) -> DataFrame:
    """Raster values under each point by the affine transform; NULL outside.

    transform = (x origin, x pixel, y origin, y pixel); raster columns r, c.
    """
    x0, dx, y0, dy = transform
    keyed = points.withColumns(
        {
            "_r": F.floor((F.col(y) - y0) / dy).cast("long"),
            "_c": F.floor((F.col(x) - x0) / dx).cast("long"),
        }
    )
    layer = raster.select(
        F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"),
        *[F.col(v).alias(prefix + v) for v in values],
    )
    return keyed.join(layer, ["_r", "_c"], "left").drop("_r", "_c")


def tile_address(points, tile_deg=10.0, pixels=2400, x=XY[0], y=XY[1]) -> DataFrame:
    """Tile (h, v) and pixel (row, col) of each point, with a validity flag."""
    fx = (F.col(x) + 180.0) / tile_deg
    fy = (90.0 - F.col(y)) / tile_deg
    h, v = F.floor(fx), F.floor(fy)

    def pixel(f, whole):
        return F.least(F.floor((f - whole) * pixels), F.lit(pixels - 1)).cast("long")

    valid = F.col(x).between(-180.0, 180.0) & F.col(y).between(-90.0, 90.0)
    last_h, last_v = int(360 / tile_deg) - 1, int(180 / tile_deg) - 1
    return points.withColumns(
        {
            "h": h.cast("long"), "v": v.cast("long"), "row": pixel(fy, v), "col": pixel(fx, h),
            "valid": F.coalesce(valid & h.between(0, last_h) & v.between(0, last_v), F.lit(False)),
        }
    )


def sample_tiles(points, tiles, values, on=("h", "v", "row", "col")) -> DataFrame:
    return points.join(tiles.select(*on, *values), list(on), "left")


def nearest_year(rows, years, year="year", out="source_year") -> DataFrame:
    """Nearest available year; ties to the earlier; a missing year takes the latest."""
    known = years.agg(F.array_sort(F.collect_set("available_year")).alias("y")).scalar()
    pick = F.array_min(
        F.transform("_y", lambda v: F.struct(F.abs(v - F.col(year)).alias("gap"), v.alias("y")))
    )["y"]
    return rows.withColumn("_y", known).withColumn(
        out, F.when(F.col(year).isNull(), F.array_max("_y")).otherwise(pick)
    ).drop("_y")


def bilinear_sample(points, grid, x0, dx, y0, dy, value="v", x=XY[0], y=XY[1]) -> DataFrame:
    """Bilinear value at each position; NULL where one of the needed cells is missing."""
    spots = points.select(x, y).distinct()
    fx, fy = (F.col(x) - x0) / dx, (F.col(y) - y0) / dy
    spots = spots.withColumns({"_fx": fx, "_fy": fy}).withColumns(
        {"_c0": F.floor("_fx").cast("long"), "_r0": F.floor("_fy").cast("long")}
    )
    wx, wy = F.col("_fx") - F.col("_c0"), F.col("_fy") - F.col("_r0")
    corner = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("_r0") + a).alias("r"), (F.col("_c0") + b).alias("c"),
                    ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w"),
                )
                for a in (0, 1) for b in (0, 1)
            ]
        )
    )
    need = spots.select(x, y, corner.alias("_k")).select(
        x, y, F.col("_k.r").alias("r"), F.col("_k.c").alias("c"), F.col("_k.w").alias("w")
    ).filter(F.col("w") != 0)
    got = need.join(grid.select("r", "c", value), ["r", "c"], "left")
    done = got.groupBy(x, y).agg(
        F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col("w") * F.col(value))).alias(value)
    )
    return points.join(done, [x, y], "left")


# --- radii and nearest events ---------------------------------------------------


def counts_within(points, events, radii_km, x=XY[0], y=XY[1], weight=None) -> DataFrame:
    """Events within each radius of every distinct position, and their density.

    Nodes of an adaptive quadtree that lie inside a radius add their pre-summed count; only
    leaves cut by a circle compare single event positions, and no leaf holds more than
    a stated number of them. Circles reach across 180 degrees and the poles.
    """
    tree = event_tree(events, x, y, F.col(weight) if weight else None)
    spots = points.select(x, y).distinct()
    out = spots.join(within(spots, tree, radii_km, x, y), [x, y], "left")
    cols = []
    for i, r in enumerate(radii_km):
        n = F.coalesce(F.col(f"_r{i}"), F.lit(0.0))
        cols += [n.alias(f"count_{r:g}km"), (n / (math.pi * r * r)).alias(f"density_{r:g}km")]
    return out.select(x, y, *cols)


def nearest_event_km(points, events, x=XY[0], y=XY[1], out="nearest_km") -> DataFrame:
    """Great-circle distance from every distinct position to its nearest event, by branch and bound."""
    return nearest(points, event_tree(events, x, y), x, y, out)[0]


def tolerant_labels(rows, radius_deg, group=(), label="is_fire", lat="lat", lon="lon",
                    out="tolerant") -> DataFrame:
    """1 where a positive of the same group lies within a radius (cos-latitude scaled).

    Distinct positions are tested, not rows; each looks only at buckets one
    radius wide around it.
    """
    g = list(group)
    pos = rows.filter(F.col(label) > 0).select(*g, F.col(lat).alias("_pa"), F.col(lon).alias("_po"))
    pos = pos.distinct()
    scale = pos.groupBy(*g).agg(
        F.greatest(F.cos(F.radians(F.avg("_pa"))), F.lit(0.2)).alias("_k")
    )
    spots = rows.select(*g, lat, lon).distinct()
    step = F.lit(float(radius_deg))
    if g:
        spots, pos = spots.join(scale, g), pos.join(scale, g)
    else:
        k = scale.scalar()
        spots, pos = spots.withColumn("_k", k), pos.withColumn("_k", k).filter("_k is not null")
    place = lambda a, o: {
        "_by": F.floor(F.col(a) / step).cast("long"),
        "_bx": F.floor(F.col(o) * F.col("_k") / step).cast("long"),
    }
    around = F.sequence(F.lit(-1), F.lit(1))
    spots = spots.withColumns(place(lat, lon))
    pos = pos.withColumns(place("_pa", "_po")).drop("_k")
    # positives per bucket are spread to the 9 buckets that can see them
    pos = pos.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    pos = pos.withColumns({"_bx": F.col("_bx") + F.col("_dx"), "_by": F.col("_by") + F.col("_dy")})
    dy = F.col(lat) - F.col("_pa")
    dx = (F.col(lon) - F.col("_po")) * F.col("_k")
    hit = spots.join(pos.drop("_dx", "_dy"), [*g, "_bx", "_by"]).filter(
        dy * dy + dx * dx <= float(radius_deg) ** 2
    )
    near = hit.select(*g, lat, lon).distinct().withColumn("_near", F.lit(1))
    return rows.join(near, [*g, lat, lon], "left").withColumn(
        out, F.greatest(F.col(label), F.coalesce("_near", F.lit(0)))
    ).drop("_near")


def neighbourhood_labels(rows, radius=1, label="is_fire", keys=("date", "lat_key", "lon_key"),
                         group=(), out="near_label") -> DataFrame:
    """1 where any positive of the same day lies within `radius` cells (square)."""
    from cindergrid.functions.cells import spread_to_neighbours

    at = [*group, *keys]
    pos = rows.filter(F.col(label) == 1).select(*at).distinct()
    spread = spread_to_neighbours(pos, radius, keys[1], keys[2]).distinct()
    marked = rows.join(spread.withColumn("_hit", F.lit(1)), at, "left")
    return marked.withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def semi_join_cells(rows, cells, on=("lat_key", "lon_key")) -> DataFrame:
    return rows.join(cells.select(*on).distinct(), list(on), "left_semi")


def grid_difference(a, b, on=("lat_key", "lon_key"), value="v", group=()) -> DataFrame:
    """MAE, RMSE and largest difference over cells present in both grids."""
    both = a.select(*on, F.col(value).alias("_a")).join(
        b.select(*on, F.col(value).alias("_b")), list(on)
    )
    d = F.col("_a") - F.col("_b")
    return both.filter(d.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.max(F.abs(d)).alias("max_abs"),
    )


# --- fragment routing -----------------------------------------------------------


def route_fragments(rows, fragments, n_days, key, lat="latitude", lon="longitude", date="date",
                    step=0.1) -> DataFrame:
    """First fragment (by priority) covering each row's whole lookback; else NULL.

    The fragment catalogue is a handful of file groups and travels as one array
    value; rows are tested in place, with half a cell of tolerance.
    """
    plan = fragments.agg(
        F.array_sort(
            F.collect_list(
                F.struct("priority", "fragment_id", "first_date", "last_date", "lat_min",
                         "lat_max", "lon_min", "lon_max", "lon_convention")
            )
        ).alias("f")
    ).scalar()
    half = step / 2
    wide = F.pmod(F.col(lon), F.lit(360.0))
    start = F.date_sub(F.col(date), n_days - 1)
    fits = F.filter(
        "_f",
        lambda f: (f["first_date"] <= start) & (f["last_date"] >= F.col(date))
        & (F.col(lat) >= f["lat_min"] - half) & (F.col(lat) <= f["lat_max"] + half)
        & (F.when(f["lon_convention"] == 360, wide).otherwise(F.col(lon)) >= f["lon_min"] - half)
        & (F.when(f["lon_convention"] == 360, wide).otherwise(F.col(lon)) <= f["lon_max"] + half),
    )
    return rows.withColumn("_f", plan).withColumn(
        "fragment_id", F.try_element_at(F.transform(fits, lambda f: f["fragment_id"]), F.lit(1))
    ).drop("_f")


def coverage_report(routed, variable="variable", date="date") -> DataFrame:
    """Required and covered ranges and row counts per variable."""
    hit = F.col("fragment_id").isNotNull()
    return routed.groupBy(variable).agg(
        F.min(date).alias("required_from"),
        F.max(date).alias("required_to"),
        F.count_if(hit).alias("covered_rows"),
        F.count_if(~hit).alias("missing_rows"),
    )


def fully_covered(routed, key, variable="variable") -> DataFrame:
    """Keys covered for every variable."""
    return routed.groupBy(key).agg(F.bool_and(F.col("fragment_id").isNotNull()).alias("_ok")).filter(
        "_ok"
    ).select(key)


def common_footprint(extents) -> DataFrame:
    """Intersection box and period of several sources."""
    box = extents.agg(
        F.max("lat_min").alias("lat_min"), F.min("lat_max").alias("lat_max"),
        F.max("lon_min").alias("lon_min"), F.min("lon_max").alias("lon_max"),
        F.max("first_date").alias("first_date"), F.min("last_date").alias("last_date"),
    )
    ok = (
        (F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max"))
        & (F.col("first_date") <= F.col("last_date"))
    )
    return box.withColumn("overlaps", ok)


def inside_footprint(rows, box, lat="lat_key", lon="lon_key", date="date") -> DataFrame:
    """Rows inside the common box and period."""
    b = box.select(F.struct(*box.columns)).scalar()
    r = rows.withColumn("_b", b)
    inside = (
        F.col(lat).between(F.col("_b.lat_min"), F.col("_b.lat_max"))
        & F.col(lon).between(F.col("_b.lon_min"), F.col("_b.lon_max"))
        & F.col(date).between(F.col("_b.first_date"), F.col("_b.last_date"))
    )
    return r.filter(inside).drop("_b")
