"""Neighbourhood jobs on rasters held as rows (r, c, value).

Square neighbourhoods are separable: one pass along rows, one along columns.
That costs a factor 2(2h+1) instead of (2h+1)**2, and no task ever holds more
than one raster line.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.probability import clip
from cindergrid.session import cut


def _line(axis, order, lo, hi, group=()):
    return Window.partitionBy(*group, axis).orderBy(order).rangeBetween(lo, hi)


def bounds(grid, group=()) -> DataFrame:
    return grid.groupBy(*group).agg(
        F.min("r").alias("_r0"), F.max("r").alias("_r1"),
        F.min("c").alias("_c0"), F.max("c").alias("_c1"),
    )


def with_bounds(grid, group=(), extent=None) -> DataFrame:
    """Attach the grid extent (per group) to every row."""
    b = bounds(extent if extent is not None else grid, group)
    if group:
        return grid.join(b, list(group))
    return grid.withColumn("_b", b.select(F.struct("*")).scalar()).select("*", "_b.*").drop("_b")


def pad_edges(grid, h: int, group=()) -> DataFrame:
    """The grid with its border cells repeated h times outwards."""
    g = with_bounds(grid, group)

    def spread(key, lo, hi):
        start = F.when(F.col(key) == F.col(lo), F.col(key) - h).otherwise(F.col(key))
        stop = F.when(F.col(key) == F.col(hi), F.col(key) + h).otherwise(F.col(key))
        return F.explode(F.sequence(start, stop))

    rows = g.withColumn("_pr", spread("r", "_r0", "_r1"))
    rows = rows.withColumn("_pc", spread("c", "_c0", "_c1"))
    inside = (F.col("_pr") == F.col("r")) & (F.col("_pc") == F.col("c"))
    return rows.withColumns({"_inside": inside, "r": F.col("_pr"), "c": F.col("_pc")}).drop(
        "_pr", "_pc", "_r0", "_r1", "_c0", "_c1"
    )


def half_window(size_deg: float, resolution: float) -> int:
    return max(1, math.ceil(size_deg / 2 / resolution))


_STATS = ("n", "s", "q", "lo", "hi")


def _finish(prefix="") -> dict[str, Column]:
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    var = clip(q / n - (s / n) * (s / n), 0.0)
    return {
        f"{prefix}min": F.col("lo"),
        f"{prefix}max": F.col("hi"),
        f"{prefix}mean": s / n + F.col("_mid"),
        f"{prefix}std": F.sqrt(var),
    }


def box_statistics(grid, h: int, value="v", group=()) -> DataFrame:
    """min, max, mean and population std over the (2h+1)**2 box of every cell.

    Values are centred on the raster mean first, which keeps the one-pass
    variance accurate.
    """
    mid = grid.agg(F.coalesce(F.avg(value), F.lit(0.0))).scalar()
    cells = grid.select(*group, "r", "c", F.col(value).cast("double").alias("v"))
    cells = pad_edges(cells.withColumn("_mid", mid), h, group)
    x = F.col("v") - F.col("_mid")
    along = _line("r", "c", -h, h, group)
    rows = cells.select(
        *group, "r", "c", "_inside", "_mid",
        F.count("v").over(along).alias("n"), F.sum(x).over(along).alias("s"),
        F.sum(x * x).over(along).alias("q"), F.min("v").over(along).alias("lo"),
        F.max("v").over(along).alias("hi"),
    )
    down = _line("c", "r", -h, h, group)
    full = rows.select(
        *group, "r", "c", "_inside", "_mid",
        F.sum("n").over(down).alias("n"), F.sum("s").over(down).alias("s"),
        F.sum("q").over(down).alias("q"), F.min("lo").over(down).alias("lo"),
        F.max("hi").over(down).alias("hi"),
    ).filter("_inside")
    return full.select(*group, "r", "c", *[e.alias(k) for k, e in _finish().items()])


def gradient_statistics(grid, h: int, res_r: float, res_c: float, value="v", group=()) -> DataFrame:
    """Gradient magnitude inside every box: central differences, one-sided at the box edge.

    A box cell's difference depends only on whether it sits on the first, an inner
    or the last line of the box, so three maps per axis are made once and summed
    along rows and then along columns.
    """
    cells = pad_edges(grid.select(*group, "r", "c", F.col(value).cast("double").alias("v")), h, group)
    in_row = Window.partitionBy(*group, "r").orderBy("c")
    in_col = Window.partitionBy(*group, "c").orderBy("r")

    def diffs(w, res):
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        v = F.col("v")
        return {"f": (after - v) / res, "m": (after - before) / (2 * res), "b": (v - before) / res}

    cells = cells.withColumns({f"_x{k}": e for k, e in diffs(in_row, res_c).items()})
    cells = cells.withColumns({f"_y{k}": e for k, e in diffs(in_col, res_r).items()})
    mag = lambda y, x: F.hypot(F.col(f"_y{y}"), F.col(f"_x{x}"))
    cells = cells.withColumns({f"_g{y}{x}": mag(y, x) for y in "fmb" for x in "fmb"})

    inner = _line("r", "c", -(h - 1), h - 1, group)
    strips = {}
    for y in "fmb":
        mid = F.col(f"_g{y}m")
        left, right = F.lag(f"_g{y}f", h).over(in_row), F.lead(f"_g{y}b", h).over(in_row)
        strips |= {
            f"_s{y}": F.sum(mid).over(inner) + left + right,
            f"_q{y}": F.sum(mid * mid).over(inner) + left * left + right * right,
            f"_lo{y}": F.least(F.min(mid).over(inner), left, right),
            f"_hi{y}": F.greatest(F.max(mid).over(inner), left, right),
        }
    rows = cells.withColumns(strips)
    core = _line("c", "r", -(h - 1), h - 1, group)

    def ends(name):
        return F.lag(f"{name}f", h).over(in_col), F.lead(f"{name}b", h).over(in_col)

    (s1, s2), (q1, q2), (l1, l2), (h1, h2) = (ends(n) for n in ("_s", "_q", "_lo", "_hi"))
    full = rows.select(
        *group, "r", "c", "_inside",
        F.lit(float((2 * h + 1) ** 2)).alias("n"), F.lit(0.0).alias("_mid"),
        (F.sum("_sm").over(core) + s1 + s2).alias("s"),
        (F.sum("_qm").over(core) + q1 + q2).alias("q"),
        F.least(F.min("_lom").over(core), l1, l2).alias("lo"),
        F.greatest(F.max("_him").over(core), h1, h2).alias("hi"),
    ).filter("_inside")
    return full.select(*group, "r", "c", *[e.alias(k) for k, e in _finish("gradient_").items()])


def insertion_index(x, start: float, step: float, size: int) -> Column:
    """First axis position whose coordinate is >= the value, clamped (ascending axis)."""
    v = F.col(x) if isinstance(x, str) else x
    return clip(F.ceil(clip((v - start) / step)), 0, size - 1).cast("long")


def attach_box_statistics(points, stats, axis_r, axis_c, lat="latitude", lon="longitude") -> DataFrame:
    """Box statistics of the cell at each point's insertion index; axes = (start, step, size)."""
    keyed = points.withColumns(
        {"r": insertion_index(lat, *axis_r), "c": insertion_index(lon, *axis_c)}
    )
    return keyed.join(stats.withColumns({"r": F.col("r").cast("long"), "c": F.col("c").cast("long")}),
                      ["r", "c"], "left")


# --- smoothing ------------------------------------------------------------------


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> tuple[int, list[float]]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return radius, [v / total for v in raw]


def _array(values) -> Column:
    # text keeps a long kernel one literal in the plan
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _scatter(cells, key, other, sums, radius, weights, lo, hi, replicate, group) -> DataFrame:
    """Spread every cell along one axis with kernel weights and add up what arrives."""
    k = F.sequence(
        F.greatest(F.col(key) - radius, F.col(lo)), F.least(F.col(key) + radius, F.col(hi))
    )
    moved = cells.withColumn("_t", F.explode(k))
    shift = F.col(key) - F.col("_t")  # source minus target
    at = (shift + radius + 1).cast("int")
    weight = F.element_at(_array(weights), at)
    if replicate:
        up, down, below, above = [], [], 0.0, 0.0
        for w in weights:
            below += w
            up.append(below)
        for w in reversed(weights):
            above += w
            down.append(above)
        down.reverse()
        first, last = F.col(key) == F.col(lo), F.col(key) == F.col(hi)
        weight = (
            F.when(first & last, 1.0)
            .when(first, F.element_at(_array(up), at))
            .when(last, F.element_at(_array(down), at))
            .otherwise(weight)
        )
    extra = [c for c in ("_r0", "_r1", "_c0", "_c1")]
    return moved.withColumn("_w", weight).groupBy(*group, other, F.col("_t").alias(key)).agg(
        *[F.sum(F.col(s) * F.col("_w")).alias(s) for s in sums],
        *[F.first(e).alias(e) for e in extra],
    )


def gaussian_density(grid, sigma: float, truncate=4.0, value="src", out="density", group=()):
    """Gaussian-weighted share of presence cells, zero outside; only presence cells move."""
    radius, w = gaussian_kernel(sigma, truncate)
    src = with_bounds(grid, group).filter(F.col(value) > 0).withColumn(
        "_v", F.col(value).cast("double")
    )
    a = _scatter(src, "c", "r", ["_v"], radius, w, "_c0", "_c1", False, group)
    b = _scatter(a, "r", "c", ["_v"], radius, w, "_r0", "_r1", False, group)
    return grid.join(b.select(*group, "r", "c", F.col("_v").alias(out)), [*group, "r", "c"], "left") \
        .withColumn(out, F.coalesce(out, F.lit(0.0)))


def gaussian_smooth(grid, sigma: float, truncate=4.0, value="v", out="smooth", group=()):
    """smooth(value) / smooth(known) over known cells, borders replicated."""
    if sigma <= 0:
        return grid.withColumn(out, F.col(value))
    radius, w = gaussian_kernel(sigma, truncate)
    known = with_bounds(grid, group).filter(F.col(value).isNotNull()).withColumns(
        {"_v": F.col(value).cast("double"), "_k": F.lit(1.0)}
    )
    a = _scatter(known, "c", "r", ["_v", "_k"], radius, w, "_c0", "_c1", True, group)
    b = _scatter(a, "r", "c", ["_v", "_k"], radius, w, "_r0", "_r1", True, group)
    smooth = b.select(
        *group, "r", "c", F.when(F.col("_k") > 1e-9, F.col("_v") / F.col("_k")).alias(out)
    )
    return grid.join(smooth, [*group, "r", "c"], "left")


def box_density(grid, size: int, value="src", out="density", group=()) -> DataFrame:
    """Sum over a size x size box divided by size**2, zero outside the raster."""
    lo, hi = -(size // 2), size - size // 2 - 1
    v = F.col(value).cast("double")
    rows = grid.withColumn("_s", F.sum(v).over(_line("r", "c", lo, hi, group)))
    return rows.withColumn(
        out, F.sum("_s").over(_line("c", "r", lo, hi, group)) / float(size * size)
    ).drop("_s")


# --- distances ------------------------------------------------------------------


def distance_to_source(grid, res_r=1.0, res_c=1.0, value="src", out="distance", group=()):
    """Exact Euclidean distance from every cell to the nearest source cell; none -> NULL.

    Pass one finds the nearest source in the cell's own column. Pass two lowers
    each raster row against its neighbours k columns away while k could still
    improve a cell; a task holds one raster row at a time.
    """
    g = list(group)
    up = Window.partitionBy(*g, "c").orderBy("r")
    is_src = F.when(F.col(value) > 0, F.col("r"))
    down = Window.partitionBy(*g, "c").orderBy(F.col("r").desc())
    so_far = (Window.unboundedPreceding, 0)
    before = F.last(is_src, ignorenulls=True).over(up.rowsBetween(*so_far))
    after = F.last(is_src, ignorenulls=True).over(down.rowsBetween(*so_far))
    gap = F.least(F.col("r") - before, after - F.col("r")).cast("double") * res_r
    cols = grid.select(*g, F.col("r").cast("long"), F.col("c").cast("long"), gap.alias("_d"))

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        first = pdf["c"].iloc[0]
        at = (pdf["c"] - first).to_numpy()
        line = np.full(int(at[-1]) + 1, np.inf)
        line[at] = np.square(pdf["_d"].fillna(np.inf).to_numpy(dtype=float))
        best = line.copy()
        k = 1
        while k < len(line) and (k * res_c) ** 2 < best[at].max():
            step = (k * res_c) ** 2
            np.minimum(best[k:], line[:-k] + step, out=best[k:])
            np.minimum(best[:-k], line[k:] + step, out=best[:-k])
            k += 1
        d = np.sqrt(best[at])
        return pdf.drop(columns="_d").assign(**{out: np.where(np.isfinite(d), d, np.nan)})

    schema = cols.drop("_d").withColumn(out, F.lit(None).cast("double")).schema
    done = cols.groupBy(*g, "r").applyInPandas(lower, schema)
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def cross_dilate(grid, value="mask", group=()) -> DataFrame:
    """1 where the cell or one of its four neighbours is 1."""
    v = F.max(value)
    return grid.withColumn(
        value,
        F.greatest(v.over(_line("r", "c", -1, 1, group)), v.over(_line("c", "r", -1, 1, group))),
    )


def cross_erode(grid, value="mask", group=()) -> DataFrame:
    """1 where the cell and its four neighbours are 1; outside the raster counts as 0."""
    keep = F.lit(1)
    for axis, order in (("r", "c"), ("c", "r")):
        w = _line(axis, order, -1, 1, group)
        full = F.count(F.lit(1)).over(w) == 3
        keep = F.least(keep, F.when(full, F.min(value).over(w)).otherwise(0))
    return grid.withColumn(value, keep)


def coast_distance(grid, res_r, res_c, value="landseamask", threshold=70.0, km=111.1) -> DataFrame:
    """Signed distance to the coast, plain mask and closed mask: land > 0, sea < 0."""
    land = grid.select("r", "c", (F.col(value) < threshold).cast("int").alias("mask"))
    out = None
    for name, mask in (("coast_km", land), ("coast_closed_km", cross_erode(cross_dilate(land)))):
        to_sea = distance_to_source(
            mask.withColumn("src", 1 - F.col("mask")), res_r, res_c, out="_sea"
        )
        to_land = distance_to_source(
            mask.withColumnRenamed("mask", "src"), res_r, res_c, out="_land"
        )
        d = to_sea.join(to_land, ["r", "c"]).select(
            "r", "c", ((F.col("_sea") - F.col("_land")) * km).alias(name)
        )
        out = d if out is None else out.join(d, ["r", "c"])
    return out


def fill_from_nearest(grid, value="v") -> DataFrame:
    """NULL cells take the value of the nearest known cell (ties: lowest row, then column).

    Buckets double in width round by round, for the cells that are still open: a known cell
    in the 3x3 buckets around a cell bounds its distance, and the 7x7 around it hold every
    nearer one. Each round joins the known cells once, at its own width; the number of
    rounds follows the widest hole.
    """
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    known = grid.filter(F.col(value).isNotNull()).groupBy(r.alias("_kr"), c.alias("_kc")).agg(F.min(value).alias("_kv"))
    gaps = grid.filter(F.col(value).isNull()).select(r.alias("r"), c.alias("c")).distinct()
    # at the width of the whole raster all buckets are neighbours
    held = F.col(value).isNotNull()
    span = grid.agg(
        F.greatest(F.max(r) - F.min(r), F.max(c) - F.min(c)).alias("width"), F.count_if(held).alias("known"), F.count_if(~held).alias("gaps")
    ).first()
    if not span["known"] or not span["gaps"]:
        return grid

    def d2(a, b):
        return (F.col("r") - F.col(a)) * (F.col("r") - F.col(a)) + (F.col("c") - F.col(b)) * (F.col("c") - F.col(b))

    def ring(cells, level, reach):
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        cells = cells.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
        return cells.withColumns(
            {"_br": F.shiftright("r", level) + F.col("_i"), "_bc": F.shiftright("c", level) + F.col("_j")}
        ).drop("_i", "_j")

    def short(x, bucket, level):
        """Distance from a cell to the nearest cell of a bucket, along one axis."""
        first = F.shiftleft(bucket, level)
        return F.greatest(F.lit(0), first - F.col(x), F.col(x) - (first + ((1 << level) - 1)))

    at, found, level = ["_br", "_bc"], None, 0
    while True:
        placed = known.withColumns({"_br": F.shiftright("_kr", level), "_bc": F.shiftright("_kc", level)})
        one = placed.groupBy(*at).agg(F.min(F.struct("_kr", "_kc")).alias("_one"))
        # merged: the size of a grown side is not known from the files it comes from
        bound = ring(gaps, level, 1).join(one.hint("merge"), at).groupBy("r", "c").agg(F.min(d2("_one._kr", "_one._kc")).alias("_d2"))
        bound = cut(bound)
        dr, dc = short("r", F.col("_br"), level), short("c", F.col("_bc"), level)
        wide = ring(bound, level, 3).filter(dr * dr + dc * dc <= F.col("_d2"))
        near = wide.join(placed.hint("merge"), at).groupBy("r", "c").agg(
            F.min(F.struct(d2("_kr", "_kc").alias("d"), "_kr", "_kc", "_kv")).alias("_n")
        )
        found = near if found is None else found.unionByName(near)
        if (1 << level) > span["width"]:
            break
        gaps = cut(gaps.join(bound.hint("merge"), ["r", "c"], "left_anti"))
        if gaps.isEmpty():
            break
        level += 1
    fill = found.select("r", "c", F.col("_n._kv").alias("_fill"))
    return grid.join(fill.hint("merge"), ["r", "c"], "left").withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


# --- presence, quality, lines, upsampling ---------------------------------------


def presence(df, column, threshold, out="present") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(column) > threshold, F.lit(False)).cast("int"))


def screen_radiance(
    df, radiance="radiance", quality="quality", good=(0, 1), lat="latitude", coverage="coverage",
    min_coverage=1, north=None, fallback=None, missing_quality=255,
) -> DataFrame:
    """Quality screening of a light sample.

    Radiance stays only where the quality flag is good; north of a latitude,
    cells with low coverage are dark (0); a missing tile takes the static map and
    gets the missing-quality flag.
    """
    value = F.when(F.col(quality).isin(list(good)), F.col(radiance))
    if north is not None:
        dark = (F.col(lat) > north) & (F.coalesce(F.col(coverage), F.lit(0)) < min_coverage)
        value = F.when(dark, 0.0).otherwise(value)
    flag = F.col(quality)
    if fallback is not None:
        gone = F.col(quality).isNull()
        value = F.when(gone, F.col(fallback)).otherwise(value)
        flag = F.when(gone, missing_quality).otherwise(flag)
    return df.withColumns({radiance: value, quality: flag})


def rasterise_lines(vertices, x0, y0, step, n_rows, n_cols, classes=None, skip_private=True,
                    way="way_id", order="seq") -> DataFrame:
    """Presence cells of tagged polylines, one vertex per input row.

    Each segment is walked in max(|dr|, |dc|) equal steps; both ends and every
    step fall into the cell of floor(position + 0.5).
    """
    v = vertices
    if classes is not None:
        v = v.filter(F.col("class").isin(list(classes)))
    if skip_private:
        v = v.filter(F.coalesce(F.col("access"), F.lit("")) != "private")
    w = Window.partitionBy(way).orderBy(order)
    v = v.withColumns({"_x": (F.col("x") - x0) / step, "_y": (y0 - F.col("y")) / step})
    seg = v.select(
        "_x", "_y", F.lead("_x").over(w).alias("_x2"), F.lead("_y").over(w).alias("_y2")
    ).filter(F.col("_x2").isNotNull())
    steps = F.greatest(
        F.ceil(F.greatest(F.abs(F.col("_x2") - F.col("_x")), F.abs(F.col("_y2") - F.col("_y")))),
        F.lit(1),
    ).cast("int")
    walk = seg.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("_i") / F.col("_n")
    cell = walk.select(
        F.floor(F.col("_y") + (F.col("_y2") - F.col("_y")) * t + 0.5).cast("long").alias("r"),
        F.floor(F.col("_x") + (F.col("_x2") - F.col("_x")) * t + 0.5).cast("long").alias("c"),
    )
    inside = F.col("r").between(0, n_rows - 1) & F.col("c").between(0, n_cols - 1)
    return cell.filter(inside).distinct()


def upsample(grid, factor: int, value="v", clip=False) -> DataFrame:
    """Bilinear values on a grid `factor` times finer, inside the original extent.

    Every block of four neighbouring cells produces its own fine cells, so the
    only shuffle is the one that brings the four corners together.
    """
    right = Window.partitionBy("r").orderBy("c")
    below = Window.partitionBy("c").orderBy("r")
    v = F.col(value).cast("double")
    a = grid.select("r", "c", v.alias("_a"), F.lead(v).over(right).alias("_b"),
                    (F.lead("c").over(right) == F.col("c") + 1).alias("_okc"))
    a = a.withColumns(
        {
            "_c": F.lead("_a").over(below), "_d": F.lead("_b").over(below),
            "_okr": F.lead("r").over(below) == F.col("r") + 1,
        }
    )
    has_c, has_r = F.coalesce("_okc", F.lit(False)), F.coalesce("_okr", F.lit(False))
    i = F.explode(F.sequence(F.lit(0), F.when(has_r, factor - 1).otherwise(0)))
    j = F.explode(F.sequence(F.lit(0), F.when(has_c, factor - 1).otherwise(0)))
    fine = a.withColumn("_i", i).withColumn("_j", j)
    ty, tx = F.col("_i") / factor, F.col("_j") / factor
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    # corners that do not exist are only reached with weight 0
    value_at = (
        F.col("_a") * (1 - ty) * (1 - tx)
        + F.when(tx > 0, F.col("_b")).otherwise(zero("_b")) * (1 - ty) * tx
        + F.when(ty > 0, F.col("_c")).otherwise(zero("_c")) * ty * (1 - tx)
        + F.when((tx > 0) & (ty > 0), F.col("_d")).otherwise(zero("_d")) * ty * tx
    )
    if clip:
        value_at = F.least(F.greatest(value_at, F.lit(0.0)), F.lit(1.0))
    return fine.select(
        (F.col("r") * factor + F.col("_i")).cast("long").alias("r"),
        (F.col("c") * factor + F.col("_j")).cast("long").alias("c"),
        value_at.alias(value),
    )
