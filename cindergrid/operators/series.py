"""Lookback series and the features taken from them.

A series is an array column, oldest value first. Feature expressions are plain
columns, so only the requested families are computed. Lookbacks come from blocks of
64 days with running sums, so that a window of any width is two look-ups.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.session import cut

CELL = ("lat_key", "lon_key")

# --- lookback -------------------------------------------------------------------


BLOCK = 64  # days of a block


def _day(date) -> Column:
    return F.datediff(date, F.lit("1970-01-01"))


def series_store(cubes: dict[str, DataFrame], n_days, needs=None, cell=CELL, date="date", value="v") -> DataFrame:
    """Blocks of 64 days per cell: one row holds all variables, each with the n_days - 1 days before.

    Columns: cell, _block, and per variable a struct of its first day `t`, the gap-free daily
    values `h` and what `needs` (variable -> parts, see `_parts`) asks for: running sums,
    running counts of unusable values, running products and minima or maxima of power-of-two
    spans. Any window of up to n_days days is then two look-ups.

    Each variable lies gap-free between the first and last day of its source: gaps are
    interpolated linearly in time between the nearest known days, before the first and
    after the last known day of a cell the nearest two are extrapolated. A block fills its
    gaps from its own days and its neighbours' last and first known ones. The cubes are
    read once; their blocks are written to the checkpoint folder.
    """
    names = list(cubes)
    rows = None
    for i, name in enumerate(names):
        one = cubes[name].filter(F.col(value).isNotNull() & F.col(date).isNotNull()).select(
            *cell, F.lit(i).alias("_var"), _day(date).alias("t"), F.col(value).cast("double").alias("v")
        )
        rows = one if rows is None else rows.unionByName(one)
    points = F.array_sort(F.collect_list(F.struct("t", "v")))
    held = cut(rows.withColumn("_block", F.floor(F.col("t") / BLOCK).cast("int")).groupBy(*cell, "_var", "_block").agg(points.alias("_p")))
    spans = held.groupBy("_var").agg(F.min(F.col("_p")[0]["t"]).alias("_a"), F.max(F.element_at("_p", -1)["t"]).alias("_b"))
    own = [*cell, "_var"]
    ends = held.groupBy(*own).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(F.slice("_p", 1, 2)))), 1, 2).alias("_head"),
        F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list(F.slice(F.reverse("_p"), 1, 2))))), 1, 2).alias("_last"),
    ).join(F.broadcast(spans), "_var")  # one row per variable
    every = ends.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / BLOCK).cast("int"), F.floor(F.col("_b") / BLOCK).cast("int"))))
    full = every.join(held, [*own, "_block"], "left")
    order = Window.partitionBy(*own).orderBy("_block")
    # looking ahead is looking back in reverse order
    ahead = Window.partitionBy(*own).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({
        "_before": F.last(F.element_at("_p", -1), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.last(F.col("_p")[0], ignorenulls=True).over(ahead),
        "_from": F.greatest(F.col("_block") * BLOCK, "_a"), "_to": F.least(F.col("_block") * BLOCK + (BLOCK - 1), "_b"),
    })

    def line(two, t):
        """The straight line through two points (array, nearest first) at day t; NULL for one point."""
        p, q = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        return F.struct(t.alias("t"), (p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / (q["t"] - p["t"])).alias("v"))

    known = F.coalesce("_p", F.array().cast(held.schema["_p"].dataType))
    left = F.when(F.col("_before").isNotNull(), F.array("_before")).when(
        F.col("_head")[0]["t"] > F.col("_from"), F.array(line(F.col("_head"), F.col("_from")))
    ).otherwise(F.array().cast(held.schema["_p"].dataType))
    right = F.when(F.col("_after").isNotNull(), F.array("_after")).when(
        F.col("_last")[0]["t"] < F.col("_to"), F.array(line(F.col("_last"), F.col("_to")))
    ).otherwise(F.array().cast(held.schema["_p"].dataType))
    full = full.withColumn("_q", F.concat(left, known, right)).select(*own, "_block", "_from", "_to", "_q")
    start, end = F.col("_from"), F.col("_to")

    def between(p, q):
        a, b = F.greatest(p["t"], start), F.least(q["t"] - 1, end)
        steps = F.transform(
            F.sequence(a, F.greatest(b, a)),
            lambda t: F.when(t == p["t"], p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / (q["t"] - p["t"])),
        )
        return F.when(a <= b, steps).otherwise(F.array().cast("array<double>"))

    size = F.size("_q")
    pairs = F.when(size > 1, F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: between(F.get("_q", i - 1), F.get("_q", i))
    ))).otherwise(F.array().cast("array<double>"))
    last = F.element_at("_q", -1)
    values = F.concat(pairs, F.when(last["t"] <= end, F.array(last["v"])).otherwise(F.array().cast("array<double>")))
    daily = full.select(*own, "_block", F.col("_from").alias("t"), values.alias("h"))
    # the days before, from as many blocks as they take
    depth = -(-(n_days - 1) // BLOCK)
    before = [F.coalesce(F.lag("h", k).over(order), F.array().cast("array<double>")) for k in range(depth, 0, -1)]
    if before:
        daily = daily.withColumn("_halo", F.concat(*before)).withColumn("_over", F.greatest(F.size("_halo") - (n_days - 1), F.lit(0)))
        daily = daily.select(
            *own, "_block", (F.col("t") - F.size("_halo") + F.col("_over")).alias("t"),
            F.concat(F.slice("_halo", F.col("_over") + 1, F.greatest(F.size("_halo"), F.lit(1))), "h").alias("h"),
        )
    parts = dict.fromkeys(p for name in names for p in (needs or {}).get(name, ()))
    usable = lambda x: x.isNotNull() & ~F.isnan(x)
    # columns of their own: inside an array function they would be worked out for every value
    daily = daily.withColumn("_x0", F.coalesce(F.get(F.filter("h", usable), F.lit(0)), F.lit(0.0)))
    daily = daily.withColumn("_x", F.transform("h", lambda x: F.when(usable(x), x - F.col("_x0")).otherwise(0.0)))
    made = daily.select(*own, "_block", F.struct("t", "h", *[c.alias(p) for p, c in _parts(parts).items()]).alias("_s"))
    return made.groupBy(*cell, "_block").agg(*[F.first(F.when(F.col("_var") == i, F.col("_s")), ignorenulls=True).alias(f"_s{i}") for i in range(len(names))])


def _running(xs) -> Column:
    """0 and the sums of the first 1, 2, ... values."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _exact(xs) -> Column:
    """As `_running`, with what each addition rounds off kept beside (a + b), so that differences are those of exact sums."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def add(last, x):
        total = last["a"] + x
        part = total - last["a"]
        return pair(total, last["b"] + ((last["a"] - (total - part)) + (x - part)))

    return F.aggregate(xs, F.array(pair(F.lit(0.0), F.lit(0.0))), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))


def _parts(parts) -> dict[str, Column]:
    """Columns of a block's arrays over `h`; sums are of values less the block's first, unusable values count as it.

    x0: that first value; m: running sums of the values themselves; bad: running number of NULL and NaN values; s, ss, st: running
    sums of x, x squared and place times x; p_k: of x times the x of k days before;
    min_j, max_j: least and largest of 2**j days from each day on.
    """
    if not parts:
        return {}
    usable = lambda x: x.isNotNull() & ~F.isnan(x)
    shifted = F.col("_x")
    out = {"x0": F.col("_x0"), "bad": _running(F.transform("h", lambda x: F.when(usable(x), 0.0).otherwise(1.0)))}
    made = {
        "m": lambda: _exact(F.transform("h", lambda x: F.when(usable(x), x).otherwise(0.0))),
        "s": lambda: _running(shifted),
        "ss": lambda: _running(F.transform(shifted, lambda x: x * x)),
        "st": lambda: _running(F.transform(shifted, lambda x, i: x * (i + 1))),
    }
    for part in parts:
        kind, _, k = part.partition("_")
        if kind == "p":
            early = F.concat(F.array_repeat(F.lit(0.0), int(k)), shifted)
            out[part] = _running(F.zip_with(shifted, F.slice(early, F.lit(1), F.size("h")), lambda a, b: a * b))
        elif kind in ("min", "max"):
            pick = F.least if kind == "min" else F.greatest
            level = F.col("h")
            for j in range(int(k)):
                later = F.slice(level, F.lit(2**j + 1), F.greatest(F.size(level), F.lit(1)))
                level = F.zip_with(level, later, lambda a, b: pick(a, b))
            out[part] = level
        elif part in made:
            out[part] = made[part]()
    return out


def _needs(family, p, n_days) -> list[str]:
    """Parts of the store a feature reads."""
    if family in ("min", "max"):
        return ["bad", f"{family}_{max(0, p.bit_length() - 1)}"]
    return {
        "mean": ["bad", "m"], "std": ["bad", "s", "ss"], "trend_slope": ["bad", "s", "st"], "trend_intercept": ["bad", "s", "st"],
        "autocorr": ["bad", "s", "ss", f"p_{p}"],
    }.get(family, [])


def _stored(s: Column, at: Column, days: Column, family, p, n_days) -> Column | None:
    """A feature of the n_days days up to place `at` of a block by two look-ups, or None if the family has none."""
    run = lambda part, k: F.element_at(s[part], k + 1)
    over = lambda part, w, back=0: run(part, at - back) - run(part, at - back - w)
    if family == "lag":
        return F.element_at(s["h"], at - p + 1) if p <= n_days else F.lit(None).cast("double")
    if family in ("diff", "pct_change"):
        if p >= n_days:
            return F.lit(None).cast("double")
        new, old = F.element_at(s["h"], at), F.element_at(s["h"], at - p)
        return new - old if family == "diff" else (new - old) / F.nullif(old, F.lit(0.0))
    if family not in ("mean", "std", "min", "max", "trend_slope", "trend_intercept", "autocorr"):
        return None
    if p > n_days or (p < 1 and family != "autocorr"):
        return F.lit(None).cast("double")
    if family == "mean":
        new, old = run("m", at), run("m", at - p)
        return ((new["a"] - old["a"]) + (new["b"] - old["b"])) / p
    if family == "std":
        # where the sums cancel too far, the days themselves are read
        spread = over("ss", p) / p - (over("s", p) / p) * (over("s", p) / p)
        return F.when(spread > 1e-6 * run("ss", at), F.sqrt(spread)).otherwise(std(days, p))
    if family in ("min", "max"):
        span = 2 ** (p.bit_length() - 1)
        first, last = F.element_at(s[f"{family}_{p.bit_length() - 1}"], at - p + 1), F.element_at(s[f"{family}_{p.bit_length() - 1}"], at - span + 1)
        return F.least(first, last) if family == "min" else F.greatest(first, last)
    if family.startswith("trend"):
        middle, sxx = (p - 1) / 2.0, sum((i - (p - 1) / 2.0) ** 2 for i in range(p))
        if not sxx:
            return F.lit(None).cast("double")
        slope = (over("st", p) - (at - p + 1 + middle) * over("s", p)) / sxx
        return slope if family == "trend_slope" else over("s", p) / p + s["x0"] - slope * middle
    n = n_days - p
    if n <= 1:
        return F.lit(None).cast("double")
    a, b, aa, bb = over("s", n, p), over("s", n), over("ss", n, p), over("ss", n)
    va, vb = n * aa - a * a, n * bb - b * b
    clear = F.least(va, vb) > 1e-6 * n * run("ss", at)
    return F.when(clear, (n * over(f"p_{p}", n) - a * b) / (F.sqrt(va) * F.sqrt(vb))).otherwise(autocorr(days, p))


def _beside(rows, store, date="date", cell=CELL) -> DataFrame:
    return rows.withColumn("_block", F.floor(_day(date) / BLOCK).cast("int")).join(store, [*cell, "_block"], "left")


def _cut_out(s: Column, date, n_days) -> tuple[Column, Column, Column]:
    """Place of the row's day in its block, whether all n_days lie in the source, and those days."""
    at = _day(date) - s["t"] + 1
    whole = (at >= n_days) & (at <= F.size(s["h"]))
    return at, whole, F.when(whole, F.slice(s["h"], F.greatest(at - n_days + 1, F.lit(1)), F.lit(n_days)))


def lookback(rows, cube, n_days, cell=CELL, date="date", value="v", out="series") -> DataFrame:
    """Last n_days daily values up to each row's date; NULL if not fully covered.

    One join with the blocks of `series_store`; a row meets one block, never a whole history.
    """
    joined = _beside(rows, series_store({"v": cube}, n_days, None, cell, date, value), date, cell)
    return joined.select(*[F.col(c) for c in rows.columns], _cut_out(F.col("_s0"), date, n_days)[2].alias(out))


def lookback_features(rows, cubes: dict[str, DataFrame], n_days, names, cell=CELL, date="date", value="v") -> DataFrame:
    """Requested features (var_family[_param]) of the n_days days up to each row's date, for all variables in one join.

    Windows with NULL or NaN days, and families without look-ups, are read from the days themselves.
    """
    wanted = parse_request(names, cubes)
    needs = {v: [p for f in wanted.values() if f[0] == v for p in _needs(f[1], f[2] or 0, n_days)] for v in cubes}
    joined = _beside(rows, series_store(cubes, n_days, needs, cell, date, value), date, cell)
    place = {}
    for i, _ in enumerate(cubes):
        at, whole, _ = _cut_out(F.col(f"_s{i}"), date, n_days)
        place[f"_at{i}"] = F.when(whole, at)
    joined = joined.withColumns(place)
    out = {}
    for name, (variable, family, p) in wanted.items():
        i = list(cubes).index(variable)
        s, at = F.col(f"_s{i}"), F.col(f"_at{i}")
        days = F.when(at.isNotNull(), F.slice(s["h"], at - n_days + 1, F.lit(n_days)))
        slow, fast = feature(days, family, p), _stored(s, at, days, family, p, n_days)
        if fast is None:
            out[name] = slow
        elif family in ("lag", "diff", "pct_change"):
            out[name] = F.when(at.isNotNull(), fast)
        else:
            sound = F.element_at(s["bad"], at + 1) == F.element_at(s["bad"], at - n_days + 1)
            out[name] = F.when(sound, fast).when(at.isNotNull(), slow)
    return joined.select(*[F.col(c) for c in rows.columns], *[c.alias(n) for n, c in out.items()])


# --- features -------------------------------------------------------------------


def _tail(s: Column, w: int) -> Column:
    return F.when(F.size(s) >= w, F.slice(s, F.size(s) - w + 1, F.lit(w)))


def _sum(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x)


def lag(s, k):
    return F.when(F.size(s) >= k, F.element_at(s, F.size(s) - k + 1))


def mean(s, w):
    return _sum(_tail(s, w)) / w


def std(s, w):
    # one pass, shifted by the newest value so that large levels do not cancel
    x0 = lag(s, 1)

    def finish(acc):
        spread = acc["b"] / w - (acc["a"] / w) * (acc["a"] / w)
        # a NaN stays unknown; the fold itself stands in the plan once
        return F.sqrt(F.when(~F.isnan(spread), F.greatest(spread, F.lit(0.0))))

    return F.aggregate(
        _tail(s, w), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, x: F.struct(
            (acc["a"] + (x - x0)).alias("a"), (acc["b"] + (x - x0) * (x - x0)).alias("b")
        ),
        finish,
    )


def minimum(s, w):
    return F.array_min(_tail(s, w))


def maximum(s, w):
    return F.array_max(_tail(s, w))


def median(s, w):
    o = F.array_sort(_tail(s, w))
    return (F.element_at(o, (w + 1) // 2) + F.element_at(o, w // 2 + 1)) / 2


def ewm(s, span):
    alpha = 2.0 / (span + 1)
    return F.when(
        F.size(s) >= 1,
        F.aggregate(
            F.slice(s, F.lit(2), F.size(s)), F.element_at(s, 1),
            lambda acc, x: acc + (x - acc) * alpha,
        ),
    )


def diff(s, k):
    return F.when(F.size(s) > k, lag(s, 1) - lag(s, k + 1))


def pct_change(s, k):
    return F.when(F.size(s) > k, (lag(s, 1) - lag(s, k + 1)) / F.nullif(lag(s, k + 1), F.lit(0.0)))


def autocorr(s, k):
    """Pearson correlation of the series with itself k days earlier."""
    n = F.size(s) - k
    x0 = lag(s, 1)
    names = ("a", "b", "aa", "bb", "ab")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names])
    pairs = F.zip_with(
        F.slice(s, F.lit(1), F.greatest(n, F.lit(0))),
        F.slice(s, F.lit(k + 1), F.greatest(n, F.lit(0))),
        lambda a, b: F.struct((a - x0).alias("a"), (b - x0).alias("b")),
    )

    def add(t, p):
        a, b = p["a"], p["b"]
        step = {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}
        return F.struct(*[(t[c] + step[c]).alias(c) for c in names])

    def finish(t):
        va, vb = n * t["aa"] - t["a"] * t["a"], n * t["bb"] - t["b"] * t["b"]
        # relative to the squares, so that the unit of the series does not matter
        varies = (va > 1e-12 * n * t["aa"]) & (vb > 1e-12 * n * t["bb"])
        return F.when((n > 1) & varies, (n * t["ab"] - t["a"] * t["b"]) / (F.sqrt(va) * F.sqrt(vb)))

    return F.aggregate(pairs, zero, add, finish)


def cumprod(s):
    ok = F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0))
    return F.when(ok & (F.size(s) > 0), F.aggregate(s, F.lit(1.0), lambda a, x: a * x))


def trend_slope(s, w):
    x_mean = (w - 1) / 2.0
    sxx = sum((i - x_mean) ** 2 for i in range(w))
    t = _tail(s, w)
    sxy = _sum(F.transform(t, lambda v, i: v * (i.cast("double") - x_mean)))
    return sxy / sxx if sxx else F.lit(None).cast("double")


def trend_intercept(s, w):
    return mean(s, w) - trend_slope(s, w) * ((w - 1) / 2.0)


def fft_peaks(s: Column) -> Column:
    """Three largest non-constant magnitudes of the real Fourier transform."""
    n = F.size(s)

    def magnitude(k):
        turn = F.lit(2.0 * math.pi) * k / n
        waves = F.transform(s, lambda v, i: F.struct((v * F.cos(turn * i)).alias("a"), (v * F.sin(turn * i)).alias("b")))
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
        add = lambda t, x: F.struct((t["a"] + x["a"]).alias("a"), (t["b"] + x["b"]).alias("b"))
        return F.aggregate(waves, zero, add, lambda t: F.hypot(t["a"], t["b"]))

    whole = s.isNotNull() & (n > 1) & ~F.exists(s, lambda x: x.isNull())
    # a range that is empty for short series would count down
    steps = F.sequence(F.lit(1), F.greatest(F.floor(n / 2), F.lit(1)).cast("int"))
    return F.when(whole, F.slice(F.reverse(F.array_sort(F.transform(steps, magnitude))), 1, 3))


FAMILIES = {
    "lag": lag, "mean": mean, "std": std, "min": minimum, "max": maximum, "median": median,
    "ewm": ewm, "diff": diff, "pct_change": pct_change, "autocorr": autocorr,
    "trend_slope": trend_slope, "trend_intercept": trend_intercept,
}


def parse_request(names, variables) -> dict[str, tuple[str, str, int | None]]:
    """Feature names var_family[_param] -> (variable, family, parameter)."""
    out = {}
    families = "|".join(sorted([*FAMILIES, "fft_peak", "cumprod"], key=len, reverse=True))
    for name in names:
        for var in sorted(variables, key=len, reverse=True):
            m = re.fullmatch(rf"{re.escape(var)}_({families})(?:_(\d+))?", name)
            if m:
                out[name] = (var, m[1], int(m[2]) if m[2] else None)
                break
    return out


def feature(s: Column, family: str, parameter: int | None) -> Column:
    known = F.exists(s, lambda x: x.isNotNull() & ~F.isnan(x))
    if family == "cumprod":
        value = cumprod(s)
    elif family == "fft_peak":
        return F.try_element_at(fft_peaks(s), F.lit(parameter))
    else:
        value = FAMILIES[family](s, parameter)
    return F.when(known, value)


def add_features(df, names, series: dict[str, str]) -> DataFrame:
    """Add the requested features; `series` maps a variable to its array column."""
    wanted = parse_request(names, series)
    return df.withColumns(
        {n: feature(F.col(series[v]), fam, p) for n, (v, fam, p) in wanted.items()}
    )


def grid_features(cube, on_date, n_days, names, variable, cell=CELL) -> DataFrame:
    """Requested features of every grid cell for one date."""
    cells = cube.select(*cell).distinct().withColumn("date", F.lit(on_date).cast("date"))
    return lookback_features(cells, {variable: cube}, n_days, names, cell)


# --- event history --------------------------------------------------------------


def event_history(rows, events, radii, windows, days_since_radii=(), min_lag=30, cap=365,
                  key=("country", "lat_key", "lon_key"), date="date", weight="count") -> DataFrame:
    """Event counts in past lag windows around each row, and days since the last event.

    Events are first summed per cell-day and spread to the cells that can see
    them; rows are first reduced to distinct cell-days. A cell therefore never
    has more than one record per calendar day in its window, however many rows
    or events it holds. windows: name -> (start lag, end lag), both included.
    """
    every = sorted({*radii, *days_since_radii})
    cell_day = events.groupBy(*key, date).agg(
        F.sum(F.greatest(F.col(weight), F.lit(1))).alias("_w")
    )
    wanted = rows.select(*key, date).distinct()
    # one spread to the widest radius; the distance says which radii see the event
    widest = max(every)
    span = range(-widest, widest + 1)
    offsets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(max(abs(i), abs(j))).alias("d"))
        for i in span for j in span
    ])
    lat, lon = key[-2:]
    near = cell_day.withColumn("_o", F.explode(offsets)).withColumns(
        {lat: F.col(lat) + F.col("_o.i"), lon: F.col(lon) + F.col("_o.j"), "_d": F.col("_o.d")}
    )
    both = near.select(*key, date, "_w", "_d", F.lit(False).alias("_row")).unionByName(
        wanted.withColumns({"_w": F.lit(0).cast("bigint"), "_d": F.lit(0), "_row": F.lit(True)})
    )
    daily = both.groupBy(*key, date).agg(
        *[F.sum(F.when(F.col("_d") <= r, F.col("_w")).otherwise(0)).alias(f"_w{r}") for r in every],
        F.bool_or("_row").alias("_row"),
    ).withColumn("_t", F.datediff(date, F.lit("1970-01-01")))
    w = Window.partitionBy(*key).orderBy("_t")
    cols = {}
    for r in radii:
        for name, (start, end) in windows.items():
            total = F.sum(f"_w{r}").over(w.rangeBetween(-end, -start))
            cols[f"past_event_count_r{r}_{name}"] = F.coalesce(total, F.lit(0))
    for r in days_since_radii:
        before = w.rangeBetween(Window.unboundedPreceding, -max(0, min_lag))
        last = F.max(F.when(F.col(f"_w{r}") > 0, F.col("_t"))).over(before)
        gap = F.least(F.col("_t") - last, F.lit(cap + 1))
        cols[f"days_since_event_r{r}"] = F.coalesce(gap, F.lit(cap + 1))
    found = daily.withColumns(cols).filter("_row").select(*key, date, *cols)
    return rows.join(found, [*key, date], "left")


# --- tensors --------------------------------------------------------------------


def channel_tensor(rows, cubes: dict[str, DataFrame], n_days, cell=CELL, date="date") -> DataFrame:
    """One array per variable, stacked as array<array<float>> in the given order."""
    joined = _beside(rows, series_store(cubes, n_days, None, cell, date), date, cell)
    days = [_cut_out(F.col(f"_s{i}"), date, n_days)[2].cast("array<float>") for i in range(len(cubes))]
    return joined.select(*[F.col(c) for c in rows.columns], F.array(*days).alias("tensor"))


def spatial_patch(rows, grid, radius, step=1, cell=CELL, date="date", value="v") -> DataFrame:
    """(2r+1) x (2r+1) patch of values around each row, gaps filled by the centre value.

    step: distance in cell keys between neighbouring grid columns and rows, as
    (lat, lon) or one number.
    """
    s_lat, s_lon = step if isinstance(step, tuple) else (step, step)
    spots = rows.select(*cell, date).distinct()
    span = F.sequence(F.lit(-radius), F.lit(radius))
    need = spots.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(F.sequence(
        F.lit(-radius), F.lit(radius))))
    lat, lon = cell
    src = grid.select(F.col(lat).alias("_la"), F.col(lon).alias("_lo"), date, value)
    got = need.withColumns(
        {"_la": F.col(lat) + F.col("_i") * s_lat, "_lo": F.col(lon) + F.col("_j") * s_lon}
    ).join(src, ["_la", "_lo", date], "left")
    cells = got.groupBy(*cell, date).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_j", F.col(value).alias("x")))).alias("_p"),
        F.max(F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.col(value))).alias("_centre"),
    )
    side = 2 * radius + 1
    flat = F.transform("_p", lambda p: F.coalesce(p["x"], F.col("_centre")).cast("float"))
    patch = F.transform(
        F.sequence(F.lit(0), F.lit(side - 1)),
        lambda i: F.slice(flat, i * side + 1, F.lit(side)),
    )
    return rows.join(cells.select(*cell, date, patch.alias("patch")), [*cell, date], "left")


# --- climatology ----------------------------------------------------------------


def monthly_climatology(cube, cell=CELL, value="v") -> DataFrame:
    """mean, std, min, max and median per cell and calendar month over all years."""
    return cube.groupBy(*cell, F.month("date").alias("month")).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.median(value).alias("median"),
    )


def monthly_trends(cube, cell=CELL, value="v") -> DataFrame:
    """Slope per year of the monthly mean, max and median of each calendar month."""
    per_month = cube.groupBy(
        *cell, F.year("date").alias("year"), F.month("date").alias("month")
    ).agg(F.avg(value).alias("m"), F.max(value).alias("x"), F.median(value).alias("d"))
    when = F.col("year") + (F.col("month") - 1) / 12.0
    return per_month.groupBy(*cell, "month").agg(
        F.count(F.lit(1)).alias("years"),
        F.regr_slope("m", when).alias("mean_slope"),
        F.regr_slope("x", when).alias("max_slope"),
        F.regr_slope("d", when).alias("median_slope"),
    )


def month_lookup(rows, monthly, axis_lat, axis_lon, lat="latitude", lon="longitude",
                 date="date") -> DataFrame:
    """Monthly features at the nearest grid cell; axes = (start, step, size) in degrees."""
    from cindergrid.operators.spatial import nearest_index

    keyed = rows.withColumns(
        {
            "_i": nearest_index(lat, *axis_lat), "_j": nearest_index(lon, *axis_lon),
            "month": F.month(date),
        }
    )
    return keyed.join(monthly, ["_i", "_j", "month"], "left").drop("_i", "_j")
