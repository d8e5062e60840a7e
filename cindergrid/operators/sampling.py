"""Deterministic samples, splits and training weights.

Samples are ordered by the md5 of a seed and the row key, which gives the same
rows on every run and every cluster. A group is never sorted in one task: the
leading hash digits cut it into slices, slice counts say how many whole slices
are taken, and only inside a slice are rows numbered.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.labels import finite
from cindergrid.operators.draws import drawn, leading, numbers, with_number, with_place
from cindergrid.operators.ranking import exact_quantiles
from cindergrid.session import cut

DIGITS = 3


def hash_of(seed, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))


def hash_int(seed, *keys) -> Column:
    """Non-negative integer below 2**32 from the md5 of the keys."""
    return F.conv(F.substring(hash_of(seed, *keys), 1, 8), 16, 10).cast("long")


def _slices(df, group, order):
    keyed = df.withColumn("_slice", F.substring(order, 1, DIGITS))
    counts = keyed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_total": F.sum("_n").over(Window.partitionBy(*group)),
        }
    )
    return keyed, table


def numbered(df, group, order="_h", out="_rank") -> DataFrame:
    """1-based position of every row in hash order within its group, and the group size."""
    keyed, table = _slices(df, group, order)
    joined = keyed.join(table.drop("_n"), [*group, "_slice"])
    w = Window.partitionBy(*group, "_slice").orderBy(order)
    return joined.withColumn(out, F.col("_before") + F.row_number().over(w)).drop(
        "_slice", "_before"
    )


def take_by_hash(df, group, quota, order="_h", quotas=None) -> DataFrame:
    """Exactly `quota` rows of every group in hash order (all, if fewer).

    quota: column over _total (rows of the group) and any column of `quotas`, a
    table keyed by the group. Adds _rank, _total and _quota.
    """
    keyed, table = _slices(df, group, order)
    if quotas is not None:
        table = table.join(quotas, list(group)) if group else table
    table = table.withColumn("_quota", quota.cast("long")).filter("_before < _quota")
    joined = keyed.join(
        table.select(*group, "_slice", "_before", "_total", "_quota"), [*group, "_slice"]
    )
    w = Window.partitionBy(*group, "_slice").orderBy(order)
    return (
        joined.withColumn("_rank", F.col("_before") + F.row_number().over(w))
        .filter("_rank <= _quota")
        .drop("_slice", "_before")
    )


# --- negatives ------------------------------------------------------------------

# Strata in drawing order and their default weights.
STRATA = {
    "near_fire_hard": 0.25,
    "large_city_hard": 0.10,
    "same_season": 0.20,
    "same_ecoregion": 0.20,
    "same_burnable_landcover": 0.20,
    "random_background": 0.05,
}
ROUNDS = 12  # of draws of points
CELL_DAY = ("country", "lat_key", "lon_key", "date")
LISTED = 64  # cell-days to list, at most, for each negative wanted
LOOKED_UP = 50_000_000  # draws near events that are looked up without a try of a few rounds


def free_cell_days(cells, start, end, blocked=None) -> DataFrame:
    """Every cell-day of the period outside `blocked`."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.sequence(F.trunc(first, "month"), last, F.expr("interval 1 month"))
    # months are spread before their days are listed
    spread = cells.select("country", "lat_key", "lon_key").distinct().withColumn("_month", F.explode(months))
    spread = spread.repartition("country", "lat_key", "lon_key", "_month")
    days = F.sequence(F.greatest(F.col("_month"), first), F.least(F.last_day("_month"), last))
    listed = spread.select("country", "lat_key", "lon_key", F.explode(days).alias("date"))
    return listed if blocked is None else listed.join(blocked.select(*CELL_DAY), list(CELL_DAY), "left_anti")


def _period(start, end) -> int:
    return (date.fromisoformat(str(end)) - date.fromisoformat(str(start))).days + 1


def _on_cells(rows, table) -> DataFrame:
    """Rows with the columns of a table of cells; a country may be null."""
    own = table.withColumnsRenamed({"country": "_country", "lat_key": "_lat", "lon_key": "_lon"})
    same = F.col("country").eqNullSafe(F.col("_country")) & (F.col("lat_key") == F.col("_lat")) & (F.col("lon_key") == F.col("_lon"))
    return rows.join(own, same).drop("_country", "_lat", "_lon")


def near_event_candidates(
    positives, cells, start, end, low=0, high=4, min_cells=2, max_cells=5, day_window=7, seed=42
) -> DataFrame:
    """Cell-days in the ring around each positive, drawn in rounds `low` .. `high`-1, with distance and day gap.

    In each round every positive draws one of its ring offsets and day shifts, none of them
    twice; draws that leave the cells or the period are dropped.
    """
    ring = _ring(min_cells, max_cells)
    shifts = 2 * day_window + 1
    d = positives.select(*CELL_DAY).distinct().withColumn("_k", hash_int(f"{seed}:near", *CELL_DAY))
    d = d.withColumn("_round", F.explode(F.sequence(F.lit(low), F.lit(min(high, len(ring) * shifts) - 1))))
    d = with_place(d, "_round", F.lit(len(ring) * shifts), "_k")
    pick = (F.floor(F.col("_v") / shifts) + 1).cast("int")
    da = F.element_at(F.array(*[F.lit(a) for a, _ in ring]), pick)
    db = F.element_at(F.array(*[F.lit(b) for _, b in ring]), pick)
    dd = (F.pmod("_v", F.lit(shifts)) - day_window).cast("int")
    moved = d.select(
        "country", (F.col("lat_key") + da).alias("lat_key"), (F.col("lon_key") + db).alias("lon_key"),
        F.date_add("date", dd).alias("date"), "_round",
        F.greatest(F.abs(da), F.abs(db)).cast("double").alias("distance"), F.abs(dd).cast("double").alias("gap_days"),
    ).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    inside = moved.join(
        cells.select("country", "lat_key", "lon_key").distinct(), ["country", "lat_key", "lon_key"], "left_semi"
    )
    best = inside.groupBy(*CELL_DAY).agg(F.min(F.struct("_round", "distance", "gap_days")).alias("_b"))
    return best.select(*CELL_DAY, "_b.*", hash_of(f"{seed}:near", *CELL_DAY).alias("_h"))


def near_event_rounds(positives, free, min_cells=2, max_cells=5, day_window=7, seed=42) -> DataFrame:
    """What `near_event_candidates` draws of the cell-days `free` in all its rounds, looked up from these."""
    ring = _ring(min_cells, max_cells)
    shifts = 2 * day_window + 1
    span = lambda days: F.floor(days / shifts)
    d = positives.select(*CELL_DAY).distinct().withColumn("_k", hash_int(f"{seed}:near", *CELL_DAY))
    d = d.select("country", F.col("lat_key").alias("_a"), F.col("lon_key").alias("_b"), F.unix_date("date").alias("_at"), "_k")
    d = d.withColumn("_span", span(F.col("_at")))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ring])
    # pairs of cells first: most offsets may lead to no cell
    pairs = d.select("country", "_a", "_b").distinct().select("*", F.posexplode(offsets).alias("_j", "_o"))
    pairs = pairs.select("*", (F.col("_a") + F.col("_o.a")).alias("lat_key"), (F.col("_b") + F.col("_o.b")).alias("lon_key"))
    pairs = cut(pairs.join(free.select("country", "lat_key", "lon_key").distinct(), ["country", "lat_key", "lon_key"], "left_semi"))
    seen = free.select(*CELL_DAY, F.unix_date("date").alias("_day")).join(pairs, ["country", "lat_key", "lon_key"])
    seen = seen.withColumn("_span", F.explode(F.sequence(span(F.col("_day") - day_window), span(F.col("_day") + day_window))))
    gap = F.col("_day") - F.col("_at")
    both = seen.join(d, ["country", "_a", "_b", "_span"]).filter(F.abs(gap) <= day_window)
    both = both.select(
        *CELL_DAY, "_k", (F.col("_j") * shifts + gap + day_window).alias("_v"),
        F.greatest(F.abs("_o.a"), F.abs("_o.b")).alias("_far"), F.abs(gap).alias("_gap"),
    )
    both = with_number(both, "_v", F.lit(len(ring) * shifts), "_k", "_round")
    # one number orders by round, distance and gap; structs would be sorted instead of hashed
    far, late = max_cells + 1, day_window + 1
    best = both.groupBy(*CELL_DAY).agg(F.min((F.col("_round") * far + F.col("_far")) * late + F.col("_gap")).alias("_b"))
    return best.select(
        *CELL_DAY, F.floor(F.col("_b") / (far * late)).cast("int").alias("_round"),
        F.pmod(F.floor(F.col("_b") / late), F.lit(far)).cast("double").alias("distance"),
        F.pmod("_b", F.lit(late)).cast("double").alias("gap_days"), hash_of(f"{seed}:near", *CELL_DAY).alias("_h"),
    )


def near_undrawn(positives, cells, start, end, found, blocked=None, max_cells=5, day_window=7) -> DataFrame:
    """Positives whose box of cells and days holds a free cell-day that is not in `found`."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    left = cells.select("country", "lat_key", "lon_key").distinct().withColumn("date", F.explode(F.sequence(first, last)))
    for gone in (blocked, found):
        if gone is not None:
            left = left.join(gone.select(*CELL_DAY), list(CELL_DAY), "left_anti")
    # places of positives that see a cell are few; days are looked up in order, none is listed
    side = F.explode(F.sequence(F.lit(-max_cells), F.lit(max_cells)))
    seen = positives.select("country", "lat_key", "lon_key").distinct().withColumn("_a", side).withColumn("_b", side)
    seen = seen.withColumns({"_a": F.col("lat_key") + F.col("_a"), "_b": F.col("lon_key") + F.col("_b")})
    left = left.withColumnsRenamed({"lat_key": "_a", "lon_key": "_b"}).join(seen, ["country", "_a", "_b"]).select(*CELL_DAY).distinct()
    both = left.withColumn("_open", F.lit(1)).unionByName(positives.select(*CELL_DAY, F.lit(None).cast("int").alias("_open")))
    around = Window.partitionBy("country", "lat_key", "lon_key").orderBy(F.unix_date("date")).rangeBetween(-day_window, day_window)
    return both.withColumn("_near", F.count("_open").over(around)).filter("_open is null and _near > 0").select(*CELL_DAY)


def _ring(min_cells, max_cells) -> list[tuple[int, int]]:
    span = range(-max_cells, max_cells + 1)
    return [(a, b) for a in span for b in span if min_cells <= max(abs(a), abs(b)) <= max_cells]


def city_candidates(cells, start, end, low=0, high=1, seed=42) -> DataFrame:
    """City cell-days of rounds `low` .. `high`-1: in each round every city cell draws a day it has not had."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    size = (F.datediff(last, first) + 1).cast("bigint")
    city = cells.filter("large_city_hard").select("country", "lat_key", "lon_key").distinct()
    d = city.withColumn("_round", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), size) - 1)))
    d = with_place(d, "_round", size, hash_int(f"{seed}:city", "country", "lat_key", "lon_key"))
    d = d.withColumn("date", F.date_add(first, F.col("_v").cast("int")))
    return d.select(*CELL_DAY, "_round", hash_of(f"{seed}:city", *CELL_DAY).alias("_h"))


def city_rounds(cells, free, start, end, seed=42) -> DataFrame:
    """What `city_candidates` draws of the cell-days `free` in all its rounds."""
    city = cells.filter("large_city_hard").select("country", "lat_key", "lon_key").distinct()
    d = _on_cells(free.select(*CELL_DAY), city)
    key = hash_int(f"{seed}:city", "country", "lat_key", "lon_key")
    d = with_number(d, F.datediff("date", F.lit(start).cast("date")), F.lit(_period(start, end)), key, "_round")
    return d.select(*CELL_DAY, "_round", hash_of(f"{seed}:city", *CELL_DAY).alias("_h"))


#: What the cells of a stratum's pool have in common with the positive.
POOLS = {
    "same_season": ["country"],
    "same_ecoregion": ["country", "ecoregion_name"],
    "same_burnable_landcover": ["country", "burnable", "landcover_key"],
    "random_background": [],
}


def matched_groups(positives, cells, start, end, stratum, match_month=True, seed=42) -> tuple[DataFrame, DataFrame]:
    """Groups of positives that draw from the same cell-days, and the numbered cells of all pools.

    A group has its pool, month (0 for any day), the number of its positives, of its days and
    of its cell-days, and a key. A positive whose pool has no cells draws from its country's,
    or else from all cells.
    """
    name = f"{seed}:{stratum}"
    levels = [POOLS[stratum]] + [keys for keys in (["country"], []) if len(keys) < len(POOLS[stratum])]
    word = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("\u0000"))
    tag = lambda keys: F.concat_ws("|", F.lit(str(len(keys))), *[word(k) for k in keys])
    known = cells.select(*dict.fromkeys(["country", "lat_key", "lon_key", *POOLS[stratum]])).distinct()
    pools = None
    for keys in levels:
        one = known.select("country", "lat_key", "lon_key", tag(keys).alias("_pool"))
        pools = one if pools is None else pools.unionByName(one)
    pools = cut(numbered(pools.withColumn("_h", hash_of(f"{name}:pool", "country", "lat_key", "lon_key")), ["_pool"]).select(
        "_pool", (F.col("_rank") - 1).alias("_cell"), F.col("_total").alias("_cells"), "country", "lat_key", "lon_key"
    ))
    sizes = pools.filter("_cell = 0").select("_pool", "_cells")
    by_month = stratum == "same_season" or (match_month and stratum in ("same_ecoregion", "same_burnable_landcover"))
    lengths = F.transform(_days_by_month(start, end), lambda d: F.size(d))
    month = F.when(F.element_at(lengths, F.month("date")) > 0, F.month("date")).otherwise(0) if by_month else F.lit(0)
    pos = positives.select(*dict.fromkeys([*CELL_DAY, *POOLS[stratum]])).distinct()
    pos = pos.groupBy(month.alias("_month"), *[tag(keys).alias(f"_p{i}") for i, keys in enumerate(levels)]).agg(F.count(F.lit(1)).alias("_n"))
    for i in range(len(levels)):
        pos = pos.join(sizes.select(F.col("_pool").alias(f"_p{i}"), F.col("_cells").alias(f"_c{i}")), f"_p{i}", "left")
    held = [F.when(F.col(f"_c{i}").isNotNull(), F.col(f"_p{i}")) for i in range(len(levels))]
    days = F.when(F.col("_month") > 0, F.element_at(lengths, F.greatest("_month", F.lit(1)))).otherwise(
        F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    )
    groups = pos.groupBy(F.coalesce(*held).alias("_pool"), "_month").agg(F.sum("_n").alias("_n")).filter("_pool is not null")
    groups = groups.join(sizes, "_pool").withColumn("_days", days.cast("bigint")).filter("_days > 0")
    return cut(groups.select(
        "_pool", "_month", "_n", "_days", (F.col("_days") * F.col("_cells")).alias("_size"), hash_int(f"{name}:perm", "_pool", "_month").alias("_k")
    )), pools


def matched_candidates(groups, pools, start, end, stratum, low=0, high=4, seed=42) -> DataFrame:
    """Cell-days of rounds `low` .. `high`-1: in each round a group draws as many as it has positives, none twice."""
    d = numbers(groups, F.least(F.col("_n") * low, F.col("_size")), F.least(F.col("_n") * high, F.col("_size")))
    d = with_place(d, "_i", "_size", "_k").select(
        "_pool", F.floor(F.col("_v") / F.col("_days")).alias("_cell"), F.pmod("_v", "_days").cast("int").alias("_day"),
        "_month", F.floor(F.col("_i") / F.col("_n")).cast("int").alias("_round"),
    )
    spot = d.join(pools.drop("_cells"), ["_pool", "_cell"])
    listed = F.element_at(F.element_at(_days_by_month(start, end), F.greatest("_month", F.lit(1))), F.col("_day") + 1)
    day = F.when(F.col("_month") > 0, listed).otherwise(F.date_add(F.lit(start).cast("date"), F.col("_day")))
    out = spot.select("country", "lat_key", "lon_key", day.alias("date"), "_round")
    first = out.groupBy(*CELL_DAY).agg(F.min("_round").alias("_round"))
    return first.withColumn("_h", hash_of(f"{seed}:{stratum}:order", *CELL_DAY))


def matched_rounds(groups, pools, free, start, end, stratum, seed=42) -> DataFrame:
    """What `matched_candidates` draws of the cell-days `free` in all its rounds."""
    d = _on_cells(free.select(*CELL_DAY), pools.drop("_cells"))
    d = d.withColumn("_month", F.explode(F.array(F.lit(0), F.month("date")))).join(groups, ["_pool", "_month"])
    listed = F.element_at(_days_by_month(start, end), F.greatest("_month", F.lit(1)))
    day = F.when(F.col("_month") > 0, F.array_position(listed, F.col("date")) - 1).otherwise(F.datediff("date", F.lit(start).cast("date")))
    d = with_number(d.withColumn("_v", F.col("_cell") * F.col("_days") + day), "_v", "_size", "_k")
    first = d.groupBy(*CELL_DAY).agg(F.min(F.floor(F.col("_i") / F.col("_n"))).cast("int").alias("_round"))
    return first.withColumn("_h", hash_of(f"{seed}:{stratum}:order", *CELL_DAY))


def stratum_negatives(
    stratum, want, positives, cells, start, end, blocked=None, near=(2, 5, 7), match_month=True, seed=42, free=None
) -> DataFrame:
    """The first `want` free cell-days of one stratum, or all there are: CELL_DAY, distance, gap_days, _round, _h.

    `free` are all cell-days that are not blocked, if they are known. If they are not, they
    are listed where there are at most LISTED cell-days for each one wanted. Each listed
    cell-day is looked up once, so a stratum that runs short opens no round after round.
    """
    none = F.lit(None).cast("double")
    if free is None:
        cells = cut(cells)  # every pass reads them
        every = cells.select("country", "lat_key", "lon_key").distinct().count() * _period(start, end)
        if every <= LISTED * want:
            free = cut(free_cell_days(cells, start, end, blocked))
    if free is not None:
        found = _from_listed(stratum, want, positives, cells, start, end, free, near, match_month, seed)
        found = leading(found, want).filter("_leads").drop("_leads")
        if "distance" not in found.columns:
            found = found.withColumns({"distance": none, "gap_days": none})
        return found.select(*CELL_DAY, "_round", "_h", "distance", "gap_days")
    n = positives.count()
    guess = lambda templates: -(-4 * want // (3 * max(1, templates))) + 1
    if stratum == "near_fire_hard":
        rounds = len(_ring(*near[:2])) * (2 * near[2] + 1)
        drawing = {"positives": positives, "n": n}
        blocked = None if blocked is None else cut(blocked.select(*CELL_DAY))  # every pass reads it

        def narrow(found, left):
            """Only positives near a free cell-day that none has drawn go on; looked up where that is less than their draws."""
            if drawing["n"] * left > cells.count() * _period(start, end):
                drawing["positives"] = cut(near_undrawn(drawing["positives"], cells, start, end, found, blocked, *near[1:]))
                drawing["n"] = drawing["positives"].count()
            return drawing["n"] > 0

        draw = lambda a, b: near_event_candidates(drawing["positives"], cells, start, end, a, b, *near, seed)
        return drawn(draw, want, rounds, guess(n), CELL_DAY, blocked, narrow)
    if stratum == "large_city_hard":
        days = _period(start, end)
        n = cells.filter("large_city_hard").select("country", "lat_key", "lon_key").distinct().count()
        draw = lambda a, b: city_candidates(cells, start, end, a, b, seed)
        found = drawn(draw, want, days, guess(n), CELL_DAY, blocked)
    else:
        groups, pools = matched_groups(positives, cells, start, end, stratum, match_month, seed)
        rounds = groups.agg(F.max(F.ceil(F.col("_size") / F.col("_n")))).first()[0] or 1
        draw = lambda a, b: matched_candidates(groups, pools, start, end, stratum, a, b, seed)
        found = drawn(draw, want, int(rounds), guess(n), CELL_DAY, blocked)
    return found.withColumns({"distance": none, "gap_days": none}).select(*CELL_DAY, "_round", "_h", "distance", "gap_days")


def _from_listed(stratum, want, positives, cells, start, end, free, near, match_month, seed) -> DataFrame:
    """Free cell-days of a stratum with their rounds: all of them, or at least `want` of the first rounds."""
    if stratum == "near_fire_hard":
        n, left = positives.count(), free.count()
        every = cells.select("country", "lat_key", "lon_key").distinct().count() * _period(start, end)
        rounds = len(_ring(*near[:2])) * (2 * near[2] + 1)
        if 2 * want <= left and n * rounds * left > LOOKED_UP * every:
            first = min(rounds, -(-4 * want * every // (3 * n * left)) + 1)
            found = near_event_candidates(positives, cells, start, end, 0, first, *near, seed)
            found = cut(found.join(free, list(CELL_DAY), "left_semi"))
            if found.count() >= want:
                return found
        return cut(near_event_rounds(positives, free, *near, seed))
    if stratum == "large_city_hard":
        return cut(city_rounds(cells, free, start, end, seed))
    groups, pools = matched_groups(positives, cells, start, end, stratum, match_month, seed)
    return cut(matched_rounds(groups, pools, free, start, end, stratum, seed))


def _days_by_month(start, end) -> Column:
    """The period's days per calendar month: twelve constant arrays."""
    a, b = (date.fromisoformat(str(x)) for x in (start, end))
    days = [a + timedelta(days=i) for i in range((b - a).days + 1)]
    months = []
    for m in range(1, 13):
        # one text literal per month stays small in the plan
        text = ",".join(d.isoformat() for d in days if d.month == m)
        whole = F.split(F.lit(text), ",").cast("array<date>")
        months.append(whole if text else F.array().cast("array<date>"))
    return F.array(*months)


def stratum_quotas(positives, positive_fraction=0.10, weights=None) -> DataFrame:
    """Whole-number quota of every stratum; remainders go by fraction, then weight."""
    chosen = {k: max(0.0, float((weights or STRATA).get(k, 0.0))) for k in STRATA}
    if sum(chosen.values()) <= 0:
        chosen = dict(STRATA)
    total_w = sum(chosen.values())
    odds = (1.0 - positive_fraction) / positive_fraction
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("stratum"), F.lit(i).alias("priority"),
                         F.lit(w / total_w).alias("weight"))
                for i, (k, w) in enumerate(chosen.items())
            ]
        )
    )
    # guard against 90.00000000000001 becoming 91
    need = F.ceil(F.round(F.count(F.lit(1)) * odds, 9)).alias("target")
    base = positives.agg(need).select("target", rows.alias("s")).select("target", "s.*")
    raw = F.col("target") * F.col("weight")
    base = base.withColumns({"_floor": F.floor(raw), "_frac": F.round(raw - F.floor(raw), 9)})
    left = F.col("target") - F.sum("_floor").over(Window.partitionBy("target"))
    rank = F.row_number().over(
        Window.partitionBy("target").orderBy(F.col("_frac").desc(), F.col("weight").desc(), "priority")
    )
    return base.withColumn(
        "quota", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")
    ).drop("_floor", "_frac")


def stratified_negatives(
    positives, cells, start, end, positive_fraction=0.10, weights=None, buffer_cells=1,
    buffer_days=1, near=(2, 5, 7), match_month=True, seed=42,
) -> DataFrame:
    """Matched negatives, stratum after stratum: a cell-day belongs to the first that takes it.

    Every stratum holds its quota or, if they are fewer, all its free cell-days: those that
    are neither in the positive buffer nor taken before. What the others are short of
    is added to the background's quota. Draws are written to the checkpoint folder.
    """
    from cindergrid.operators.grids import blocked_keys

    positives, cells = cut(positives), cut(cells)
    quotas = {r["stratum"]: r["quota"] for r in stratum_quotas(positives, positive_fraction, weights).collect()}
    target = sum(quotas.values())
    known = cells.select("country", "lat_key", "lon_key").distinct()
    blocked = blocked_keys(positives, buffer_cells, buffer_days, cells=known).select(*CELL_DAY)
    n = cells.agg(F.count(F.lit(1)).alias("all"), F.count_if("large_city_hard").alias("city")).first()
    days = _period(start, end)
    free, left = None, None
    if known.count() * days <= LISTED * target:
        free = cut(free_cell_days(known, start, end, blocked))
        left = free.count()
    else:
        blocked = cut(blocked)
    held, taken = 0, None
    for stratum in STRATA:
        quota = quotas.get(stratum, 0)
        back = stratum == "random_background"
        want = target - held if back else quota
        if want <= 0 or left == held:
            continue
        closed, open_ = blocked, free
        if taken is not None and free is None:
            closed = blocked.unionByName(taken.select(*CELL_DAY))
        elif taken is not None:
            gone = taken.select(*[F.col(c).alias(f"_{c}") for c in CELL_DAY])
            open_ = free.join(gone, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL_DAY], "left_anti")
        found = stratum_negatives(stratum, want, positives, cells, start, end, closed, near, match_month, seed, open_)
        universe = max(1, (n["city"] if stratum == "large_city_hard" else n["all"]) * days)
        chance = F.lit(min(1.0, quota / universe))
        if back and want > quota:
            # rows beyond the quota stand for what the other strata are short of
            found = leading(cut(found), quota)
            chance = F.when(~F.col("_leads"), min(1.0, (want - quota) / universe)).otherwise(chance)
        part = cut(found.select(*CELL_DAY, F.lit(stratum).alias("stratum"), "distance", "gap_days", chance.alias("sampling_probability")))
        held += part.count()
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        none = F.lit(None).cast("double")
        taken = positives.filter("false").select(
            *CELL_DAY, F.lit("").alias("stratum"), none.alias("distance"), none.alias("gap_days"), none.alias("sampling_probability")
        )
    return taken.select(
        *CELL_DAY, "stratum", F.lit(0).alias("count"),
        F.col("distance").alias("nearest_positive_distance_cells"),
        F.col("gap_days").alias("nearest_positive_delta_days"),
        "sampling_probability", (1.0 / F.col("sampling_probability")).alias("sample_weight"),
    )


def area_negatives(
    polygons, positives, rate_per_kha_year, start, end, buffer_cells=1, buffer_days=1,
    resolution=0.1, seed=42, name="n_name",
) -> DataFrame:
    """Uniform negatives in proportion to polygon area and time, outside the buffer.

    A country without a free cell-day (by its cells' centres) gets no row. For the others
    the share of their box that lies inside and the share of their cell-days that is free
    are known, so the first draws nearly always fill the quota; what is missing is drawn
    in further rounds, ROUNDS at most. Draws are generated in chunks spread over the
    cluster, so the largest country does not become one long task; polygons may have holes,
    parts and lie across 180 degrees. Free draws are written to the checkpoint folder.
    """
    from cindergrid.functions.cells import cell_key
    from cindergrid.operators.grids import blocked_keys, candidate_cells, drop_buffered
    from cindergrid.operators.polygons import area_kha, located, polygon_index

    index = polygon_index(polygons, [name])
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    years = span / 365.25
    closed = cut(blocked_keys(positives, buffer_cells, buffer_days).filter(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ))
    cells = candidate_cells(polygons, None, resolution, name)
    blocked = closed.join(cells, ["country", "lat_key", "lon_key"], "left_semi").groupBy("country").agg(F.count(F.lit(1)).alias("_shut"))
    sizes = cells.groupBy("country").agg((F.count(F.lit(1)) * span).alias("_every"))
    shares = sizes.join(blocked, "country", "left").select(
        "country", (1.0 - F.coalesce("_shut", F.lit(0)) / F.col("_every")).alias("_open")
    )
    around = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    boxes = area_kha(polygons, [name]).select(
        F.col(name).alias("country"), "x0", "x1", "y0", "y1", F.round(F.col("kha") * rate_per_kha_year * years).cast("long").alias("want"),
        (F.col("square_degrees") / around).alias("_inside"),
    ).filter("want > 0").join(shares, "country", "left").fillna(1.0, ["_open"]).filter("_open > 0")
    want = boxes.groupBy("country").agg(F.sum("want").alias("_all"))
    # a point is kept with chance inside x open, so about so many draws fill the quota
    boxes = boxes.join(want, "country").withColumn("_id", F.xxhash64("country", "x0", "x1", "y0", "y1"))
    needed = lambda short: F.ceil(1.2 * short / F.greatest(F.col("_inside") * F.col("_open"), F.lit(1e-9)) + 20).cast("long")
    asked = cut(boxes.withColumns({"_from": F.lit(0).cast("long"), "_n": needed(F.col("want"))}))

    def points(asked):
        """Points number _from to _from + _n - 1 of each polygon's box that are inside and free."""
        pts = numbers(asked.select("country", "_id", "x0", "x1", "y0", "y1", "_from", "_n"), F.col("_from"), F.col("_from") + F.col("_n"))
        unit = lambda tag: hash_int(f"{seed}:{tag}", "country", "_id", "_i") / float(2**32)
        east = F.col("x0") + (F.col("x1") - F.col("x0")) * unit("x")
        pts = pts.select(
            "country", "_id", "_i", F.when(east.between(-180.0, 180.0), east).otherwise(F.pmod(east + 180.0, F.lit(360.0)) - 180.0).alias("longitude"),
            (F.col("y0") + (F.col("y1") - F.col("y0")) * unit("y")).alias("latitude"),
            F.date_add(F.lit(start).cast("date"), F.pmod(hash_int(f"{seed}:d", "country", "_id", "_i"), span).cast("int")).alias("date"),
        )
        held = located(pts, index, "longitude", "latitude").filter(F.col(name) == F.col("country")).drop("_pid", name).distinct()
        inside = held.withColumns(
            {
                "lat_key": cell_key("latitude", resolution), "lon_key": cell_key("longitude", resolution),
                "_h": hash_of(seed, "country", "_id", "_i"),
            }
        )
        return cut(drop_buffered(inside, positives, buffer_cells, buffer_days))

    free = None
    for _ in range(ROUNDS):
        more = points(asked)
        free = more if free is None else free.unionByName(more)
        known = asked.join(free.groupBy("country").agg(F.count(F.lit(1)).alias("_got")), "country", "left").fillna(0, ["_got"])
        short = known.filter("_got < _all")
        asked = cut(short.withColumns({
            "_from": F.col("_from") + F.col("_n"), "_n": needed(F.col("_all") - F.col("_got")),
        }).select(*asked.columns))
        if asked.isEmpty():
            break
    return take_by_hash(free, ["country"], F.col("_all"), quotas=want).select(
        *CELL_DAY, "longitude", "latitude", F.lit(0).alias("count")
    )


# --- deployment samples ---------------------------------------------------------


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def weighted_sample(grid, fraction, group, key, label="is_fire", keep_positives=True, seed=42):
    """Weighted sample of a labelled grid: weights add up to the whole universe.

    With keep_positives every positive stays with weight 1 and a fraction of the
    negatives stands for all of them; otherwise a fraction of all rows.
    """
    g = list(group)
    hashed = grid.withColumn("_h", hash_of(seed, *key))
    pool = hashed.filter(F.col(label) == 0) if keep_positives else hashed
    n = F.greatest(half_even(F.col("_total") * F.lit(float(fraction))), F.lit(1))
    kept = take_by_hash(pool, g, n)
    kept = kept.withColumn(
        "eval_weight", F.col("_total") / F.least(F.col("_quota"), F.col("_total"))
    ).drop("_rank", "_total", "_quota", "_h")
    if not keep_positives:
        return kept
    positives = hashed.filter(F.col(label) > 0).withColumn("eval_weight", F.lit(1.0)).drop("_h")
    return kept.unionByName(positives.select(*kept.columns))


def lazy_sample(cells, labels, start, end, fraction, seed=42) -> DataFrame:
    """Weighted negatives of cells x days without building the cross product.

    For every cell only the days whose hash falls under a share are produced, and
    the exact number is then taken per country and month. The share exceeds what is
    wanted by eight standard deviations and 40 rows, so a small country's month is
    produced whole and a large one is never short.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    pos = labels.select(*CELL_DAY).distinct().join(
        cells.select("country", "lat_key", "lon_key"), ["country", "lat_key", "lon_key"], "left_semi"
    ).filter(F.col("date").between(first, last))
    months = F.transform(
        F.sequence(F.trunc(first, "month"), last, F.expr("interval 1 month")), lambda m: m
    )
    n_cells = cells.groupBy("country").agg(F.count(F.lit(1)).alias("_c"))
    n_pos = pos.groupBy("country", F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("_pos")
    )
    size = n_cells.withColumn("month", F.explode(months)).join(
        n_pos, ["country", "month"], "left"
    ).withColumn(
        "_days",
        F.datediff(F.least(F.last_day("month"), last), F.greatest(F.col("month"), first)) + 1,
    ).withColumn("_neg", F.col("_c") * F.col("_days") - F.coalesce("_pos", F.lit(0)))
    want = F.greatest(half_even(F.col("_neg") * F.lit(float(fraction))), F.lit(1))
    share = (want + 8 * F.sqrt(want) + 40) / F.greatest(F.col("_neg"), F.lit(1))
    # one small map of months for each country
    limits = size.groupBy("country").agg(
        F.map_from_entries(F.collect_list(F.struct("month", (share * 2.0**32).alias("limit")))).alias("_limits")
    )
    days = F.filter(
        F.sequence(first, last),
        lambda d: F.conv(
            F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("country"), F.col("lat_key"),
                                          F.col("lon_key"), d)), 1, 8), 16, 10
        ).cast("long") < F.element_at("_limits", F.trunc(d, "month")),
    )
    drawn = cells.join(limits, "country").select("country", "lat_key", "lon_key", F.explode(days).alias("date"))
    negatives = drawn.join(pos, list(CELL_DAY), "left_anti").withColumns(
        {"month": F.trunc("date", "month"), "_h": hash_of(seed, *CELL_DAY)}
    )
    kept = take_by_hash(
        negatives, ["country", "month"], F.col("_want"),
        quotas=size.select("country", "month", "_neg", want.alias("_want")),
    ).join(size.select("country", "month", "_neg"), ["country", "month"])
    rows = kept.select(
        *CELL_DAY, F.lit(0).alias("is_fire"),
        (F.col("_neg") / F.least("_quota", "_total")).alias("eval_weight"),
    )
    return rows.unionByName(
        pos.select(*CELL_DAY, F.lit(1).alias("is_fire"), F.lit(1.0).alias("eval_weight"))
    )


def sample_days(rows, days_per_month, weight="eval_weight", date="date") -> DataFrame:
    """Evenly spaced days of every month; weights scaled by days / sampled days."""
    days = rows.select(date).distinct().withColumn("_m", F.trunc(date, "month"))
    w = Window.partitionBy("_m")
    days = days.withColumns(
        {"_i": F.row_number().over(w.orderBy(date)) - 1, "_d": F.count(F.lit(1)).over(w)}
    )
    k = days_per_month
    if k == 1:
        slots = F.array(F.lit(0).cast("long"))
    else:
        slots = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda j: F.rint(j * (F.col("_d") - 1) / (k - 1)).cast("long"),
        )
    kept = days.filter((F.col("_d") <= k) | F.array_contains(slots, F.col("_i").cast("long")))
    kept = kept.withColumn("_f", F.col("_d") / F.count(F.lit(1)).over(w)).select(date, "_f")
    return rows.join(kept, date).withColumn(
        weight, F.coalesce(F.col(weight), F.lit(1.0)) * F.col("_f")
    ).drop("_f")


# --- splits ---------------------------------------------------------------------


def split_by_dates(df, validation_start, test_start, date="date") -> DataFrame:
    d = F.col(date)
    return df.withColumn(
        "split",
        F.when(d >= F.lit(test_start).cast("date"), "test")
        .when(d >= F.lit(validation_start).cast("date"), "validation").otherwise("train"),
    )


def split_by_years(df, ranges, date="date") -> DataFrame:
    """ranges: split -> (first year, last year); other rows get NULL."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(list(ranges.items())):
        out = F.when(F.year(date).between(a, b), name).otherwise(out)
    return df.withColumn("split", out)


def split_by_fraction(df, test_size, validation_size, key, date="date") -> DataFrame:
    """Last rows in (date, key hash) order to test, the ones before to validation."""
    hashed = df.withColumn("_h", hash_of(0, key))
    per_day = hashed.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    # one row per calendar day: a small table, whatever the number of rows
    days = per_day.select(
        date, (F.sum("_n").over(Window.orderBy(date)) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    ranked = numbered(hashed, [date]).join(days, date)
    pos = F.col("_start") + F.col("_rank")
    n_test = F.ceil(F.col("_all") * test_size)
    n_val = F.ceil((F.col("_all") - n_test) * validation_size)
    return ranked.withColumn(
        "split",
        F.when(pos > F.col("_all") - n_test, "test")
        .when(pos > F.col("_all") - n_test - n_val, "validation").otherwise("train"),
    ).drop("_h", "_rank", "_total", "_start", "_all")


SPLIT_CODES = {"train": 0, "validation": 1, "test": 2}


def split_code(split="split") -> Column:
    pairs = [F.lit(x) for kv in SPLIT_CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(split)).cast("byte")


# --- row samples ----------------------------------------------------------------


def stratified_rows(df, max_rows, key, label="is_fire", seed=42) -> DataFrame:
    """At most max_rows rows with class shares kept (largest remainders first)."""
    hashed = df.withColumn("_h", hash_of(seed, key))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    # one row per class
    everyone = Window.partitionBy()
    raw = F.col("_c") * F.least(F.lit(1.0), F.lit(float(max_rows)) / F.sum("_c").over(everyone))
    q = sizes.withColumn("_raw", F.round(raw, 9)).withColumn("_fl", F.floor("_raw"))
    total = F.least(F.lit(max_rows), F.sum("_c").over(everyone))
    left = total - F.sum("_fl").over(everyone)
    rank = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy((F.col("_raw") - F.col("_fl")).desc(), label)
    )
    q = q.withColumn("_q", F.col("_fl") + F.when(rank <= left, 1).otherwise(0))
    return take_by_hash(hashed, [label], F.col("_q"), quotas=q.select(label, "_q")).drop(
        "_h", "_rank", "_total", "_quota"
    )


def negative_ratio_rows(df, ratio, key, label="is_fire", seed=42) -> DataFrame:
    """All positives and ratio times as many negatives."""
    hashed = df.filter(F.col(label) == 0).withColumns(
        {"_h": hash_of(seed, key), "_g": F.lit(0)}
    )
    want = df.agg(F.floor(F.sum(F.col(label)) * F.lit(float(ratio))).alias("_q")).withColumn(
        "_g", F.lit(0)
    )
    kept = take_by_hash(hashed, ["_g"], F.col("_q"), quotas=want)
    return df.filter(F.col(label) == 1).unionByName(kept.select(*df.columns))


def fraction_rows(df, fraction, key, seed=42) -> DataFrame:
    hashed = df.withColumns({"_h": hash_of(seed, key), "_g": F.lit(0)})
    kept = take_by_hash(hashed, ["_g"], half_even(F.col("_total") * F.lit(float(fraction))))
    return kept.select(*df.columns)


def exclude_years(df, years, date="date") -> DataFrame:
    """Rows outside the listed years; all rows if nothing would be left."""
    outside = ~F.year(date).isin(list(years))
    some = df.agg(F.coalesce(F.bool_or(outside), F.lit(False))).scalar()
    return df.withColumn("_some", some).filter(outside | ~F.col("_some")).drop("_some")


# --- bootstrap ------------------------------------------------------------------


def bootstrap_weights(df, key, trials, label="is_fire", sample_size=None, seed=42, group=()):
    """One row per (trial, drawn row) with its draw count.

    Draw counts are Poisson by a hash of trial and row, so no index is shared or
    collected; bootstrap_error rescales them per trial to the class sizes. Without a
    sample size the rate is 1 and rows need no table of sizes.
    """
    rows, rate = df, F.lit(1.0)
    if sample_size:
        # one row per group and class: joined by sorting, a class would lie in one task
        size = _class_sizes(df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n")), group, sample_size)
        rows, rate = df.join(F.broadcast(size.drop("_want")), [*group, label]), F.col("_rate")
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    u = F.pmod(F.xxhash64(F.lit(seed), "trial", key), F.lit(2**53)) / float(2**53)
    # the filter reads the hash once; on draws it would repeat it for every comparison
    rows = rows.withColumn("_u", u).filter(F.col("_u") > F.exp(-rate))
    k, p, c = F.lit(1), F.exp(-rate) * rate, F.exp(-rate) + F.exp(-rate) * rate
    # rates are at most 1, so the chance of more than 18 draws is below the hash's resolution
    for j in range(2, 19):
        k = k + (F.col("_u") > c).cast("int")
        p = p * rate / j
        c = c + p
    return rows.withColumn("draws", k).drop("_u")


def _class_sizes(counts, group, sample_size) -> DataFrame:
    """Draw rate of a group and rows wanted of each of its classes."""
    all_rows = F.sum("_n").over(Window.partitionBy(*group))
    rate = F.least(F.lit(1.0), F.lit(float(sample_size)) / all_rows) if sample_size else F.lit(1.0)
    return counts.withColumn("_rate", rate).withColumn("_want", F.col("_n") * F.col("_rate")).drop("_n")


def bootstrap_error(df, key, metric, trials=20, sample_size=None, seed=42, group=(),
                    label="is_fire", p="prob", w="eval_weight", parts=None, spread=None) -> DataFrame:
    """Sample standard deviation of a metric over bootstrap trials.

    metric: function(rows, group columns) -> one row per group with metric columns.
    parts, spread: a row's draws do not depend on its group, so rows that belong to
    several groups can be drawn once, summed by the columns `parts` and copied into
    their groups by spread(rows) afterwards. With a sample size the rate depends on the
    group, and rows are copied first. The sums per score are written once.
    """
    g = list(group)
    if spread is None or sample_size:
        df, parts, spread = (spread(df) if spread else df), g, lambda rows: rows
    drawn = bootstrap_weights(df, key, trials, label, sample_size, seed, g)
    sums = drawn.groupBy(*parts, "trial", label, p).agg(
        F.sum(F.col(w) * F.col("draws")).alias("_w"), F.sum("draws").alias("_k")
    )
    if parts != g:
        sums = spread(sums).groupBy(*g, "trial", label, p).agg(F.sum("_w").alias("_w"), F.sum("_k").alias("_k"))
    per_score = cut(sums)
    counts = spread(df.groupBy(*parts, label).agg(F.count(F.lit(1)).alias("_n")))
    size = _class_sizes(counts.groupBy(*g, label).agg(F.sum("_n").alias("_n")), g, sample_size)
    totals = per_score.groupBy(*g, "trial", label).agg(F.sum("_k").alias("_all")).join(size, [*g, label])
    # one row per group, trial and class
    scale = F.broadcast(totals.select(*g, "trial", label, (F.col("_want") / F.col("_all")).alias("_scale")))
    rows = per_score.join(scale, [*g, "trial", label]).withColumn(
        w, F.col("_w") * F.col("_scale")
    ).select(*g, "trial", label, p, w)
    table = metric(rows, [*g, "trial"])
    names = [c for c in table.columns if c not in (*g, "trial")]
    return table.groupBy(*g).agg(*[F.stddev_samp(c).alias(f"{c}_error") for c in names])


# --- training weights -----------------------------------------------------------


def training_weights(df, column, power=1.0, cap_quantile=None, out="train_weight") -> DataFrame:
    """Cleaned, powered, capped and mean-normalised sample weights."""
    v = finite(column)
    w = F.coalesce(F.when(v > 0, v), F.lit(1.0))
    base = df.withColumn(out, F.pow(w, F.lit(float(power))) if power != 1.0 else w)
    if cap_quantile is not None:
        q = min(max(float(cap_quantile), 0.0), 1.0)
        cap = exact_quantiles(base, out, {"cap": q}).scalar()
        base = base.withColumn("_cap", cap)
        limited = F.when(F.col("_cap") > 0, F.least(F.col(out), F.col("_cap"))).otherwise(F.col(out))
        base = base.withColumn(out, limited).drop("_cap")
    mean = base.agg(F.avg(out)).scalar()
    base = base.withColumn("_mean", mean)
    return base.withColumn(
        out, F.when(F.col("_mean") > 0, F.col(out) / F.col("_mean")).otherwise(F.col(out))
    ).drop("_mean")


def class_weights(df, label="is_fire", out="class_weight") -> DataFrame:
    """Balanced class weights n / (k * n_class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everyone = Window.partitionBy()
    table = sizes.select(
        label,
        (F.sum("_n").over(everyone) / (F.count(F.lit(1)).over(everyone) * F.col("_n"))).alias(out),
    )
    # a handful of class rows, folded into a map instead of a skewed join on the label
    lookup = table.agg(F.map_from_entries(F.collect_list(F.struct(label, out))).alias("m")).scalar()
    return df.withColumn("_m", lookup).withColumn(out, F.element_at("_m", F.col(label))).drop("_m")


def expand_soft_labels(df, soft="soft_label", label="is_fire", weight="soft_weight") -> DataFrame:
    """Uncertain negatives become a weighted negative and a weighted positive."""
    y = F.col(label).cast("int")
    s = F.greatest(F.least(F.greatest(F.coalesce(finite(soft), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), y)
    split = (y == 0) & (s > 0) & (s < 1)
    pair = F.array(
        F.struct(y.alias("y"), F.when(split, 1.0 - s).otherwise(F.lit(1.0)).alias("w")),
        F.when(split, F.struct(F.lit(1).alias("y"), s.alias("w"))),
    )
    return df.withColumn("_x", F.explode(F.array_compact(pair))).withColumns(
        {label: F.col("_x.y"), weight: F.col("_x.w")}
    ).drop("_x")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
