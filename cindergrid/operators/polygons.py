"""A point-location grid over polygons with parts and holes.

Every polygon is cut by a grid of buckets. A piece of the index is one polygon in
one bucket: whether the bucket's upper left corner lies inside, and the edges that
pass through the bucket. A position walks from that corner to its place, first along
the upper side, then down, and changes sides at every edge it crosses. So a position
meets the edges of its own bucket only, however long the polygon's border is, and a
bucket without edges needs no test at all.

Buckets with more than PIECE edges are cut into sixteen smaller ones, again and again;
where SMALLEST is reached (many edges meet in one place), the edges of a bucket are
dealt to several pieces, whose crossings add up.

Longitudes are taken round the globe: an edge that spans more than 180 degrees is the
short one across the date line (one of exactly 360 degrees, such as along a pole, is
taken as it is drawn).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.session import cut

PIECE = 128  # edges of a piece at most
SMALLEST = 6  # times that a bucket is cut into sixteen
#: Bucket borders lie off the decimal grid that coordinates come on.
SHIFT = 0.0007391


def part_lists(polygons) -> Column:
    """All rings of a polygon: `parts`, or the only one in `ring`."""
    return F.col("parts") if "parts" in polygons.columns else F.array("ring")


def rings(polygons, attrs) -> DataFrame:
    """One row per ring of every distinct polygon: _pid, attrs, _ring (number), _path (vertices without NULLs)."""
    known = polygons.select(*attrs, part_lists(polygons).alias("_parts"))
    known = known.withColumn("_pid", F.xxhash64(*attrs, "_parts")).dropDuplicates(["_pid"])
    each = known.select("_pid", *attrs, F.posexplode("_parts").alias("_ring", "_path"))
    sound = F.filter("_path", lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return each.withColumn("_path", sound).filter(F.size("_path") > 2)


def _place(x) -> Column:
    """Longitude as 0 to 360 on the shifted grid."""
    return F.pmod(_col(x) + (180.0 - SHIFT), F.lit(360.0))


def _height(y) -> Column:
    return _col(y) + (90.0 - SHIFT)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ring_edges(rings_) -> DataFrame:
    """One row per edge: _pid, _ring, a1, b1, a2, b2 on the shifted grid, and how often its end lies round the globe."""
    size = F.size("_path")
    edge = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            F.element_at("_path", i)["x"].alias("x1"), F.element_at("_path", i)["y"].alias("y1"),
            F.element_at("_path", F.pmod(i, size) + 1)["x"].alias("x2"), F.element_at("_path", F.pmod(i, size) + 1)["y"].alias("y2"),
        ),
    )
    e = rings_.select("_pid", "_ring", F.explode(edge).alias("_e")).select(
        "_pid", "_ring", *[F.col(f"_e.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    ).filter("x1 <> x2 or y1 <> y2")
    along = F.col("x2") - F.col("x1")
    return e.select(
        "_pid", "_ring", _place("x1").alias("a1"), _height("y1").alias("b1"), _place("x2").alias("a2"), _height("y2").alias("b2"),
        F.round((_place("x1") + _short(along) - _place("x2")) / 360.0).cast("int").alias("turn"),
    )


def _slot(v, size: float) -> Column:
    return F.floor(_col(v) / F.lit(size)).cast("long")


def _crossing_height(x) -> Column:
    """Height at which an edge passes a longitude, held within the edge."""
    raw = F.col("b1") + (F.col("b2") - F.col("b1")) * ((_col(x) - F.col("a1")) / (F.col("a2") - F.col("a1")))
    return F.least(F.greatest(raw, F.least("b1", "b2")), F.greatest("b1", "b2"))


def _dealt(edges, size: float, within: bool) -> DataFrame:
    """Edges in every bucket they pass; `_up` marks those that cross the bucket's left border inside it.

    `within` keeps edges of a coarser bucket (_px, _py) to its own sixteen.
    """
    whole = round(360 / size)
    low, high = F.least("a1", "a2"), F.greatest("a1", "a2")
    if within:
        span = F.sequence(F.greatest(_slot(low, size), F.col("_px") * 4), F.least(_slot(high, size), F.col("_px") * 4 + 3))
        placed = edges.filter(
            F.greatest(_slot(low, size), F.col("_px") * 4) <= F.least(_slot(high, size), F.col("_px") * 4 + 3)
        ).withColumn("_bx", F.explode(span))
    else:
        end = F.col("a2") + 360.0 * F.col("turn")
        column = F.explode(F.sequence(_slot(F.least("a1", end), size), _slot(F.greatest("a1", end), size)))
        round_ = F.floor(F.col("_c") / whole).cast("int")
        placed = edges.withColumn("_c", column).withColumns({
            "_bx": F.pmod("_c", F.lit(whole)), "a1": F.col("a1") - 360.0 * round_, "a2": F.col("a2") + 360.0 * (F.col("turn") - round_),
        }).drop("_c", "turn")
    left = F.col("_bx") * F.lit(size)
    upright = F.col("a1") == F.col("a2")
    ends = [_crossing_height(F.least(F.greatest(e, left), left + size)) for e in (low, high)]
    bottom = F.when(upright, F.least("b1", "b2")).otherwise(F.least(*ends)) - 1e-9
    top = F.when(upright, F.greatest("b1", "b2")).otherwise(F.greatest(*ends)) + 1e-9
    crosses = (F.col("a1") <= left) != (F.col("a2") <= left)
    first, last = _slot(bottom, size), _slot(top, size)
    if within:
        first, last = F.greatest(first, F.col("_py") * 4), F.least(last, F.col("_py") * 4 + 3)
        placed = placed.filter(first <= last)
    return placed.withColumn("_by", F.explode(F.sequence(first, last))).withColumn(
        "_up", F.when(crosses, _slot(_crossing_height(left), size) == F.col("_by")).otherwise(False)
    )


EDGE = ("a1", "b1", "a2", "b2")


@dataclass
class PolygonIndex:
    """Pieces (_pid, attrs, _lv, _bx, _by, _in, _edges, _many, and _ax, _ay of the coarsest bucket around) and the levels there are."""

    attrs: list[str]
    size: float
    pieces: DataFrame | None = None
    levels: list[int] = field(default_factory=list)

    def bucket(self, level: int) -> float:
        return self.size / 4**level


def polygon_index(polygons, attrs, size=0.25) -> PolygonIndex:
    """The index of all polygons; written to the checkpoint folder, level by level."""
    if 360 / size != int(360 / size) or (size * 1024) % 1:
        raise ValueError("the bucket size must divide 360 and be a multiple of 1/1024")
    attrs = list(attrs)
    index = PolygonIndex(attrs, float(size))
    owners = rings(polygons, attrs)
    edges = ring_edges(owners).drop("_ring")
    parents = None
    key = ["_pid", "_bx", "_by"]
    column = Window.partitionBy("_pid", "_bx", "_py").orderBy(F.desc("_by"))
    above = column.rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    for level in range(SMALLEST + 1):
        size_ = index.bucket(level)
        dealt = cut(_dealt(edges, size_, level > 0).select(*key, *EDGE, "_up"))
        counts = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_up").alias("_ups"))
        if level == 0:
            # the way to a corner starts north of everything
            known = counts.withColumns({"_py": F.lit(0).cast("long"), "_from": F.lit(0).cast("long")})
        else:
            known = parents.join(counts, key, "left").fillna(0, ["_n", "_ups"])
        known = known.withColumn("_in", F.pmod(F.col("_from") + F.coalesce(F.sum("_ups").over(above), F.lit(0)), F.lit(2)).cast("int"))
        known = cut(known.select(*key, "_py", "_n", "_ups", "_in"))
        last = level == SMALLEST
        few = F.lit(True) if last else F.col("_n") <= PIECE
        deep = F.pmod(F.xxhash64(*EDGE), F.ceil(F.col("_n") / PIECE * 2)) if last else F.lit(0).cast("long")
        own = known.filter("_n > 0").filter(few)
        held = dealt.join(own, key).withColumn("_k", F.when(F.col("_n") > PIECE, deep).otherwise(0)).groupBy(*key, "_in", "_n", "_k").agg(
            F.collect_list(F.struct(*EDGE)).alias("_edges")
        ).select(*key, F.when(F.col("_n") > PIECE, 0).otherwise(F.col("_in")).alias("_in"), "_edges", (F.col("_n") > PIECE).alias("_many"))
        # buckets that no edge passes lie inside or outside as a whole
        if level == 0:
            after = F.pmod(F.col("_in") + F.col("_ups"), F.lit(2))
            next_ = F.coalesce(F.lead("_by").over(column), F.lit(-2))
            inside = known.withColumns({"_next": next_, "_after": after}).filter("_after = 1 and _next < _by - 1").withColumn(
                "_by", F.explode(F.sequence(F.col("_next") + 1, F.col("_by") - 1))
            )
        else:
            inside = known.filter("_n = 0 and _in = 1")
        without = F.lit(None).cast(held.schema["_edges"].dataType).alias("_edges")
        bare = inside.select(*key, F.lit(1).alias("_in"), without, F.lit(False).alias("_many"))
        if last:
            corner = own.filter(F.col("_n") > PIECE).select(*key, "_in", without, F.lit(True).alias("_many"))
            bare = bare.unionByName(corner)
        parts.append(held.unionByName(bare).withColumns({
            "_lv": F.lit(level), "_ax": F.shiftright("_bx", 2 * level), "_ay": F.shiftright("_by", 2 * level),
        }))
        index.levels.append(level)
        crowded = known.filter("_n > 0").filter(~few)
        if last or crowded.isEmpty():
            break
        # edges of crowded buckets, and where the way to the corners of their sixteen parts starts
        edges = dealt.join(crowded.select(*key), key).select("_pid", F.col("_bx").alias("_px"), F.col("_by").alias("_py"), *EDGE)
        upper, finer = (F.col("_py") + 1) * F.lit(size_), index.bucket(level + 1)
        meets = (F.col("b1") >= upper) != (F.col("b2") >= upper)
        at = F.col("a1") + (F.col("a2") - F.col("a1")) * ((upper - F.col("b1")) / (F.col("b2") - F.col("b1")))
        left = F.col("_px") * F.lit(size_)
        passed = edges.filter(meets).groupBy("_pid", "_px", "_py").agg(
            *[F.count_if((at > left) & (at <= left + j * finer)).alias(f"_t{j}") for j in range(4)]
        )
        start = crowded.select("_pid", F.col("_bx").alias("_px"), F.col("_by").alias("_py"), "_in").join(passed, ["_pid", "_px", "_py"], "left").fillna(0)
        sixteen = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_t{j}").alias("t")) for i in range(4) for j in range(4)]))
        parents = start.withColumn("_s", sixteen).select(
            "_pid", (F.col("_px") * 4 + F.col("_s.j")).alias("_bx"), (F.col("_py") * 4 + F.col("_s.i")).alias("_by"), "_py",
            (F.col("_in") + F.col("_s.t")).alias("_from"),
        )
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    index.pieces = cut(pieces.join(owners.select("_pid", *attrs).distinct(), "_pid"))
    return index


def _flips(u, v, size: Column) -> Column:
    """Edges crossed on the way from the bucket's upper left corner to (u, v)."""
    left, upper = F.col("_bx") * size, (F.col("_by") + 1) * size

    def crossed(e):
        at = e["a1"] + (e["a2"] - e["a1"]) * ((upper - e["b1"]) / (e["b2"] - e["b1"]))
        height = e["b1"] + (e["b2"] - e["b1"]) * ((u - e["a1"]) / (e["a2"] - e["a1"]))
        height = F.least(F.greatest(height, F.least(e["b1"], e["b2"])), F.greatest(e["b1"], e["b2"]))
        beside = ((e["b1"] >= upper) != (e["b2"] >= upper)) & (at > left) & (at <= u)
        down = ((e["a1"] <= u) != (e["a2"] <= u)) & (height > v) & (height < upper)
        return beside.cast("int") + down.cast("int")

    return F.coalesce(F.aggregate("_edges", F.lit(0), lambda n, e: n + F.coalesce(crossed(e), F.lit(0))), F.lit(0))


def located(spots, index: PolygonIndex, x, y, *more) -> DataFrame:
    """spots x pieces of their own buckets that hold them: columns of spots, _pid and attrs; one row per polygon.

    `spots` are distinct in (x, y, more).
    """
    names = spots.columns
    size = F.element_at(F.array(*[F.lit(index.bucket(v)) for v in index.levels]), F.col("_lv") + 1)
    keyed = spots.filter(F.col(y).between(-90.0, 90.0) & F.col(x).isNotNull() & ~F.isnan(x)).withColumns({"_u": _place(x), "_v": _height(y)})
    keyed = keyed.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in index.levels]))) if len(index.levels) > 1 else keyed.withColumn("_lv", F.lit(0))
    keyed = keyed.withColumns({"_bx": F.floor(F.col("_u") / size).cast("long"), "_by": F.floor(F.col("_v") / size).cast("long")})
    met = keyed.join(index.pieces, ["_lv", "_bx", "_by"]).withColumn("_odd", F.pmod(F.col("_in") + _flips(F.col("_u"), F.col("_v"), size), F.lit(2)))
    plain = met.filter("not _many and _odd = 1").select(*names, "_pid", *index.attrs)
    if SMALLEST not in index.levels:
        return plain
    summed = met.filter("_many").groupBy(*names, "_pid", *index.attrs).agg(F.sum("_odd").alias("_odd")).filter(F.pmod("_odd", F.lit(2)) == 1)
    return plain.unionByName(summed.drop("_odd"))


def unrolled() -> Column:
    """Longitudes of `_path`, running on beyond 180 degrees where the ring crosses the date line."""
    step = lambda i: F.element_at("_path", i + 1)["x"] - F.element_at("_path", i)["x"]
    steps = F.sequence(F.lit(1), F.size("_path") - 1)
    run = F.aggregate(
        steps, F.array(F.element_at("_path", 1)["x"].cast("double")),
        lambda xs, i: F.concat(xs, F.array(F.element_at(xs, -1) + _short(step(i)))),
    )
    over = F.exists(steps, lambda i: (F.abs(step(i)) > 180.0) & (F.abs(step(i)) != 360.0))
    return F.when(over, run).otherwise(F.transform("_path", lambda v: v["x"].cast("double")))


def area_kha(polygons, attrs) -> DataFrame:
    """attrs, kha, and the box (x0, x1 unrolled eastward, y0, y1) of every distinct polygon.

    A ring adds its area if an even number of the polygon's other rings lie around it and
    takes it away if an odd number do; that number is found by locating three places of the
    ring in an index of all rings, each as a polygon of its own. Areas are plane areas
    scaled by the cosine of the box's middle latitude, as the rates they are used with are.
    """
    from cindergrid.functions.cells import KM_PER_DEGREE

    attrs = list(attrs)
    each = cut(rings(polygons, attrs))
    flat = each.withColumn("_xs", unrolled()).withColumn("_ys", F.transform("_path", lambda v: v["y"].cast("double")))
    n = F.size("_xs")
    cross = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0),
        lambda s, i: s + F.element_at("_xs", i) * F.element_at("_ys", F.pmod(i, n) + 1) - F.element_at("_xs", F.pmod(i, n) + 1) * F.element_at("_ys", i),
    )
    flat = flat.select("_pid", *attrs, "_ring", F.abs(cross).alias("_twice"), "_xs", "_ys")
    several = each.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rings")).filter("_rings > 1").select("_pid")
    own = each.join(several, "_pid").select(F.col("_pid").alias("_of"), F.col("_ring").alias("_as"), F.array("_path").alias("parts"))
    index = polygon_index(own, ["_of", "_as"])
    # the middles of three edges, as a ring may touch another one
    third = lambda k: F.floor((n - 1) * k / 3).cast("int") + 1
    middle_of = lambda c, i: (F.element_at(c, i) + F.element_at(c, i + 1)) / 2
    probe = F.array(*[F.struct(F.lit(k).alias("k"), middle_of("_xs", third(k)).alias("x"), middle_of("_ys", third(k)).alias("y")) for k in range(3)])
    probes = flat.join(several, "_pid").select(F.col("_pid").alias("_own"), "_ring", F.explode(probe).alias("_p")).select(
        "_own", "_ring", F.col("_p.k").alias("_k"), F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y")
    )
    around = located(probes, index, "_x", "_y").filter("_own = _of and _ring <> _as")
    each_depth = around.groupBy("_own", "_ring", "_k").agg(F.count(F.lit(1)).alias("_depth"))
    depth = each_depth.groupBy(F.col("_own").alias("_pid"), "_ring").agg(
        F.element_at(F.array_sort(F.concat(F.collect_list("_depth"), F.array_repeat(F.lit(0).cast("bigint"), 3))), -2).alias("_depth")
    )
    signed = flat.join(depth, ["_pid", "_ring"], "left")
    sign = F.when(F.pmod(F.coalesce("_depth", F.lit(0)), F.lit(2)) == 1, -1.0).otherwise(1.0)
    box = signed.groupBy("_pid", *attrs).agg(
        F.sum(sign * F.col("_twice")).alias("_twice"), F.min(F.array_min("_xs")).alias("x0"), F.max(F.array_max("_xs")).alias("x1"),
        F.min(F.array_min("_ys")).alias("y0"), F.max(F.array_max("_ys")).alias("y1"),
    )
    middle = F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    return box.select(*attrs, "x0", "x1", "y0", "y1", (F.col("_twice") / 2).alias("square_degrees"), (F.col("_twice") / 2 * KM_PER_DEGREE**2 * middle / 10.0).alias("kha"))


def _short(along) -> Column:
    return F.when(F.abs(along) == 360.0, along).otherwise(along - 360.0 * F.round(along / 360.0))
