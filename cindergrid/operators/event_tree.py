"""An adaptive quadtree over event positions, searched round by round.

Cells halve the globe's 360 degrees again and again. A cell with more than LEAF distinct
positions is divided into sixteen, by repeated counts; a leaf holds its positions. Every
node knows the box, the number and one position of its events, so a search keeps for a
place only the nodes that can still matter: each round is one join of the open pairs
with the nodes of the next level, for all places together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.cells import haversine_km
from cindergrid.session import cut

LEAF = 128  # distinct positions of a leaf at most
ROOT = 4  # halvings of 360 degrees before the first cells, so at most 256 of them
STEP = 2  # halvings from a node to its children
DEEPEST = 28  # cells of about 0.15 m, which may hold more than LEAF positions


def _spread(rows, *by) -> DataFrame:
    """Rows dealt by place over all tasks: few rows may stand for much work, which no size of theirs shows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _cell(level: int) -> list[Column]:
    side = 360.0 / 2**level
    top = 2**level - 1
    place = lambda c: F.least(F.greatest(F.floor((F.col(c) + 180.0) / side), F.lit(0)), F.lit(top)).cast("bigint")
    return [place("ex"), place("ey")]


class EventTree:
    """`roots`: one row with an array of nodes; `nodes[level]`: children arrays keyed by (cx, cy); `leaves`: positions keyed by (level, cx, cy)."""

    def __init__(self, roots: Column, nodes: dict[int, DataFrame], leaves: DataFrame):
        self.roots, self.nodes, self.leaves = roots, nodes, leaves


def event_tree(events, x="longitude", y="latitude", weight: Column | None = None) -> EventTree:
    """The tree of all events with a position; `weight` of an event is 1 unless given.

    Longitudes are taken round the globe, so -180 and 180 are one place. The driver sees one
    number per level: whether positions are left to divide.
    """
    turned = F.pmod(F.col(x).cast("double") + 180.0, F.lit(360.0)) - 180.0
    plain = F.when(F.col(x).between(-180.0, 179.999999999), F.col(x).cast("double")).otherwise(turned)
    known = events.filter(F.col(x).isNotNull() & F.col(y).between(-90.0, 90.0) & ~F.isnan(F.col(x).cast("double")))
    open_ = cut(known.groupBy(plain.alias("ex"), F.col(y).cast("double").alias("ey")).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).cast("double").alias("n")))
    level, summaries, leaves = ROOT, {}, None
    while True:
        cx, cy = _cell(level)
        placed = open_.withColumns({"cx": cx, "cy": cy})
        inner = cut(placed.groupBy("cx", "cy").agg(
            F.count(F.lit(1)).alias("positions"), F.sum("n").alias("total"), F.min("ex").alias("x0"), F.max("ex").alias("x1"),
            F.min("ey").alias("y0"), F.max("ey").alias("y1"), F.min(F.struct("ex", "ey")).alias("one"),
        ))
        last = level >= DEEPEST
        divide = F.lit(False) if last else F.col("positions") > LEAF
        middle = {"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2}
        corner = F.greatest(haversine_km("my", "mx", "y0", "x0"), haversine_km("my", "mx", "y1", "x0"))
        summaries[level] = inner.withColumns(middle).withColumns({"reach": corner, "leaf": ~divide})
        full = placed.join(inner.select("cx", "cy", "positions"), ["cx", "cy"])
        held = full.filter(~divide).groupBy("cx", "cy").agg(F.collect_list(F.struct("ex", "ey", "n")).alias("positions"))
        held = held.select(F.lit(level).alias("level"), "cx", "cy", "positions")
        leaves = held if leaves is None else leaves.unionByName(held)
        if last or inner.filter(divide).isEmpty():
            break
        open_ = cut(full.filter(divide).select("ex", "ey", "n"))
        level += STEP
    box = F.struct("cx", "cy", "total", "x0", "x1", "y0", "y1", "mx", "my", "reach", "one", "leaf")
    nodes = {}
    for upper in list(summaries)[:-1]:
        below = summaries[upper + STEP].withColumns({"px": F.shiftright("cx", STEP), "py": F.shiftright("cy", STEP)})
        nodes[upper] = cut(below.groupBy("px", "py").agg(F.collect_list(box).alias("children")))  # at most 16
    roots = summaries[ROOT].agg(F.collect_list(box).alias("r")).scalar()  # at most 256
    return EventTree(roots, nodes, cut(leaves))


def with_low(pairs, x, y) -> DataFrame:
    """Add `low`: the least possible distance from (x, y) to a node's box (x0, x1, y0, y1), a little rounded down.

    On the meridian of the box that is nearest in longitude, distance falls towards one
    latitude and grows beyond it; that latitude is held within the box.
    """
    turn = lambda c: F.pmod(F.abs(F.col(x) - F.col(c)), F.lit(360.0))
    # a column for each step: written as one expression they would repeat each other
    steps = pairs.withColumns({"_d0": turn("x0"), "_d1": turn("x1")})
    inside = (F.col(x) >= F.col("x0")) & (F.col(x) <= F.col("x1"))
    steps = steps.withColumn("_d0", F.when(inside, 0.0).otherwise(F.least("_d0", 360.0 - F.col("_d0"), "_d1", 360.0 - F.col("_d1"))))
    phi = F.radians(F.col(y))
    steps = steps.withColumn("_d1", F.degrees(F.atan2(F.sin(phi), F.cos(phi) * F.cos(F.radians("_d0")))))
    steps = steps.withColumn("_d1", F.least(F.greatest("_d1", "y0"), F.col("y1")))
    return steps.withColumn("low", haversine_km(F.col(y), F.lit(0.0), "_d1", "_d0") * (1 - 1e-9) - 1e-7).drop("_d0", "_d1")


def with_high(pairs, x, y) -> DataFrame:
    """Add `high`: no place of a node's box is farther, by way of its middle."""
    return pairs.withColumn("high", (haversine_km(F.col(y), F.col(x), "my", "mx") + F.col("reach")) * (1 + 1e-9) + 1e-7)


def nearest(points, tree: EventTree, x="longitude", y="latitude", out="nearest_km") -> tuple[DataFrame, list[DataFrame]]:
    """Distance from every distinct position to its nearest event, and the open pairs of each round.

    In each round a place keeps the nodes whose least possible distance is not above the
    distance to the nearest single event seen so far; leaves that are left at the end compare
    their positions.
    """
    spots = points.select(x, y).distinct()
    look = _spread(spots.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y).withColumn("_r", tree.roots)

    def bounded(rows, level):
        """Pairs of places and nodes (_n) with the nodes' least distance and that of one of their events."""
        one = rows.select(x, y, F.col("_n.*")).withColumn("high", haversine_km(F.col(y), F.col(x), "one.ey", "one.ex"))
        return with_low(one, x, y).select(x, y, F.lit(level).alias("level"), "cx", "cy", "leaf", "low", "high")

    def pruned(pairs):
        best = F.min("high").over(Window.partitionBy(x, y))
        return cut(pairs.withColumn("best", best).filter(F.col("low") <= F.col("best")).drop("best"))

    pairs = pruned(bounded(look.select(x, y, F.explode("_r").alias("_n")), ROOT))
    rounds = [pairs]
    for level, nodes in tree.nodes.items():
        going = pairs.filter((F.col("level") == level) & ~F.col("leaf")).select(x, y, F.col("cx").alias("px"), F.col("cy").alias("py"))
        below = _spread(going, x, y).join(nodes, ["px", "py"]).select(x, y, F.explode("children").alias("_n"))
        pairs = pruned(pairs.filter("leaf").unionByName(bounded(below, level + STEP)))
        rounds.append(pairs)
    met = _spread(pairs, x, y).join(tree.leaves, ["level", "cx", "cy"])
    each = met.select(x, y, F.explode("positions").alias("_p"))
    found = each.groupBy(x, y).agg(F.min(haversine_km(F.col(y), F.col(x), F.col("_p.ey"), F.col("_p.ex"))).alias(out))
    return spots.join(found, [x, y], "left"), rounds


def within(points, tree: EventTree, radii_km, x="longitude", y="latitude") -> DataFrame:
    """(x, y, _r0, _r1, ...): weight of the events within each radius of every distinct position that has any.

    A node that lies wholly inside a radius adds its total; nodes outside all radii are
    left; only nodes that a circle cuts are opened, and only leaves that it cuts compare
    their positions.
    """
    spots = points.select(x, y).distinct().filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    names = [f"_r{i}" for i in range(len(radii_km))]

    def split(rows, level):
        """Sums of nodes that are inside, and pairs to open; `rows` has x, y, _open (radii asked for) and _n."""
        s = rows.select(x, y, "_open", F.col("_n.*"))
        s = with_high(with_low(s, x, y).filter(F.col("low") <= max(radii_km)), x, y)
        inside = [F.col("_open")[i] & (F.col("high") <= r) for i, r in enumerate(radii_km)]
        cuts = [F.col("_open")[i] & (F.col("high") > r) & (F.col("low") <= r) for i, r in enumerate(radii_km)]
        kept = s.select(
            x, y, F.lit(level).alias("level"), "cx", "cy", "leaf", F.array(*cuts).alias("_open"),
            *[F.when(c, F.col("total")).otherwise(0.0).alias(nm) for c, nm in zip(inside, names, strict=True)],
        )
        return cut(kept.filter(F.array_contains("_open", True) | (sum((F.col(nm) for nm in names), F.lit(0.0)) != 0)))

    opened = F.array_contains("_open", True)
    every = F.array(*[F.lit(True) for _ in radii_km])
    rows = _spread(spots, x, y).withColumns({"_open": every, "_roots": tree.roots}).select(x, y, "_open", F.explode("_roots").alias("_n"))
    level_rows = split(rows, ROOT)
    parts = [level_rows]
    for level, nodes in tree.nodes.items():
        going = level_rows.filter(~F.col("leaf") & opened).select(x, y, "_open", F.col("cx").alias("px"), F.col("cy").alias("py"))
        rows = _spread(going, x, y).join(nodes, ["px", "py"]).select(x, y, "_open", F.explode("children").alias("_n"))
        level_rows = split(rows, level + STEP)
        parts.append(level_rows)
    whole = leaf = None
    for part in parts:
        one, two = part.select(x, y, *names), part.filter(F.col("leaf") & opened).select(x, y, "level", "cx", "cy", "_open")
        whole = one if whole is None else whole.unionByName(one)
        leaf = two if leaf is None else leaf.unionByName(two)
    met = _spread(leaf, x, y).join(tree.leaves, ["level", "cx", "cy"]).select(x, y, "_open", F.explode("positions").alias("_p"))
    met = met.withColumn("_d", haversine_km(F.col(y), F.col(x), F.col("_p.ey"), F.col("_p.ex")))
    single = met.select(x, y, *[
        F.when(F.col("_open")[i] & (F.col("_d") <= r), F.col("_p.n")).otherwise(0.0).alias(nm) for i, (r, nm) in enumerate(zip(radii_km, names, strict=True))
    ])
    return whole.unionByName(single).groupBy(x, y).agg(*[F.sum(nm).alias(nm) for nm in names])
