"""Nearest events and counts within radii by the adaptive quadtree."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import event_tree as T
from cindergrid.operators import spatial

SPOT = "longitude double, latitude double"


def away(a, b):
    (x, y), (u, v) = ([math.radians(t) for t in p] for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


def places(seed, n):
    draw = random.Random(seed)
    out = [(draw.uniform(-180, 180), draw.uniform(-90, 90)) for _ in range(n)]
    out += [(draw.choice([-1, 1]) * draw.uniform(179.5, 180), draw.uniform(-1, 1)) for _ in range(n)]
    out += [(draw.uniform(-180, 180), draw.choice([-1, 1]) * draw.uniform(89, 90)) for _ in range(n)]
    return out + [(10 + draw.gauss(0, 0.05), 50 + draw.gauss(0, 0.05)) for _ in range(4 * n)]


@pytest.mark.parametrize("leaf", [4])
def test_against_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(T, "LEAF", leaf)
    events, spots = places(1, 60), places(2, 25) + [(180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (0.0, -90.0)]
    events += events[:50]  # positions that repeat
    frame = lambda rows: spark.createDataFrame(rows, SPOT)
    bad = [(None, 1.0), (1.0, None), (float("nan"), 1.0)]
    near = {(r.longitude, r.latitude): r.nearest_km for r in spatial.nearest_event_km(frame(spots), frame(events + bad)).collect()}
    assert near == {p: pytest.approx(min(away(p, e) for e in events), abs=1e-6) for p in spots}
    radii = [5.0, 300.0, 2500.0]
    got = {(r.longitude, r.latitude): (r.count_5km, r.count_300km, r.count_2500km) for r in spatial.counts_within(frame(spots), frame(events + bad), radii).collect()}
    assert got == {p: tuple(float(sum(away(p, e) <= r for e in events)) for r in radii) for p in spots}


def test_few_pairs_for_a_far_dense_cluster(spark):
    """A hundred thousand events in one place, looked at from 500 km away and from within."""
    events = spark.range(100_000).select(
        (10.0 + F.rand(1) * 0.5).alias("longitude"), (50.0 + F.rand(2) * 0.5).alias("latitude")
    )
    tree = T.event_tree(events)
    assert tree.leaves.agg(F.max(F.size("positions"))).first()[0] <= T.LEAF
    draw = random.Random(5)
    far = [(3.0 + draw.uniform(0, 0.01), 50.2 + draw.uniform(0, 0.01)) for _ in range(50)] + [(10.2 + draw.uniform(0, 0.1), 50.2 + draw.uniform(0, 0.1)) for _ in range(50)]
    found, rounds = T.nearest(spark.createDataFrame(far, SPOT), tree)
    most = [r.groupBy("longitude", "latitude").count().agg(F.max("count")).first()[0] for r in rounds]
    assert max(most) <= 64
    known = [(r.longitude, r.latitude) for r in events.collect()]
    got = {(r.longitude, r.latitude): r.nearest_km for r in found.collect()}
    for p in far[:3] + far[-3:]:
        assert got[p] == pytest.approx(min(away(p, e) for e in known), abs=1e-6)


def test_leaves_stay_small_where_events_crowd(spark):
    """A third of all events within 30 metres."""
    crowd = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, 20.0 + F.rand(3) * 3e-4).otherwise(F.rand(4) * 40).alias("longitude"),
        F.when(F.col("id") % 3 == 0, 5.0 + F.rand(5) * 3e-4).otherwise(F.rand(6) * 40).alias("latitude"),
    )
    tree = T.event_tree(crowd)
    sizes = tree.leaves.agg(F.max(F.size("positions")), F.sum(F.size("positions"))).first()
    assert sizes[0] <= T.LEAF and sizes[1] == 10_000


def test_nothing_there(spark):
    none = spark.createDataFrame([], SPOT)
    one = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], SPOT)
    assert {(r.longitude, r.nearest_km) for r in spatial.nearest_event_km(one, none).collect()} == {(1.0, None), (None, None)}
    assert {r.count_5km for r in spatial.counts_within(one, none, [5.0]).collect()} == {0.0}
    assert spatial.nearest_event_km(none, one).count() == 0 and spatial.counts_within(none, one, [5.0]).count() == 0
