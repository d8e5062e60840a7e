"""Polygons with parts and holes: location, distance, area and candidate cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import grids, polygons, spatial

SHAPE = "name string, value double, parts array<array<struct<x:double,y:double>>>"
SPOT = "longitude double, latitude double"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def star(cx, cy, r, n, seed, wrap=False):
    draw = random.Random(seed)
    made = [(cx + r * draw.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * draw.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [((x + 180) % 360 - 180 if wrap else x, y) for x, y in [*made, made[0]]]


#: an island in a lake, two parts, one across 180 degrees, one round the pole, one with an open ring
SHAPES = [
    ("lake", 1.0, [box(10, 10, 14, 14), box(11, 11, 13, 13), box(11.6, 11.6, 12.4, 12.4)]),
    ("two", 2.0, [star(20, 5, 1.5, 40, 1), star(24, 5, 1.2, 30, 2)]),
    ("date line", 3.0, [star(179.7, 0, 2.0, 60, 3, True), star(-179.5, 0.1, 0.2, 12, 4, True)]),
    ("pole", 4.0, [[(-180, -80), (-90, -78), (0, -81), (90, -77), (180, -80), (180, -90), (-180, -90), (-180, -80)]]),
    ("open", 5.0, [[(30, 30), (32, 30), (31, 32)]]),
    ("border", 6.0, [star(20.5, 5.3, 3.0, 700, 5)]),
]


def inside(parts, x, y):
    """Parity of edges north of the place; edges longer than half the globe go the other way round."""
    odd = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            d = x2 - x1
            d = d if abs(d) == 360 else d - 360 * round(d / 360)
            for turn in (-360, 0, 360):
                u = x + turn
                if (x1 <= u) != (x1 + d <= u) and y1 + (y2 - y1) * (u - x1) / d > y:
                    odd = not odd
    return odd


def spots(seed, n):
    draw = random.Random(seed)
    found = [(draw.uniform(9, 15), draw.uniform(9, 15)) for _ in range(n)] + [(draw.uniform(18, 26), draw.uniform(2, 8)) for _ in range(n)]
    found += [((draw.uniform(177, 183) + 180) % 360 - 180, draw.uniform(-2.5, 2.5)) for _ in range(n)]
    found += [(draw.uniform(-180, 180), draw.uniform(-90, -70)) for _ in range(n)] + [(draw.uniform(29, 33), draw.uniform(29, 33)) for _ in range(n)]
    # places on the lattice of the vertices, off the borders
    return found + [(10.5, 12.0), (11.0 + 1e-6, 12.0), (12.0, 12.0), (-180.0, 0.0), (180.0, 0.0), (0.0, -90.0), (0.0, 90.0), (31.0, 31.0)]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(n, v, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in parts]) for n, v, parts in SHAPES]
    # a repeated row is the same polygon
    return spark.createDataFrame([*rows, rows[0]], SHAPE)


@pytest.mark.parametrize(("size", "piece", "smallest"), [(2.5, 4, 6), (5.0, 3, 2)])
def test_places_are_found(spark, shapes, monkeypatch, size, piece, smallest):
    monkeypatch.setattr(polygons, "PIECE", piece)
    monkeypatch.setattr(polygons, "SMALLEST", smallest)
    index = polygons.polygon_index(shapes, ["name"], size)
    most = index.pieces.agg(F.max(F.size("_edges"))).first()[0]
    assert most <= piece or smallest == 2
    assert smallest != 2 or index.pieces.filter("_many").count() > 0
    places = spots(int(size * 4), 300)
    table = spark.createDataFrame([*places, (None, 1.0), (1.0, None), (float("nan"), 1.0)], SPOT).distinct()
    got = sorted((r.longitude, r.latitude, r.name) for r in polygons.located(table, index, "longitude", "latitude").collect())
    expected = sorted({(x, y, n) for x, y in places for n, _, parts in SHAPES if inside(parts, x, y)})
    assert got == expected


def test_hundred_thousand_vertices_in_one_place(spark):
    n = 100_000
    path = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(
        (5.0 + 0.02 * (1 + 0.3 * F.cos(i * (40 * 2 * math.pi / n))) * F.cos(i * (2 * math.pi / n))).alias("x"),
        (5.0 + 0.02 * (1 + 0.3 * F.cos(i * (40 * 2 * math.pi / n))) * F.sin(i * (2 * math.pi / n))).alias("y"),
    ))
    flower = spark.range(1).select(F.lit("f").alias("name"), path.alias("ring"))
    index = polygons.polygon_index(flower, ["name"])
    assert index.pieces.agg(F.max(F.size("_edges"))).first()[0] <= polygons.PIECE
    draw = random.Random(3)
    places = [(5 + draw.uniform(-0.03, 0.03), 5 + draw.uniform(-0.03, 0.03)) for _ in range(2000)]
    got = {(r.longitude, r.latitude) for r in polygons.located(spark.createDataFrame(places, SPOT), index, "longitude", "latitude").collect()}
    edge = lambda x, y: 0.02 * (1 + 0.3 * math.cos(40 * math.atan2(y, x)))
    far = [(x, y, math.hypot(x - 5, y - 5) - edge(x - 5, y - 5)) for x, y in places]
    assert all(((x, y) in got) == (d < 0) for x, y, d in far if abs(d) > 1e-6)


def test_means_across_the_date_line(spark, shapes):
    """The mean of polygons that hold a place or come within a radius, against every edge."""
    km = math.pi * 6371.0 / 180
    places = [p for p in spots(7, 60) if p[1] > -89]

    def near(parts, x, y, r):
        if inside(parts, x, y):
            return True
        for ring in parts:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                d = x2 - x1
                d = d if abs(d) == 360 else d - 360 * round(d / 360)
                for turn in (-360, 0, 360):
                    k = math.cos(math.radians(y)) * km
                    ax, ay, dx, dy = (x1 + turn - x) * k, (y1 - y) * km, d * k, (y2 - y1) * km
                    t = min(1, max(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                    if math.hypot(ax + t * dx, ay + t * dy) <= r:
                        return True
        return False

    shapes_ = [s for s in SHAPES if s[0] != "pole"]
    table = shapes.filter("name <> 'pole'")
    got = {(r.longitude, r.latitude): (r.value, r.polygons) for r in spatial.polygon_mean(spark.createDataFrame(places, SPOT), table, "value", 25.0).collect()}
    expected = {}
    for x, y in places:
        met = [v for _, v, parts in shapes_ if near(parts, x, y, 25.0)]
        if met:
            expected[x, y] = (pytest.approx(sum(met) / len(met)), len(met))
    assert got == expected
    assert any(abs(x) > 179.9 for x, _ in got)


def test_areas_of_holes_and_parts(spark, shapes):
    found = {r.name: r.square_degrees for r in polygons.area_kha(shapes, ["name"]).collect()}
    plane = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert found["lake"] == pytest.approx(16 - 4 + 0.64)
    assert found["two"] == pytest.approx(sum(plane(r) for r in SHAPES[1][2]))
    line = [[(x if x > 0 else x + 360, y) for x, y in ring] for ring in SHAPES[2][2]]
    assert found["date line"] == pytest.approx(plane(line[0]) - plane(line[1]))
    assert found["open"] == pytest.approx(2.0)


def test_candidate_cells_of_lakes_and_across_the_date_line(spark, shapes):
    two = shapes.filter("name in ('lake', 'date line')")
    got = {(r.country, r.lat_key, r.lon_key) for r in grids.candidate_cells(two, None, 0.1, "name").collect()}
    expected = {("lake", a, o) for a in range(95, 146) for o in range(95, 146) if inside(SHAPES[0][2], o * 0.1 + 1e-9, a * 0.1 - 1e-9)}
    on_border = {c for c in got ^ expected if c[0] == "lake" and {c[1], c[2]} & {100, 110, 116, 124, 130, 140}}
    assert {c for c in got if c[0] == "lake"} - on_border == expected - on_border
    line = {c for c in got if c[0] == "date line"}
    assert any(o > 1790 for _, _, o in line) and any(o < -1790 for _, _, o in line) and len(line) > 300


def test_no_polygons_no_places(spark, shapes):
    table = spark.createDataFrame([(12.0, 12.0)], SPOT)
    assert spatial.positions_in_polygons(table, shapes.filter("false"), ["name"]).count() == 0
    assert spatial.positions_in_polygons(table.filter("false"), shapes, ["name"]).count() == 0
    assert polygons.area_kha(shapes.filter("false"), ["name"]).count() == 0
