"""Draws looked up from listed cell-days are those of the rounds."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import draws, grids, sampling

START, END = "2020-01-20", "2020-03-10"
LAND = "country string, lat_key bigint, lon_key bigint, ecoregion_name string, burnable boolean, landcover_key string, large_city_hard boolean"


@pytest.fixture(scope="module")
def cells(spark):
    made = [("A", i % 6, i // 6, f"e{i % 2}", i % 3 == 0, f"l{i % 2}", i % 10 == 0) for i in range(36)]
    made += [("B", 50 + i, 50, "e0", True, "l0", False) for i in range(4)] + [(None, 9, 9, "e0", True, "l0", True)]
    return spark.createDataFrame(made, LAND)


@pytest.fixture(scope="module")
def fires(spark):
    rows = [("A", 4, 4, date(2020, 1, 22), "e0", True, "l0"), ("A", 0, 5, date(2020, 2, 29), "e0", False, "l1"),
            ("B", 51, 50, date(2020, 1, 31), "e0", True, "l0"), ("A", 4, 4, date(2020, 3, 10), "nowhere", None, None)]
    return spark.createDataFrame(rows, "country string, lat_key bigint, lon_key bigint, date date, ecoregion_name string, burnable boolean, landcover_key string")


@pytest.mark.parametrize("size", [1, 7, 50, 1680])
def test_every_place_knows_its_number(spark, size):
    n, key = F.lit(size).cast("bigint"), F.lit(4_000_000_000 + size).cast("bigint")
    placed = draws.with_place(spark.range(size), "id", n, key)
    assert all(r._i == r.id for r in draws.with_number(placed, "_v", n, key).collect())


def same(left, right):
    rows = [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (left, right)]
    assert rows[0] == rows[1] and rows[0]


def test_listed_cell_days_have_the_rounds_of_their_draws(spark, cells, fires):
    blocked = sampling.cut(grids.blocked_keys(fires))
    free = sampling.cut(sampling.free_cell_days(cells, START, END, blocked))
    rest = lambda df: df.join(blocked, list(sampling.CELL_DAY), "left_anti")
    same(rest(sampling.near_event_candidates(fires, cells, START, END, 0, 1680)), sampling.near_event_rounds(fires, free))
    same(rest(sampling.city_candidates(cells, START, END, 0, 100)), sampling.city_rounds(cells, free, START, END))
    for stratum in ("same_ecoregion", "random_background"):
        groups, pools = sampling.matched_groups(fires, cells, START, END, stratum)
        drawn = sampling.matched_candidates(groups, pools, START, END, stratum, 0, 10_000)
        same(rest(drawn), sampling.matched_rounds(groups, pools, free, START, END, stratum))


def test_a_short_stratum_opens_no_rounds(spark, cells, fires, monkeypatch):
    def rounds(*args):
        raise AssertionError("rounds were opened")

    monkeypatch.setattr(sampling, "drawn", rounds)
    rows = sampling.stratified_negatives(fires, cells, START, END, positive_fraction=0.001).collect()
    days = sampling.free_cell_days(cells, START, END, grids.blocked_keys(fires))
    assert len(rows) == len({tuple(r[c] for c in sampling.CELL_DAY) for r in rows}) == days.count()


def test_a_few_rounds_are_tried_before_a_long_look_up(spark, cells, fires, monkeypatch):
    run = lambda: sampling.stratum_negatives("near_fire_hard", 3, fires, cells, START, END, free=free)
    free = sampling.cut(sampling.free_cell_days(cells, START, END))
    looked_up = run()
    monkeypatch.setattr(sampling, "LOOKED_UP", 0)
    same(looked_up, run())
