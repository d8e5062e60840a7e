"""Draws without repetition and the exact sizes of strata."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import draws, grids, sampling

START, END = "2020-01-01", "2020-02-29"
LAND = "country string, lat_key bigint, lon_key bigint, ecoregion_name string, burnable boolean, landcover_key string, large_city_hard boolean"


@pytest.fixture(scope="module")
def cells(spark):
    made = [("A", i % 9, i // 9, f"e{i % 2}", i % 3 == 0, f"l{i % 2}", i % 20 == 0) for i in range(81)]
    made += [("B", 50 + i, 50, "e0", True, "l0", False) for i in range(4)]
    return spark.createDataFrame(made, LAND)


@pytest.fixture(scope="module")
def fires(spark):
    rows = [("A", 4, 4, date(2020, 1, 10)), ("A", 0, 8, date(2020, 2, 2)), ("B", 51, 50, date(2020, 1, 31)), ("A", 4, 4, date(2020, 1, 11))]
    # the last one's ecoregion has no cells, so it draws from its country's
    land = [("e0", True, "l0"), ("e0", False, "l1"), ("e0", True, "l0"), ("nowhere", None, None)]
    return spark.createDataFrame([(*r, *x) for r, x in zip(rows, land, strict=True)], "country string, lat_key bigint, lon_key bigint, date date, ecoregion_name string, burnable boolean, landcover_key string")


@pytest.mark.parametrize("size", [1, 2, 3, 6, 7, 100, 1680, 9973])
def test_every_number_has_its_own_place(spark, size):
    n, key = F.lit(size).cast("bigint"), F.lit(4_000_000_000 + size).cast("bigint")
    rows = draws.with_place(spark.range(size).withColumn("_p", draws.permuted("id", n, key)), "id", n, key).collect()
    assert sorted(r._v for r in rows) == list(range(size)) and all(r._v == r._p for r in rows)
    assert size < 100 or sum(r.id == r._v for r in rows) < size / 5


def test_numbers_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 7)
    groups = spark.createDataFrame([("a", 0, 30), ("b", 5, 5), ("c", 2, 3)], "g string, lo bigint, hi bigint")
    found = sorted((r.g, r._i) for r in draws.numbers(groups, F.col("lo"), F.col("hi")).collect())
    assert found == [("a", i) for i in range(30)] + [("c", 2)]


def universe(cells, fires):
    """Free cell-days of every stratum, by brute force."""
    land = {(c.country, c.lat_key, c.lon_key): c for c in cells.collect()}
    pos = fires.collect()
    first, last = date.fromisoformat(START), date.fromisoformat(END)
    days = [first + timedelta(i) for i in range((last - first).days + 1)]
    shut = {(p.country, p.lat_key + a, p.lon_key + b, p.date + timedelta(d)) for p in pos for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)}
    near = {
        (p.country, p.lat_key + a, p.lon_key + b, p.date + timedelta(d))
        for p in pos for a in range(-5, 6) for b in range(-5, 6) for d in range(-7, 8) if max(abs(a), abs(b)) >= 2
    }
    found = {"near_fire_hard": {k for k in near if k[:3] in land and first <= k[3] <= last}}
    found["large_city_hard"] = {(*c, d) for c, x in land.items() if x.large_city_hard for d in days}
    found["random_background"] = {(*c, d) for c in land for d in days}
    for stratum, names in (("same_season", ["country"]), ("same_ecoregion", ["country", "ecoregion_name"]), ("same_burnable_landcover", ["country", "burnable", "landcover_key"])):
        own = set()
        for p in pos:
            pool = [c for c, x in land.items() if all(x[n] == p[n] for n in names)] or [c for c, x in land.items() if x.country == p.country]
            own |= {(*c, d) for c in pool for d in days if d.month == p.date.month}
        found[stratum] = own
    return {s: found[s] - shut for s in sampling.STRATA}


@pytest.mark.parametrize("fraction", [0.9, 0.01])
def test_strata_hold_their_quota_or_all_there_is(spark, cells, fires, fraction):
    free = universe(cells, fires)
    quotas = {r.stratum: r.quota for r in sampling.stratum_quotas(fires, fraction).collect()}
    rows = sampling.stratified_negatives(fires, cells, START, END, positive_fraction=fraction).collect()
    own = {s: {tuple(r[c] for c in sampling.CELL_DAY) for r in rows if r.stratum == s} for s in sampling.STRATA}
    assert sum(map(len, own.values())) == len(rows)
    used = set()
    for s in sampling.STRATA:
        left = free[s] - used
        want = sum(quotas.values()) - len(used) if s == "random_background" else quotas[s]
        assert own[s] <= left and len(own[s]) == min(want, len(left)), s
        used |= own[s]
    assert all(r.sampling_probability > 0 and r.sample_weight == pytest.approx(1 / r.sampling_probability) for r in rows)


@pytest.mark.parametrize("stratum", ["same_ecoregion"])
def test_one_stratum_to_its_end(spark, cells, fires, stratum):
    free = universe(cells, fires)[stratum]
    blocked = sampling.cut(grids.blocked_keys(fires))
    for want in (7, len(free) + 100):
        rows = sampling.stratum_negatives(stratum, want, fires, cells, START, END, blocked).collect()
        got = {tuple(r[c] for c in sampling.CELL_DAY) for r in rows}
        assert got <= free and len(got) == len(rows) == min(want, len(free))


def test_every_city_cell_has_its_turn(spark, cells, fires):
    city = {(c.country, c.lat_key, c.lon_key) for c in cells.filter("large_city_hard").collect()}
    rows = sampling.stratum_negatives("large_city_hard", len(city) + 1, fires, cells, START, END).collect()
    assert {tuple(r)[:3] for r in rows} == city


def test_no_positives_no_negatives(spark, cells, fires):
    assert sampling.stratified_negatives(fires.filter("false"), cells, START, END).count() == 0
