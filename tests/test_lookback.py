"""The block store of lookbacks against whole histories."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import series

FIRST = date(2019, 11, 3)


def whole_history(points, first, last):
    """Daily values between the source's first and last day: linear in gaps, the two nearest points extrapolated."""
    known = sorted(points.items())
    out = []
    for i in range((last - first).days + 1):
        d = first + timedelta(i)
        if d in points:
            out.append(points[d])
            continue
        if len(known) < 2:
            out.append(None)
            continue
        before = [p for p in known if p[0] < d]
        after = [p for p in known if p[0] > d]
        (a, x), (b, y) = (before[-1], after[0]) if before and after else known[:2] if after else known[-2:]
        out.append(x + (y - x) * (d - a).days / (b - a).days)
    return out


@pytest.fixture(scope="module")
def sources(spark):
    """Cells without gaps, with short and very long ones, with one day, NaN, and a large level; two variables over unlike periods."""
    draw = random.Random(4)
    days = [FIRST + timedelta(i) for i in range(300)]
    cells = {
        (1, 1): {d: draw.gauss(0, 1) for d in days},
        (1, 2): {d: draw.gauss(5, 2) for d in days if draw.random() < 0.3},
        (2, 1): {days[40]: 1.0, days[41]: 3.0, days[260]: -7.5},
        (2, 2): {days[120]: 4.0},
        (3, 1): {d: 1e6 + draw.random() for d in days[20:280]},
        (3, 2): {d: 7.0 for d in days},
        (3, 3): {d: float("nan") if i == 150 else float(i % 9) for i, d in enumerate(days)},
    }
    other = {(1, 1): {d: draw.gauss(0, 1) for d in days[100:220]}, (9, 9): {days[130]: 1.0, days[140]: 2.0}}
    frame = lambda c: spark.createDataFrame([(a, b, d, v) for (a, b), p in c.items() for d, v in p.items()], "lat_key int, lon_key int, date date, v double")
    rows = [(a, b, FIRST + timedelta(i)) for a, b in [*cells, (9, 9), (8, 8)] for i in (-1, 0, 5, 29, 63, 64, 99, 130, 149, 151, 190, 219, 299, 300)]
    rows += [(1, 1, days[200])] * 3 + [(1, 1, None), (None, 1, days[200])]
    made = spark.createDataFrame(rows, "lat_key int, lon_key int, date date")
    return cells, other, frame(cells), frame(other), made


def same(a, b):
    if a is None or b is None or (isinstance(a, float) and math.isnan(a)) or (isinstance(b, float) and math.isnan(b)):
        return (a is None or math.isnan(a)) == (b is None or math.isnan(b))
    return a == pytest.approx(b, rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("n_days", [30, 150])
def test_days_are_those_of_the_whole_history(sources, n_days):
    cells, _, cube, _, rows = sources
    first, last = min(d for p in cells.values() for d in p), max(d for p in cells.values() for d in p)
    history = {c: whole_history(p, first, last) for c, p in cells.items()}
    got = series.lookback(rows, cube, n_days).collect()
    assert len(got) == rows.count()
    for r in got:
        h = history.get((r.lat_key, r.lon_key))
        end = (r.date - first).days + 1 if r.date else 0
        expected = h[end - n_days : end] if h and n_days <= end <= len(h) else None
        assert (r.series is None) == (expected is None), r
        assert expected is None or all(same(a, b) for a, b in zip(r.series, expected, strict=True)), r


def test_features_are_those_of_the_days(sources):
    _, _, cube, other, rows = sources
    names = [
        f"{v}_{f}" for v in ("v", "w") for f in (
            "lag_1", "lag_70", "lag_71", "mean_1", "mean_7", "mean_70", "mean_71", "std_7", "std_64", "min_1", "min_30", "max_64", "max_70", "median_7", "ewm_7",
            "diff_69", "diff_70", "pct_change_7", "autocorr_1", "autocorr_7", "autocorr_69", "trend_slope_7", "trend_slope_70", "trend_intercept_30", "cumprod", "fft_peak_1",
        )
    ]
    n = 70
    got = series.lookback_features(rows, {"v": cube, "w": other}, n, names)
    old = series.lookback(series.lookback(rows, cube, n, out="a"), other, n, out="b")
    old = series.add_features(old, names, {"v": "a", "w": "b"})
    key = lambda r: (str(r.lat_key), r.lon_key, str(r.date))
    one, two = (sorted(d.select("lat_key", "lon_key", "date", *names).collect(), key=key) for d in (got, old))
    assert len(one) == len(two) == rows.count()
    for a, b in zip(one, two, strict=True):
        assert key(a) == key(b)
        for name in names:
            if (a.lat_key, a.lon_key) == (3, 1) and "pct" in name:
                continue  # differences of a large level
            assert same(a[name], b[name]), (key(a), name, a[name], b[name])
    assert sum(r.w_mean_7 is not None for r in one) > 3


def test_tensor_has_a_row_per_variable(sources):
    _, _, cube, other, rows = sources
    out = series.channel_tensor(rows, {"a": cube, "b": other}, 30).filter("lat_key = 1 and lon_key = 1").select("date", F.size("tensor").alias("n"), "tensor").collect()
    assert len(out) == 18 and all(r.n == 2 for r in out)
    assert any(r.tensor[0] and r.tensor[1] and len(r.tensor[1]) == 30 for r in out)


def test_no_rows_no_cube(sources):
    _, _, cube, _, rows = sources
    assert series.lookback(rows.filter("false"), cube, 30).count() == 0
    empty = series.lookback_features(rows, {"v": cube.filter("false")}, 30, ["v_mean_7"])
    assert empty.filter("v_mean_7 is not null").count() == 0 and empty.count() == rows.count()
