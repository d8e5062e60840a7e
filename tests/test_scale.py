"""Steps that failed on larger tables."""

import random
from datetime import date, timedelta

import pytest

from cindergrid.operators import periods, raster, sampling
from cindergrid.session import cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fill_from_nearest_broadcasts_nothing(spark):
    rows = [(r, c, float(10 * r + c) if (r + c) % 5 and not (3 <= r <= 9 and 2 <= c <= 8) else None) for r in range(14) for c in range(11)]
    known = [k for k in rows if k[2] is not None]
    near = lambda r, c: min(((r - a) ** 2 + (c - b) ** 2, a, b, v) for a, b, v in known)[3]
    out = raster.fill_from_nearest(cut(spark.createDataFrame(rows, "r int, c int, v double")))
    assert "Broadcast" not in _plan(out)
    assert {(k.r, k.c): k.v for k in out.collect()} == {(r, c): near(r, c) if v is None else v for r, c, v in rows}


def test_fill_from_nearest_without_known_cells(spark):
    none = spark.createDataFrame([(0, 0, None)], "r int, c int, v double")
    assert raster.fill_from_nearest(none).first().v is None


def _ranked(rows):
    """Average precision and ROC-AUC of (label, score, weight), by definition."""
    pos, neg = (sum(w for y, _, w in rows if y == k) for k in (1, 0))
    if not pos or not neg:
        return None, None
    ap = auc = 0.0
    for y, s, w in rows:
        tp, fp = (sum(v for x, q, v in rows if x == k and q >= s) for k in (1, 0))
        if y:
            ap += w * tp / (tp + fp)
        else:
            auc += w * sum(v * (1.0 if q > s else 0.5) for x, q, v in rows if x and q >= s)
    return ap / pos, auc / (pos * neg)


def test_periods_match_their_definition(spark):
    luck, first = random.Random(3), date(2001, 1, 1)
    rows = [
        (first + timedelta(days=luck.randrange(17)), luck.randrange(3), luck.randrange(4), int(luck.random() < 0.2), luck.randrange(9) / 10 + 0.05, float(luck.randrange(1, 5)))
        for _ in range(90)
    ]
    df = spark.createDataFrame(rows, "date date, lat_key int, lon_key int, is_fire int, prob double, eval_weight double")
    boxes = spark.createDataFrame([(0, "A", 0, 1, 0, 3), (1, "B", 1, 2, 0, 2)], "r_regionkey int, r_name string, lat_min int, lat_max int, lon_min int, lon_max int")
    got = {(r.region, r.period_start): r for r in periods.period_metrics(df, boxes, 3, 0.105).collect()}
    inside = {"A": lambda a, o: a <= 1, "B": lambda a, o: a >= 1 and o <= 2, "global": lambda a, o: True}
    last, wanted = max(r[0] for r in rows), 0
    for region, held in inside.items():
        own = [r for r in rows if held(r[1], r[2])]
        start = min(r[0] for r in own)
        while start <= min(max(r[0] for r in own), last - timedelta(days=2)):
            win = [r for r in own if start <= r[0] <= start + timedelta(days=2)]
            if win:
                wanted += 1
                fires = {(r[1], r[2]) for r in win if r[3]}
                near = lambda r: int(any((r[1] - a) ** 2 + (r[2] - o) ** 2 <= 1 for a, o in fires))  # noqa: B023, E731
                soft = [(near(r), r[4], r[5]) for r in win]
                found = got[region, start]
                assert found.support == len(win) and found.observed_positive_locations == len(fires)
                assert found.tolerant_positive_rows == sum(s[0] for s in soft)
                brier = sum(w * (p - y) ** 2 for y, p, w in soft) / sum(w for _, _, w in soft)
                for value, want in zip(
                    (found.average_precision, found.roc_auc, found.tolerant_average_precision, found.tolerant_roc_auc, found.tolerant_brier_score),
                    (*_ranked([(r[3], r[4], r[5]) for r in win]), *_ranked(soft), brier), strict=True,
                ):
                    assert value == (None if want is None else pytest.approx(want))
            start += timedelta(days=1)
    assert wanted == len(got)


def test_windows_are_ranked_where_their_days_lie(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(periods, "cut", lambda df: plans.append(_plan(df)) or df)
    df = spark.createDataFrame([(date(2001, 1, 1), 0, 0, 1, 0.5, 1.0)], "date date, lat_key int, lon_key int, is_fire int, prob double, eval_weight double")
    boxes = spark.createDataFrame([(0, "A", 0, 1, 0, 3)], "r_regionkey int, r_name string, lat_min int, lat_max int, lon_min int, lon_max int")
    periods.period_metrics(df, boxes, 7, full_periods=False, rankings=("exact",))
    # no exchange has the scores of windows among its keys
    assert "_block" in plans[-1]
    assert not [line for line in plans[-1].splitlines() if "Exchange hashpartitioning" in line and "score" in line]


def test_total_leaves_out_positions_without_statistics(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    # the second line of order 4 lies beyond every training series
    lines = [(1, 1, 1, 1, 10.0), (2, 1, 1, 1, 20.0), (4, 1, 1, 1, 30.0), (4, 2, 1, 2, 40.0)]
    shape = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(lines, shape).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, entry.queries()["h5_channel_scaler"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["h5_channel_scaler"]).fetchall())


def test_only_positives_near_undrawn_cell_days_go_on(spark):
    shape = "country string, lat_key int, lon_key int, date date"
    day = date(2001, 1, 10)
    cells = spark.createDataFrame([("A", 0, 0), ("A", 0, 30)], "country string, lat_key int, lon_key int")
    positives = spark.createDataFrame([("A", 0, 2, day), ("A", 0, 28, day), ("B", 0, 28, day), ("A", 0, 36, day)], shape)
    found = spark.createDataFrame([("A", 0, 0, day + timedelta(days=k)) for k in range(-7, 8)], shape)
    left = sampling.near_undrawn(positives, cells, "2001-01-01", "2001-01-31", found)
    assert [tuple(r) for r in left.collect()] == [("A", 0, 28, day)]
