"""Small fixtures with known answers, one per pinned behaviour."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cindergrid.functions import calendar, labels, probability
from cindergrid.operators import (
    calibrate, detections, grids, ranking, raster, sampling, series, spatial, summaries,
)
from cindergrid.sources import detections as scan
from cindergrid.sources import tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_stationary_catalogue_and_removal(spark):
    days = ["2020-01-03", "2020-02-09", "2020-02-20", "2020-04-01"]
    data = [("A", 50.1, 10.2, date.fromisoformat(d)) for d in days] + [
        ("A", 51.0, 11.0, date(2020, 1, 1))
    ]
    df = spark.createDataFrame(data, "country string, latitude double, longitude double, acq_date date")
    cat = detections.stationary_catalogue(df, 3)
    assert rows(cat.select("unique_months", "first_month", "last_month", "months")) == [
        (3, "2020-01", "2020-04", "2020-01;2020-02;2020-04")
    ]
    assert detections.drop_stationary(df, cat).count() == 1
    assert rows(detections.stationary_removals(df, cat)) == [("A", 5, 4, 1)]


def test_scan_reads_only_wanted_files(spark, tmp_path):
    for year, country in ((2019, "A"), (2020, "A"), (2020, "B"), (2020, "C")):
        folder = tmp_path / "modis" / str(year)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"modis_{year}_{country}.csv").write_text(
            "latitude,longitude,acq_date,brightness,confidence\n"
            f"50.0,10.0,{year}-03-01,330.0,90.0\n50.0,10.0,{year}-09-01,330.0,90.0\n"
        )
    got = scan.scan_detections(
        spark, str(tmp_path), ["A", "B", "Z"], date(2020, 1, 1), date(2020, 6, 30)
    )
    assert rows(got.select("country", "year", F.col("acq_date").cast("string")), "country") == [
        ("A", 2020, "2020-03-01"), ("B", 2020, "2020-03-01")
    ]
    with pytest.raises(ValueError):
        scan.select_detections(got.drop("brightness"))


def test_negative_budget_and_allocation(spark):
    ten = spark.range(10)
    assert ten.transform(lambda d: sampling.stratum_quotas(d, 0.10)).agg(F.sum("quota")).first()[0] == 90
    three = sampling.stratum_quotas(spark.range(3), 0.25)
    assert three.agg(F.max("target"), F.sum("quota")).first() == (9, 9)


def _history(spark):
    d = date(2020, 3, 1)
    ev = [("A", 500, 100, d - timedelta(10), 1), ("A", 501, 100, d - timedelta(5), 1),
          ("A", 500, 100, d - timedelta(40), 1)]
    target = [("r1", "A", 500, 100, d), ("r2", "A", 500, 100, d - timedelta(100))]
    events = spark.createDataFrame(ev, "country string, lat_key long, lon_key long, date date, count int")
    rows_ = spark.createDataFrame(target, "id string, country string, lat_key long, lon_key long, date date")
    return rows_, events


def test_event_history_windows_include_both_ends(spark):
    r, ev = _history(spark)
    out = series.event_history(r, ev, [0, 1], {"10_10d": (10, 10), "1_40d": (1, 40)}, [0], 30, 365)
    got = {x["id"]: x for x in out.collect()}
    assert got["r1"]["past_event_count_r0_10_10d"] == 1
    assert got["r1"]["past_event_count_r0_1_40d"] == 2
    assert got["r1"]["past_event_count_r1_1_40d"] == 3
    assert got["r1"]["days_since_event_r0"] == 40
    assert got["r2"]["past_event_count_r1_1_40d"] == 0
    assert got["r2"]["days_since_event_r0"] == 366


def test_soft_label_values(spark):
    df = spark.createDataFrame(
        [(1, None, None), (0, 1.0, 0.0), (0, 9.0, 0.0)],
        "count int, nearest_positive_distance_cells double, nearest_positive_delta_days double",
    )
    assert [round(v, 6) for (v,) in rows(df.select(labels.soft_label()))] == [1.0, 0.35, 0.0]


def test_calendar_flags(spark):
    df = spark.createDataFrame(
        [(date(2021, 1, 2), "Russian-Federation"), (date(2021, 1, 4), "Kazakhstan"), (date(2021, 12, 26), "X")],
        "date date, country string",
    )
    got = rows(calendar.add_calendar_features(df), "date")
    assert [tuple(g[2:]) for g in got] == [
        (1, 0, 1, 1, 1, 1), (0, 1, 1, 0, 0, 0), (1, 1, 1, 0, 1, 1)
    ]


def test_metrics_of_three_rows(spark):
    df = spark.createDataFrame([(1, 0.8, 1.0), (0, 0.1, 3.0), (1, 0.4, 2.0)], "is_fire int, prob double, eval_weight double")
    one = summaries.count_calibration(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert one["observed"] == pytest.approx(3.0) and one["expected"] == pytest.approx(1.9)
    assert ranking.best_f1(ranking.ranked_scores(df)).first()["f1"] == pytest.approx(1.0)
    bins = ranking.reliability_bins(
        spark.createDataFrame([(i, 1 if i < 4 else 0, 0.8 if i < 4 else 0.2, 1.0) for i in range(8)],
                              "k int, is_fire int, prob double, eval_weight double"),
        4, "equal_count", "k",
    )
    assert [r[0] for r in rows(bins.select("n_unweighted"))] == [2, 2, 2, 2]
    s = ranking.reliability_summary(bins).first()
    assert [round(v, 9) for v in s] == [0.2, 0.2, 0.2]


def test_one_class_metrics_are_null(spark):
    df = spark.createDataFrame([(0, 0.2, 1.0), (0, 0.4, 1.0)], "is_fire int, prob double, eval_weight double")
    assert ranking.ranking_metrics(df).first() == (None, None)
    assert ranking.best_f1(ranking.ranked_scores(df)).first()["threshold"] == 0.5


def test_prefix_sums_over_many_buckets_and_a_hot_score(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 7)
    # a third of all rows share one score and one group
    data = [(i, "g" if i % 3 else "h", 0.5 if i % 3 == 1 else (i * 37 % 997) / 1000.0, i % 2, 1.0 + i % 5)
            for i in range(3000)]
    df = spark.createDataFrame(data, "k int, grp string, prob double, is_fire int, eval_weight double")
    got = {r["grp"]: r for r in ranking.ranking_metrics(df, group=["grp"]).collect()}
    for grp in "gh":
        part = [d for d in data if d[1] == grp]
        by = {}
        for _, _, p, y, w in part:
            a = by.setdefault(max(p, 1e-12), [0.0, 0.0])
            a[1 - y] += w
        tp = fp = ap = auc = 0.0
        total_p, total_n = (sum(v[i] for v in by.values()) for i in (0, 1))
        for p in sorted(by, reverse=True):
            pos, neg = by[p]
            auc += neg * (tp + pos / 2)
            tp, fp = tp + pos, fp + neg
            ap += pos * tp / (tp + fp)
        assert got[grp]["average_precision"] == pytest.approx(ap / total_p)
        assert got[grp]["roc_auc"] == pytest.approx(auc / (total_p * total_n))
    q = ranking.exact_quantiles(df, "prob", {"q": 0.9}, ["grp"]).collect()
    for r in q:
        v = sorted(d[2] for d in data if d[1] == r["grp"])
        h = 0.9 * (len(v) - 1)
        lo = int(h)
        assert r["q"] == pytest.approx(v[lo] + (v[lo + 1] - v[lo]) * (h - lo))
    pos = ranking.row_positions(df.select("k", "grp", "prob"), "prob", F.col("k"), ["grp"])
    for grp in "gh":
        got_pos = sorted(r["_pos"] for r in pos.filter(F.col("grp") == grp).collect())
        assert got_pos == list(range(len([d for d in data if d[1] == grp])))


def test_weighted_sample_stands_for_the_universe(spark):
    df = spark.createDataFrame([(i, "A", int(i < 2)) for i in range(15)], "id int, c string, is_fire int")
    plain = sampling.weighted_sample(df, 0.4, ["c"], ["id"], keep_positives=False)
    assert plain.count() == 6 and {r["eval_weight"] for r in plain.collect()} == {2.5}
    kept = sampling.weighted_sample(df, 0.4, ["c"], ["id"])
    assert kept.agg(F.sum("eval_weight")).first()[0] == pytest.approx(15)
    assert {r["eval_weight"] for r in kept.filter("is_fire = 1").collect()} == {1.0}


def test_day_sample_weights(spark):
    days = [(date(2021, 1, 1) + timedelta(i), 1.0) for i in range(59)]
    out = sampling.sample_days(spark.createDataFrame(days, "date date, eval_weight double"), 2)
    assert rows(out.groupBy(F.month("date").alias("m")).agg(F.max("eval_weight"), F.count("*")), "m") == [
        (1, 15.5, 2), (2, 14.0, 2)
    ]


def test_bilinear_centre(spark):
    grid = spark.createDataFrame([(0, 0, 0.5), (0, 1, 1.5), (1, 0, 2.5), (1, 1, 3.5)], "r long, c long, v double")
    pts = spark.createDataFrame([(0.5, 0.5)], "longitude double, latitude double")
    assert spatial.bilinear_sample(pts, grid, 0.0, 1.0, 0.0, 1.0).first()["v"] == pytest.approx(2.0)
    up = {(r["r"], r["c"]): r["v"] for r in raster.upsample(grid, 2).collect()}
    assert up[(1, 1)] == pytest.approx(2.0) and len(up) == 9


def test_offsets_balance_counts_and_fall_back(spark):
    data = [(1, 0.9, 1, 2.0), (1, 0.2, 0, 5.0), (2, 0.7, 1, 1.0), (2, 0.1, 0, 9.0), (3, 0.5, 0, 4.0)]
    df = spark.createDataFrame(data, "month int, prob_raw double, is_fire int, eval_weight double")
    off = calibrate.fit_offsets(df, ["month"])
    out = calibrate.apply_offsets(df, off, ["month"])
    for m in (1, 2):
        r = out.filter(F.col("month") == m).agg(
            F.sum(F.col("prob_calibrated") * F.col("eval_weight")), F.sum(F.col("is_fire") * F.col("eval_weight"))
        ).first()
        assert r[0] == pytest.approx(r[1], rel=1e-5)
    assert out.filter("month = 3").first()["prob_calibrated"] < 1e-9
    unseen = calibrate.apply_offsets(df.withColumn("month", F.lit(9)), off, ["month"])
    whole = unseen.agg(F.sum(F.col("prob_calibrated") * F.col("eval_weight"))).first()[0]
    assert whole == pytest.approx(3.0, rel=1e-5)


def test_platt_constant_and_unseen_level(spark):
    one = spark.createDataFrame([(0.3, 0, 1.0), (0.6, 0, 1.0)], "prob_raw double, is_fire int, eval_weight double")
    assert calibrate.PlattCalibrator().fit(one).apply(one).first()["prob_calibrated"] == 0.0


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(tables.upsert(old, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    want = spark.createDataFrame([(1,), (9,)], "k int")
    served, grown = tables.resolve_cache(want, old, ["k"], lambda m: m.withColumn("v", F.lit("new")))
    assert rows(served, "k") == [(1, "a"), (9, "new")] and grown.count() == 3
    check = tables.is_multiset_subset(old.union(old), old, ["k"]).first()
    assert check["excess_rows"] == 2 and not check["valid"]


def test_prior_shift_keeps_equal_priors(spark):
    df = spark.createDataFrame([(0.3,)], "p double")
    assert df.select(probability.prior_shift("p", 0.2, 0.2)).first()[0] == pytest.approx(0.3)


def test_align_rows_rejects_missing_and_repeated_keys(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        grids.align_rows(base, base.select("k").distinct(), ["k"]).collect()
    with pytest.raises(Exception, match="missing"):
        grids.align_rows(base.limit(1), spark.createDataFrame([(5,)], "k int"), ["k"]).collect()


def test_distance_without_source_is_null(spark):
    grid = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "r long, c long, src int")
    assert {r["distance"] for r in raster.distance_to_source(grid).collect()} == {None}


def test_series_engines_agree(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(values,)], "series array<double>")
    names = ["v_mean_4", "v_std_4", "v_median_4", "v_autocorr_2", "v_fft_peak_1", "v_cumprod", "v_mean_99"]
    got = series.add_features(df, names, {"v": "series"}).first()
    import numpy as np

    x = np.array(values)
    assert got["v_mean_4"] == pytest.approx(x[-4:].mean())
    assert got["v_std_4"] == pytest.approx(x[-4:].std())
    assert got["v_median_4"] == pytest.approx(np.median(x[-4:]))
    assert got["v_autocorr_2"] == pytest.approx(np.corrcoef(x[:-2], x[2:])[0, 1])
    assert got["v_fft_peak_1"] == pytest.approx(np.sort(np.abs(np.fft.rfft(x))[1:])[-1])
    assert got["v_cumprod"] == pytest.approx(x.prod())
    assert got["v_mean_99"] is None


def test_calibration_line_solves_the_score_equations(spark):
    data = [(i % 2, 1 / (1 + 2.718281828 ** (-(i % 19 - 9) * 0.9)), 1.0 + i % 3) for i in range(400)]
    df = spark.createDataFrame(data, "is_fire int, prob double, eval_weight double")
    a, b = ranking.calibration_line(df).select("calibration_intercept", "calibration_slope").first()
    r = df.withColumn("x", probability.logit("prob")).withColumn(
        "r", F.col("eval_weight") * (F.col("is_fire") - probability.sigmoid(F.lit(a) + F.lit(b) * F.col("x")))
    ).agg(F.sum("r"), F.sum(F.col("r") * F.col("x"))).first()
    assert r[0] == pytest.approx(0, abs=1e-6) and r[1] == pytest.approx(0, abs=1e-6)
