"""Missing values, sample sizes and edges of the globe."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cindergrid.functions import probability
from cindergrid.operators import calibrate, columns, ranking, sampling, series, spatial, summaries
from cindergrid.sources import cubes

NAN = float("nan")


def test_missing_scores_and_weights_take_no_part(spark):
    rows = [(1, 0.9, 1.0), (0, 0.2, 1.0), (1, None, 1.0), (0, NAN, 1.0), (1, 0.7, None), (0, 0.7, NAN), (None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "is_fire int, prob double, eval_weight double")
    scores = ranking.weighted_scores(df).first()
    assert scores.support == 2 and scores.mean_probability == pytest.approx(0.55)
    assert tuple(ranking.ranking_metrics(df).first()) == (1.0, 1.0)
    assert ranking.best_f1(ranking.ranked_scores(df)).first().threshold == pytest.approx(0.9)


def test_transforms_of_missing_values_are_missing(spark):
    df = spark.createDataFrame([(None,), (NAN,), (2.0,), (-1.0,)], "x double")
    made = df.select(
        probability.clip_probability("x").alias("clip"), probability.logit("x").alias("logit"), columns.clip_unit(F.col("x")).alias("unit"),
        probability.intensity_to_probability("x").alias("rate"), probability.prior_shift("x", 0.1, 0.01).alias("shift"),
        spatial.nearest_index("x", 0.0, 1.0, 3).alias("index"),
    ).collect()
    for row in made[:2]:
        assert all(v is None for v in tuple(row)[:6])
    assert made[2].unit == 1.0 and made[3].unit == 0.0 and made[2]["index"] == 2 and made[3].rate == 0.0


def test_first_value_of_a_running_total_stays(spark):
    df = spark.createDataFrame([(i, 1, 1, v) for i, v in enumerate((5.0, 7.0, 6.0))], "date int, lat_key int, lon_key int, v double")
    assert [r.v for r in cubes.deaccumulate(df).orderBy("date").collect()] == [5.0, 2.0, 0.0]


def test_windows_longer_than_the_series_are_missing(spark):
    s = F.array(*[F.lit(float(v)) for v in (1, 2, 3)])
    small = F.array(*[F.lit(v * 1e-6) for v in (1.0, 2.0, 4.0, 3.0, 5.0)])
    flat = F.array(*[F.lit(0.1) for _ in range(6)])
    row = spark.range(1).select(
        series.std(s, 7).alias("long"), series.std(s, 3).alias("fits"), series.autocorr(small, 1).alias("small"), series.autocorr(flat, 1).alias("flat")
    ).first()
    assert row.long is None and row.fits == pytest.approx((2 / 3) ** 0.5)
    assert row.small == pytest.approx(0.1, abs=0.5) and row.small is not None and row.flat is None


def test_coverage_needs_one_fragment_for_both(spark):
    shape = "variable string, year int, days int, lat_min int, lat_max int, lon_min int, lon_max int"
    wide_short, small_full = ("v", 2001, 100, 0, 10, 0, 10), ("v", 2001, 365, 4, 6, 4, 6)
    audit = lambda *rows: cubes.coverage_audit(d := spark.createDataFrame(rows, shape), d, (2001, 2001), (0, 0, 10, 10)).first().reason
    assert audit(wide_short, small_full) == "missing_days"
    assert audit(small_full) == "domain_too_small"
    assert audit(wide_short, ("v", 2001, 365, 0, 10, 0, 10)) == "complete"


def test_near_equal_f1_takes_the_highest_score(spark):
    ranked = spark.createDataFrame(
        [(0.9, 499_999.0, 0.0, 499_999.0, 0.0), (0.8, 2.0, 1.0, 500_001.0, 1.0), (0.1, 499_999.0, 10_000_000.0, 1_000_000.0, 10_000_001.0)],
        "score double, pos double, neg double, cum_pos double, cum_neg double",
    ).withColumns({"tot_pos": F.lit(1_000_000.0), "tot_neg": F.lit(10_000_001.0)})
    assert ranking.best_f1(ranked).first().threshold == 0.8
    assert ranking.best_f1(ranked, close=True).first().threshold == 0.9


def test_ablation_is_full_minus_variant(spark):
    df = spark.createDataFrame([("full", "r", "p", 0.5), ("less", "r", "p", 0.4)], "variant string, region string, period string, ap double")
    found = {r.variant: r.delta_ap_vs_full for r in summaries.ablation_deltas(df, ["ap"]).collect()}
    assert found["full"] == 0 and found["less"] == pytest.approx(0.1)


def test_unseen_level_adds_nothing(spark):
    data = [(m, 0.1 + 0.05 * (i % 12), int((i * 7 + m * 3) % 10 < 2 + 3 * m), None if i % 4 else 1.0) for m in (1, 2) for i in range(60)]
    df = spark.createDataFrame(data, "month int, prob_raw double, is_fire int, eval_weight double")
    model = calibrate.PlattCalibrator(["month"]).fit(df)
    assert len(model.coefficients) == 3
    new = spark.createDataFrame([(9, 0.3), (1, 0.3)], "month int, prob_raw double")
    a, b = (r.prob_calibrated for r in model.apply(new).collect())
    z = model.intercept + model.coefficients[0] * float(spark.range(1).select(probability.logit(F.lit(0.3))).first()[0])
    assert a == pytest.approx(1 / (1 + 2.718281828459045**-z)) and a != pytest.approx(b)
    # rows without a weight count as one
    fitted = model.apply(df).groupBy("month").agg(F.sum(F.col("prob_calibrated") - F.col("is_fire")).alias("gap")).collect()
    assert all(abs(r.gap) < 1e-2 for r in fitted)


def test_counts_across_the_date_line_and_at_the_poles(spark):
    points = [(179.99, 0.0), (-179.99, 0.0), (0.0, 89.99), (50.0, -89.9), (10.0, 10.0)]
    events = [(-179.99, 0.0), (179.98, 0.01), (180.0, 89.99), (-130.0, -89.9), (-179.999, 0.02), (90.0, 85.0)]
    frame = lambda rows: spark.createDataFrame(rows, "longitude double, latitude double")
    found = {(r.longitude, r.latitude): (r.count_5km, r.count_25km) for r in spatial.counts_within(frame(points), frame(events), [5.0, 25.0]).collect()}
    import math

    def away(a, b):
        (x, y), (u, v) = ([math.radians(t) for t in p] for p in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    assert found == {p: tuple(float(sum(away(p, e) <= r for e in events)) for r in (5, 25)) for p in points}
    assert found[179.99, 0.0] == (3.0, 3.0) and found[0.0, 89.99][0] == 1.0


def test_lazy_sample_of_one_cell_countries(spark):
    cells = spark.createDataFrame([(f"C{i}", i, i) for i in range(40)], "country string, lat_key int, lon_key int")
    fires = spark.createDataFrame([("C1", 1, 1, date(2020, 3, 5))], "country string, lat_key int, lon_key int, date date")
    out = sampling.lazy_sample(cells, fires, date(2020, 1, 1), date(2020, 6, 30), 0.01)
    got = out.groupBy("is_fire").agg(F.count("*").alias("n"), F.sum("eval_weight").alias("w")).collect()
    assert {r.is_fire: (r.n, r.w) for r in got} == {0: (240, pytest.approx(40 * 182 - 1)), 1: (1, 1.0)}


def test_stratified_negatives_reach_a_large_quota(spark):
    land = {"ecoregion_name": F.lit("e"), "burnable": F.lit(True), "landcover_key": F.lit("k"), "ecoregion_realm": F.lit("r")}
    cells = spark.range(400).select(
        F.lit("C").alias("country"), (F.col("id") % 20).alias("lat_key"), F.floor(F.col("id") / 20).alias("lon_key"), (F.col("id") % 29 == 0).alias("large_city_hard"),
    ).withColumns(land)
    fires = spark.createDataFrame([("C", 3, 3, date(2020, 3, 5)), ("C", 9, 12, date(2020, 9, 9)), ("C", 15, 4, date(2021, 6, 1))], "country string, lat_key bigint, lon_key bigint, date date").withColumns(land)
    out = sampling.stratified_negatives(fires, cells, date(2020, 1, 1), date(2021, 12, 31), positive_fraction=0.01)
    rows = [tuple(r) for r in out.select(*sampling.CELL_DAY).collect()]
    assert len(rows) == len(set(rows)) == 297


def test_area_negatives_of_a_sliver(spark):
    ring = "array(named_struct('x',0D,'y',0D), named_struct('x',4D,'y',4D), named_struct('x',4.05D,'y',4D), named_struct('x',0.05D,'y',0D), named_struct('x',0D,'y',0D))"
    polygons = spark.sql(f"SELECT 'S' AS n_name, {ring} AS ring")
    fires = spark.createDataFrame([("S", 900, 900, date(2020, 3, 5))], "country string, lat_key bigint, lon_key bigint, date date")
    kha = 0.05 * 4 * (3.141592653589793 * 6371.0 / 180) ** 2 * 0.99939 / 10
    out = sampling.area_negatives(polygons, fires, 71 / kha, date(2020, 1, 1), date(2020, 12, 31))
    assert 69 <= out.count() <= 73


def test_area_negatives_of_a_buffered_polygon(spark):
    ring = "array(named_struct('x',0D,'y',0D), named_struct('x',2D,'y',0D), named_struct('x',2D,'y',2D), named_struct('x',0D,'y',2D), named_struct('x',0D,'y',0D))"
    polygons = spark.sql(f"SELECT 'B' AS n_name, {ring} AS ring")
    # four fifths of the cells, on all days
    fires = spark.range(17 * 21).selectExpr("'B' AS country", "id % 17 AS lat_key", "floor(id / 17) AS lon_key").withColumn(
        "date", F.explode(F.expr("sequence(date'2020-01-01', date'2020-12-31')"))
    )
    kha = 4 * (3.141592653589793 * 6371.0 / 180) ** 2 * 0.99985 / 10
    out = sampling.area_negatives(polygons, fires, 300 / kha, date(2020, 1, 1), date(2020, 12, 31), buffer_cells=0, buffer_days=0)
    rows = out.collect()
    assert 299 <= len(rows) <= 302
    assert all(r.lat_key > 16 for r in rows)
