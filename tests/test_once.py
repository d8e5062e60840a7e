"""Steps that grow with the input: scores computed once, no group sorted in one task."""

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import calibrate, detections, evaluation, ranking, sampling
from cindergrid.session import cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("is_fire"),
        (F.col("id") * 37 % 97 / 100.0 + 0.01).alias("prob"), (F.col("id") % 7 + 1.0).alias("eval_weight"),
        F.concat(F.lit("m"), F.col("id") % 2).alias("model_name"), (500 + F.col("id") % 9).alias("lat_key"),
        (1000 + F.col("id") % 11).alias("lon_key"), F.date_add(F.lit("1998-11-01").cast("date"), (F.col("id") % 90).cast("int")).alias("date"),
        (F.col("id") % 12).alias("month"),
    )


def test_filter_of_metric_rows_names_the_score_once(spark):
    df = _rows(spark).withColumn("prob", F.sin("prob"))
    assert _plan(ranking.metric_rows(df)).count("SIN(") <= 2


def test_index_ranking_reads_its_rows_twice(spark, tmp_path):
    _rows(spark).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows")).withColumn("ix", F.col("prob") * 40 - 5)
    out = evaluation.index_ranking(df, "ix")
    # the index span only; the ranking reads collapsed scores
    reads = [line for line in _plan(out).splitlines() if "FileScan" in line and "lat_key" not in line and "/rows]" in line]
    assert len({line.split("[", 1)[1].split("]")[0] for line in reads}) <= 1
    assert out.count() == 2


def test_score_table_is_the_two_metric_tables(spark):
    df, g = _rows(spark), ["model_name"]
    want = ranking.weighted_scores(df, group=g).join(ranking.ranking_metrics(df, group=g), g)
    got = {r.model_name: r for r in ranking.score_table(df, group=g).collect()}
    for row in want.collect():
        for c in want.columns[1:]:
            assert got[row.model_name][c] == pytest.approx(row[c], rel=1e-12)


def test_flags_of_all_label_sets_are_those_of_relabel(spark):
    df = _rows(spark).withColumn("country", F.lit("C0"))
    sets = {"a": df.filter("is_fire = 1"), "b": df.filter("is_fire = 1 and eval_weight > 4"), "none": df.filter("false")}
    got = {r.row_id: r for r in detections.label_flags(df, sets).collect()}
    assert len(got) == 400
    for name, keys in sets.items():
        assert all(got[r.row_id][name] == r.is_fire for r in detections.relabel(df, keys).collect())


def test_rows_of_a_group_are_not_sorted_for_its_coefficients(spark):
    df = _rows(spark)
    offsets = calibrate.fit_offsets(df, ["month"], score="prob")
    assert "SortMergeJoin" not in _plan(calibrate.apply_offsets(df, offsets, ["month"], score="prob"))


def test_score_equations_do_not_sort_a_model(spark):
    from cindergrid.catalog import metrics, views

    # as with tables too large to broadcast
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(metrics.m8_equations(views.Tables(spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan


def test_draws_need_no_join_and_one_hash(spark):
    plan = _plan(sampling.bootstrap_weights(_rows(spark), "row_id", 3))
    assert "Join" not in plan and plan.count("xxhash64(") <= 2
    sized = _plan(sampling.bootstrap_weights(_rows(spark), "row_id", 3, sample_size=100))
    assert "SortMergeJoin" not in sized


def test_errors_of_spread_rows_are_those_of_copies(spark):
    df, g = cut(_rows(spark)).withColumn("_sets", F.when(F.col("lat_key") < 504, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))), ["model_name", "region"]

    def spread(rows):
        return rows.withColumn("region", F.explode("_sets"))

    def run(rows, **more):
        metric = lambda r, k: ranking.ranking_metrics(r, group=k)
        return {(r.model_name, r.region): r for r in sampling.bootstrap_error(rows, "row_id", metric, 4, group=g, **more).collect()}

    copies, drawn = run(spread(df)), run(df, parts=["model_name", "_sets"], spread=spread)
    assert len(drawn) == 4 and set(copies) == set(drawn)
    for k, row in copies.items():
        assert drawn[k].average_precision_error == pytest.approx(row.average_precision_error, rel=1e-9)
        assert drawn[k].roc_auc_error == pytest.approx(row.roc_auc_error, rel=1e-9)
    # with a sample size the rate depends on the group
    a, b = run(spread(df), sample_size=100), run(df, sample_size=100, parts=["model_name", "_sets"], spread=spread)
    assert all(b[k].roc_auc_error == pytest.approx(a[k].roc_auc_error, rel=1e-9) for k in a)
