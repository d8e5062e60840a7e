"""Feature groups are moved in one exchange, and a trial leaves nothing on disk."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import evaluation, ranking, sampling
from cindergrid.session import shared_folder


def _rows(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("is_fire"), (F.col("id") % 7 + 1.0).alias("eval_weight"),
        (F.col("id") * 37 % 97 / 100.0 + 0.01).alias("hint"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("load"),
    )


def _places(df, seed):
    """Row and the row whose values it gets, by definition: the same place in two orders."""
    hashed = lambda side: [r.row_id for r in df.orderBy(sampling.hash_of(f"{seed}:{side}", "row_id")).collect()]
    return dict(zip(hashed("a"), hashed("b"), strict=True))


@pytest.mark.parametrize("n", [1, 40, 3000])
@pytest.mark.parametrize("positions", [7, 200, 10_000])
def test_values_move_between_the_places_of_two_orders(spark, monkeypatch, n, positions):
    monkeypatch.setattr(evaluation, "POSITIONS", positions)
    df = _rows(spark, n)
    source, own = _places(df, "s"), {r.row_id: r for r in df.collect()}
    want = Counter((r.is_fire, r.eval_weight, own[source[k]].hint, own[source[k]].load) for k, r in own.items())
    got = evaluation.permuted(df, ["hint", "load"], "row_id", "s")
    assert got.columns == ["is_fire", "eval_weight", "hint", "load"]
    assert Counter(map(tuple, got.collect())) == want


def test_no_rows_move_to_no_rows(spark):
    assert evaluation.permuted(_rows(spark, 9).filter("false"), ["hint"], "row_id", "s").count() == 0


def test_rows_of_one_key_move_alike_whatever_their_order(spark):
    df = _rows(spark, 60).withColumn("row_id", F.concat(F.lit("k"), F.col("hint").cast("int")))
    runs = [Counter(map(tuple, evaluation.permuted(df.orderBy(o), ["load"], "row_id", "s").collect())) for o in ("load", F.desc("hint"))]
    assert runs[0] == runs[1] and sum(runs[0].values()) == 60


def test_rows_go_through_one_exchange(spark):
    df, seed = _rows(spark, 500), "s"
    slices = evaluation.permutation_slices(df, "row_id", [seed])
    plan = evaluation.permuted(df, ["hint"], "row_id", seed, slices)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_trials_leave_no_shuffle_and_no_stage(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files, stages = lambda: disk.getAllFiles().size(), lambda: set(os.listdir(shared_folder(spark)))
    df, score = _rows(spark, 400), lambda rows: rows.withColumn("prob", F.col("hint") / 2 + F.col("is_fire") * 0.3)
    before = files(), stages()
    table = evaluation.permutation_importance(df, score, {"hint": ["hint"], "load": ["load"]}, "row_id", trials=2)
    for _ in range(50):
        if files() <= before[0]:
            break
        time.sleep(0.1)
    assert files() <= before[0] and stages() <= before[1]
    got = {r.feature_group: r for r in table.collect()}
    base = ranking.ranking_metrics(score(df)).first().average_precision
    drops = [base - ranking.ranking_metrics(score(evaluation.permuted(df, ["hint"], "row_id", f"42:hint:{i}"))).first().average_precision for i in range(2)]
    assert got["hint"].mean_drop == pytest.approx(sum(drops) / 2, abs=1e-12) and got["hint"].trials == 2
    assert got["load"].mean_drop == 0 and got["load"].std_drop == 0
