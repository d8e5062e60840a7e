"""Metric tables over models, regions, periods and spatial scales."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.functions.labels import finite
from cindergrid.functions.probability import clip, logit, ratio
from cindergrid.operators import ranking, sampling, spatial, summaries
from cindergrid.operators.columns import minmax_scores
from cindergrid.operators.regions import region_names, region_rows
from cindergrid.session import cut, discard, shuffles_dropped

POSITIONS = 200_000  # of a permutation, in one block of rows and values, up to 512 blocks


def _join(tables, keys) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys))
    return out


def yearly_summary(df, threshold, key, group=("split", "year"), y="is_fire", p="prob") -> DataFrame:
    """Unweighted metrics, score quantiles and difficulty indices per split and year.

    The collapsed scores feed ranking, best F1 and quantiles of the whole group.
    """
    g = list(group)
    hit = ranking.threshold_metrics(df, threshold, y, p, None, g)
    ranked = ranking.ranked_scores(df, y, p, None, g)
    rank = ranking.ranking_from_prefix(ranked, g)
    best = ranking.best_f1(ranked, g, "lowest", epsilon=1e-12).select(
        *g, F.col("threshold").alias("best_f1_threshold"), F.col("f1").alias("best_f1"),
        F.col("precision").alias("best_f1_precision"), F.col("recall").alias("best_f1_recall"),
    )
    scores = ranking.weighted_scores(df, y, p, None, g)
    top = ranking.top_k_at_positives(df, key, y, p, g).select(
        *g, F.col("precision").alias("precision_at_positives"),
    )
    ece = ranking.ece_uniform(df, 10, y, p, g)
    yes = F.col(y) == 1
    means = df.groupBy(*g).agg(
        F.avg(F.when(yes, F.col(p))).alias("pos_mean"), F.avg(F.when(~yes, F.col(p))).alias("neg_mean")
    )
    # the overall and the class-wise quantiles come from one ordering pass
    kinds = F.explode(F.array(F.lit("all"), F.when(yes, "pos").otherwise("neg")))
    q = ranking.exact_quantiles(
        df.select(*g, F.col(p).alias("_q"), kinds.alias("_kind")), "_q",
        {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}, [*g, "_kind"],
    )
    pick = lambda kind, c: F.max(F.when(F.col("_kind") == kind, F.col(c)))
    quantiles = q.groupBy(*g).agg(
        pick("all", "p95").alias("probability_p95"), pick("pos", "p25").alias("pos_p25"),
        pick("pos", "p50").alias("pos_median"), pick("pos", "p75").alias("pos_p75"),
        pick("neg", "p50").alias("neg_median"), pick("neg", "p75").alias("neg_p75"),
        pick("neg", "p90").alias("neg_p90"), pick("neg", "p95").alias("neg_p95"),
    )
    t = _join([scores.drop("weighted_support"), hit, rank, best, top, ece, means, quantiles], g)
    ap, pi = F.col("average_precision"), F.col("prevalence")
    norm = F.when(pi < 1, (ap - pi) / (1 - pi))
    return t.withColumns(
        {
            "average_precision_lift": ratio(ap, pi),
            "normalized_average_precision": norm,
            "predicted_positive_rate": ratio(F.col("tp") + F.col("fp"), "support"),
            "f1_gap": F.col("best_f1") - F.col("f1"),
            "threshold_logit_delta": logit("best_f1_threshold") - logit(F.lit(float(threshold))),
            "score_gap": F.col("pos_mean") - F.col("neg_mean"),
            "ranking_difficulty": 100.0 * (1 - clip(norm, 0.0, 1.0)),
            "auc_difficulty": 100.0 * (1 - clip(F.col("roc_auc"), 0.5, 1.0)) / 0.5,
            "operational_difficulty": 100.0 * (1 - F.col("f1")),
        }
    )


def scoped_rows(df, regions, periods=None, date="date") -> DataFrame:
    """One copy of each row per region and scope: all, its year, its named periods.

    periods: name -> (first date, last date).
    """
    scopes = [F.lit("all"), F.year(date).cast("string")]
    for name, (a, b) in (periods or {}).items():
        scopes.append(F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), name))
    out = region_rows(df, regions, include_global=True)
    return out.withColumn("scope", F.explode(F.array_compact(F.array(*scopes))))


def metric_table(
    df, regions, periods=None, p="prob", y="is_fire", w="eval_weight", model="model_name",
    key=None, trials=0,
) -> DataFrame:
    """Weighted metrics per model, region and scope, with bootstrap errors if asked."""
    g = [model, "region", "scope"]
    flags = {
        f"_in_{i}": F.coalesce(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(False))
        for i, (a, b) in enumerate((periods or {}).values())
    }
    # scores collapse per cell, then per region and year, before they are copied into scopes
    parts = ["_year", *flags]
    dated = df.withColumns({"_year": F.year("date").cast("string"), **flags})
    lean = dated.groupBy(model, "lat_key", "lon_key", *parts, y, p).agg(F.sum(w).alias(w))
    inside = region_rows(lean, regions, include_global=True)
    yearly = ranking.collapse(inside, y, p, w, [model, "region", *parts])
    scopes = [F.lit("all"), F.col("_year")]
    scopes += [F.when(F.col(f), name) for f, name in zip(flags, periods or {}, strict=True)]
    scoped = yearly.withColumn("scope", F.explode(F.array_compact(F.array(*scopes))))
    collapsed = scoped.groupBy(*g, "score").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "n")])
    ranked = ranking.running_sums(collapsed, "score", ["pos", "neg", "n"], g)
    score, tp, fp = F.col("score"), F.col("cum_pos"), F.col("cum_neg")
    n_w = F.col("pos") + F.col("neg")
    f1 = F.coalesce(ratio(2 * tp, tp + fp + F.col("tot_pos")), F.lit(0.0))
    # every metric is a sum or a best row of the one ranked table
    table = ranked.groupBy(*g).agg(
        F.sum(n_w).alias("weighted_support"), F.sum("pos").alias("observed"),
        F.sum(score * n_w).alias("expected"),
        F.sum(F.col("pos") * (1 - score) * (1 - score) + F.col("neg") * score * score).alias("_b"),
        F.sum(-(F.col("pos") * F.log(score) + F.col("neg") * F.log1p(-score))).alias("_l"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("_step"),
        F.sum(F.col("neg") * (tp - F.col("pos") / 2)).alias("_above"),
        F.max("tot_pos").alias("_pos"), F.max("tot_neg").alias("_neg"),
        F.max_by(F.struct(score.alias("s"), f1.alias("f")), F.struct(F.round(f1, 12).alias("f"), score.alias("s"))).alias("_best"),
    )
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    out = table.select(
        *g, "weighted_support", "observed", "expected", ratio("_b", "weighted_support").alias("brier_score"),
        ratio("_l", "weighted_support").alias("log_loss"),
        ratio("expected", F.nullif("observed", F.lit(0.0))).alias("count_ratio"),
        F.when(both, F.col("_step") / F.col("_pos")).alias("average_precision"),
        F.when(both, F.col("_above") / (F.col("_pos") * F.col("_neg"))).alias("roc_auc"),
        F.when(both, F.col("_best.f")).alias("max_f1"),
        F.coalesce(F.when(both, F.col("_best.s")), F.lit(0.5)).alias("max_f1_threshold"),
    )
    if trials > 1:
        def spread(rows):
            named = rows.withColumn("region", F.explode("_regions"))
            return named.withColumn("scope", F.explode(F.array_compact(F.array(*scopes))))

        errors = sampling.bootstrap_error(
            region_names(dated, regions, include_global=True).select(model, "_regions", *parts, key, y, p, w),
            key, lambda r, k: ranking.ranking_from_prefix(ranking.ranked_once(r, y, p, w, k), k), trials,
            group=g, label=y, p=p, w=w, parts=[model, "_regions", *parts], spread=spread,
        )
        out = out.join(errors, g, "left")
    return out


def spatial_scale_table(df, p="prob", y="is_fire", w="eval_weight", model="model_name",
                        factors={"0.5deg": 5, "1deg": 10}) -> DataFrame:
    """The same metrics at exact cells, 3x3 neighbourhood labels and merged cells."""
    cols = [model, F.col(y).alias("is_fire"), F.col(p).alias("prob"), F.col(w).alias("eval_weight")]
    parts = [df.select(*cols, F.lit("exact").alias("scale"))]
    near = spatial.neighbourhood_labels(df, 1, y, group=[model])
    parts.append(
        near.select(model, F.col("near_label").alias("is_fire"), F.col(p).alias("prob"),
                    F.col(w).alias("eval_weight"), F.lit("3x3").alias("scale"))
    )
    for name, k in factors.items():
        coarse = summaries.coarse_cells(df, k, p=p, w=w, y=y, group=[model])
        parts.append(
            # equal means must tie whatever order they were summed in
            coarse.select(model, "is_fire", F.round("prob", 12).alias("prob"), "eval_weight",
                          F.lit(name).alias("scale"))
        )
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    g = [model, "scale"]
    return _join([ranking.weighted_scores(rows, group=g), ranking.ranking_metrics(rows, group=g)], g)


def index_ranking(df, index, y="is_fire", w="eval_weight", group=("model_name",)) -> DataFrame:
    """A weather index ranked as if it were a score, thresholds also in index units."""
    g = list(group)
    scored = minmax_scores(df.filter(F.col(index).isNotNull()), index, "_score")
    ranked = ranking.ranked_once(scored, y, "_score", w, g)
    f1 = ranking.best_f1(ranked, g)
    v = finite(index)
    span = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    base = _join([ranking.ranking_from_prefix(ranked, g), f1], g).withColumn("_s", span)
    return base.withColumn(
        "raw_threshold", F.col("_s.lo") + F.col("threshold") * (F.col("_s.hi") - F.col("_s.lo"))
    ).drop("_s")


def index_coverage(df, index, date="date") -> DataFrame:
    """Rows and days with an index value per month."""
    known = F.col(index).isNotNull()
    day = df.groupBy(date).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(known).alias("_k")
    )
    return day.groupBy(F.trunc(date, "month").alias("month")).agg(
        F.sum("_n").alias("rows"), F.sum("_k").alias("covered_rows"),
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("_k") > 0).alias("covered_days"),
    )


#: Where a row stands, where its values come from.
SIDES = ("a", "b")


def permutation_slices(df, key, seeds) -> DataFrame:
    """Counts of hash slices for `permuted`, all seeds in one pass, written to the checkpoint folder.

    A slice knows its positions from the counts before it, so it knows its block of positions: two
    or more, where it lies across a border. `_off` is where a side's rows of a block begin, from
    the block's first position; `_size` the positions of a block.
    """
    at = [
        F.struct(F.lit(seed).alias("_seed"), F.lit(i).alias("_side"), F.substring(sampling.hash_of(f"{seed}:{side}", key), 1, sampling.DIGITS).alias("_slice"))
        for seed in seeds
        for i, side in enumerate(SIDES)
    ]
    counts = df.select(F.inline(F.array(*at))).groupBy("_seed", "_side", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_seed", "_side")
    # a border doubles a slice of each side, so blocks are far fewer than slices
    blocks = F.least(F.ceil(F.sum("_n").over(own) / POSITIONS), F.lit(16**sampling.DIGITS // 8))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = counts.withColumns({"_before": before, "_size": F.ceil(F.sum("_n").over(own) / blocks), "_slice": F.conv("_slice", 16, 10).cast("int")})
    reach = F.sequence(F.floor(F.col("_before") / F.col("_size")), F.floor((F.col("_before") + F.col("_n") - 1) / F.col("_size")))
    table = table.withColumn("_block", F.explode(reach))
    off = F.min("_before").over(Window.partitionBy("_seed", "_side", "_block")) - F.col("_block") * F.col("_size")
    return cut(table.select("_seed", "_side", "_slice", F.col("_block").cast("int").alias("_block"), off.alias("_off"), "_size"))


def permuted(df, columns, key, seed, slices=None) -> DataFrame:
    """The table, without its key, with a block of columns moved between rows by a fixed permutation.

    Every row gets two positions, by two different hashes of its key; values move
    from one position to the other. Rows and values go once, straight to their block of
    positions (`permutation_slices`), where both are put in order; no task orders the whole table.
    """
    moved, kept = set(columns), [f for f in df.schema.fields if f.name != key]
    names = [f.name for f in kept]
    table = (permutation_slices(df, key, [seed]) if slices is None else slices).filter(F.col("_seed") == seed)
    # at most 512 blocks a side
    starts = {(r["_block"], r["_side"]): (r["_off"], r["_size"]) for r in table.select("_block", "_side", "_off", "_size").distinct().collect()}
    # 60 bits of the hash, the slice first
    short = lambda side: F.conv(F.substring(sampling.hash_of(f"{seed}:{side}", key), 1, 15), 16, 10).cast("long")
    at = [F.struct(F.lit(i).alias("_side"), short(side).alias("_h")) for i, side in enumerate(SIDES)]
    both = df.select("*", F.inline(F.array(*at)))
    both = both.withColumn("_slice", F.shiftright("_h", 60 - 4 * sampling.DIGITS).cast("int"))
    # one row per side and slice, and a few for borders
    spread = both.join(F.broadcast(table.select("_side", "_slice", "_block")), ["_side", "_slice"])
    spread = spread.select("_block", "_side", "_h", *[F.when(F.col("_side") == int(c in moved), F.col(c)).alias(c) for c in names])

    def matched(number: tuple, block: pa.Table) -> pa.Table:
        """Rows of one block with the values of the rows that have their positions."""
        block = block.combine_chunks()
        side, h = block["_side"].to_numpy(), block["_h"].to_numpy()

        def in_order(i):
            start, size = starts[number[0].as_py(), i]
            rows = np.flatnonzero(side == i)
            rows = rows[np.argsort(h[rows], kind="stable")]
            if (np.diff(h[rows]) == 0).any():
                # rows of one hash are told apart by their columns
                rows = rows[pc.sort_indices(block.take(rows), sort_keys=[(c, "ascending") for c in ("_h", *names)]).to_numpy()]
            return block.take(rows[-start : size - start])

        rows, values = in_order(0), in_order(1)
        return pa.table([(values if c in moved else rows)[c] for c in names], names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    return spread.groupBy("_block").applyInArrow(matched, schema)


def permutation_importance(df, score, groups, key, trials=3, seed=42, y="is_fire", p="prob",
                           w="eval_weight") -> DataFrame:
    """Mean and std of the average-precision drop when a feature group is shuffled.

    score: function(DataFrame) -> DataFrame with probability column `p`; it does not see the key
    of shuffled rows. Trials run one after the other, and what one has written goes before the
    next; one number of each reaches the driver.
    """
    spark = df.sparkSession

    def precision(rows):
        scores = cut(ranking.collapse(rows, y, p, w))
        found = ranking.ranking_from_prefix(ranking.running_sums(scores, "score", ["pos", "neg", "n"])).first()
        discard(scores)
        return found["average_precision"]

    runs = [(name, columns, f"{seed}:{name}:{trial}") for name, columns in groups.items() for trial in range(trials)]
    with shuffles_dropped(spark):
        base = precision(score(df))
        slices = permutation_slices(df, key, [own for *_, own in runs])
        got = [(name, precision(score(permuted(df, columns, key, own, slices)))) for name, columns, own in runs]
        discard(slices)
    one = [F.struct(F.lit(name).alias("feature_group"), F.lit(value).cast("double").alias("average_precision")) for name, value in got]
    drop = F.lit(base).cast("double") - F.col("average_precision")
    return spark.range(1).select(F.inline(F.array(*one))).groupBy("feature_group").agg(
        F.avg(drop).alias("mean_drop"), F.stddev_samp(drop).alias("std_drop"),
        F.count(F.lit(1)).alias("trials"),
    )
