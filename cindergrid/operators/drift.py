"""Priors, distribution shift, stability indices and yearly difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.labels import finite
from cindergrid.functions.probability import ratio
from cindergrid.operators.ranking import exact_quantiles

MISSING = "<missing>"
EPS = 1e-9


def error_slices(df, y="is_fire", pred="pred", p="prob", keys=("split", "year", "ecoregion", "month"),
                 min_rows=50, top=25) -> DataFrame:
    """Confusion counts per slice; the slices with most errors per (split, year)."""
    yes, hit = F.col(y) == 1, F.col(pred) == 1
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(yes).alias("positives"),
        F.count_if(hit).alias("predicted_positives"),
        F.count_if(yes & hit).alias("tp"),
        F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
        F.avg(p).alias("mean_probability"),
    ).filter(F.col("rows") >= min_rows)
    w = Window.partitionBy(*keys[:2]).orderBy(
        (F.col("fp") + F.col("fn")).desc(), *keys[2:]
    )
    return g.withColumns(
        {
            "prevalence": F.col("positives") / F.col("rows"),
            "precision": ratio("tp", F.col("tp") + F.col("fp")),
            "recall": ratio("tp", "positives"),
            "error_count": F.col("fp") + F.col("fn"),
            "error_rank": F.row_number().over(w),
        }
    ).filter(F.col("error_rank") <= top)


def historical_prior(train, rows, keys, alpha=50.0, y="is_fire", out="prior") -> DataFrame:
    """Smoothed event rate of each key set on the training rows."""
    rate = train.agg(F.avg(y)).scalar()
    table = train.groupBy(*keys).agg(F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(table, list(keys), "left").withColumn("_g", rate)
    smooth = (F.col("_p") + F.col("_g") * alpha) / (F.col("_n") + alpha)
    return joined.withColumn(out, F.coalesce(smooth, F.col("_g"))).drop("_p", "_n", "_g")


def _as_text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def js_divergence(train, rows, features, group=("split", "year"), y="is_fire") -> DataFrame:
    """Jensen-Shannon divergence (bits) of categories to training, all and positive rows."""

    def counted(df, keys):
        # one pass over the rows for every feature and both populations
        pairs = F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), _as_text(f).alias("value"))
                      for f in features])
        )
        flat = df.select(*keys, y, pairs.alias("x")).groupBy(
            *keys, F.col("x.feature").alias("feature"), F.col("x.value").alias("value")
        ).agg(F.count(F.lit(1)).alias("all"), F.sum(y).alias("positive"))
        return flat.unpivot([*keys, "feature", "value"], ["all", "positive"], "population", "n")

    def shares(t, keys):
        w = Window.partitionBy(*keys, "feature", "population")
        return t.withColumn("share", ratio("n", F.sum("n").over(w))).drop("n")

    g = list(group)
    base = shares(counted(train, []), []).withColumnRenamed("share", "q")
    here = shares(counted(rows, g), g).withColumnRenamed("share", "p")
    # every group is compared over the union of both sets of categories
    groups = here.select(*g, "feature", "population").distinct()
    wanted = groups.join(base, ["feature", "population"])
    keys = [*g, "feature", "population", "value"]
    both = wanted.join(here, keys, "full_outer").select(
        *keys, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")
    )
    m = (F.col("p") + F.col("q")) / 2

    def part(c):
        return F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)

    return both.groupBy(*g, "feature", "population").agg(
        F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum(part("p") + part("q")) / 2).alias("js_bits")
    )


def _psi(counts, keys) -> DataFrame:
    """Stability index from (keys, bin, n_train, n_eval); empty bins count EPS rows."""
    w = Window.partitionBy(*keys)
    s = counts.withColumns(
        {"_p": F.greatest("n_train", F.lit(EPS)), "_q": F.greatest("n_eval", F.lit(EPS))}
    )
    s = s.withColumns(
        {"_p": F.col("_p") / F.sum("_p").over(w), "_q": F.col("_q") / F.sum("_q").over(w)}
    )
    return s.groupBy(*keys).agg(
        F.sum((F.col("_q") - F.col("_p")) * F.log(F.col("_q") / F.col("_p"))).alias("psi")
    )


def numeric_psi(train, rows, features, group=("year",), bins=10) -> DataFrame:
    """Index over training-quantile bins with open ends and always a NULL bin."""
    g = list(group)
    melt = lambda df, keys: df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("value"))
                      for f in features])
        ).alias("x"),
    ).select(*keys, "x.*")
    base, here = melt(train, []), melt(rows, g)
    qs = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = exact_quantiles(base, "value", qs, ["feature"]).select(
        "feature", F.array_sort(F.array_distinct(F.array(*qs))).alias("cuts")
    )
    # one small row of cut points per feature, gathered into a map for the row pass
    lookup = cuts.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "cuts"))).alias("m")
    ).scalar()

    def binned(df, keys, name):
        slot = F.when(
            F.col("value").isNotNull(),
            F.size(F.filter(F.element_at("_m", F.col("feature")), lambda c: c < F.col("value"))),
        ).otherwise(-1)
        return df.withColumn("_m", lookup).withColumn("bin", slot).groupBy(
            *keys, "feature", "bin"
        ).agg(F.count(F.lit(1)).alias(name))

    n_train, n_eval = binned(base, [], "n_train"), binned(here, g, "n_eval")
    grid = n_eval.select(*g, "feature").distinct().join(
        cuts.select(
            "feature", F.explode(F.sequence(F.lit(-1), F.size("cuts"))).alias("bin")
        ),
        "feature",
    )
    counts = grid.join(n_train, ["feature", "bin"], "left").join(
        n_eval, [*g, "feature", "bin"], "left"
    ).na.fill(0, ["n_train", "n_eval"])
    return _psi(counts, [*g, "feature"])


def categorical_psi(train, rows, features, group=("year",), top=30) -> DataFrame:
    """Index over the training rows' most frequent categories and `other`."""
    g = list(group)
    melt = lambda df, keys: df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), _as_text(f).alias("value"))
                      for f in features])
        ).alias("x"),
    ).select(*keys, "x.*")
    base = melt(train, []).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_train"))
    w = Window.partitionBy("feature").orderBy(F.col("n_train").desc(), "value")
    head = base.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top)
    kept = head.select("feature", "value").withColumn("_keep", F.lit(True))
    here = melt(rows, g).groupBy(*g, "feature", "value").agg(F.count(F.lit(1)).alias("n_eval"))

    def bucketed(t, keys, n):
        j = t.join(kept, ["feature", "value"], "left")
        name = F.when(F.col("_keep"), F.col("value")).otherwise("<other>")
        return j.groupBy(*keys, "feature", name.alias("bin")).agg(F.sum(n).alias(n))

    bt, be = bucketed(base, [], "n_train"), bucketed(here, g, "n_eval")
    grid = be.select(*g, "feature").distinct().join(bt, "feature")
    counts = grid.join(be, [*g, "feature", "bin"], "full_outer").na.fill(0, ["n_train", "n_eval"])
    return _psi(counts, [*g, "feature"])


def shift_summary(detail, importance, group=("year",)) -> DataFrame:
    """Importance-weighted feature shift per group, weights summing to one."""
    w = F.greatest(F.coalesce("importance_weight", F.lit(0.0)), F.lit(0.0))
    total = importance.agg(F.sum(w)).scalar()
    n = importance.agg(F.count(F.lit(1))).scalar()
    share = importance.withColumns({"_t": total, "_n": n}).select(
        "feature",
        F.when(F.col("_t") > 0, w / F.col("_t")).otherwise(1.0 / F.col("_n")).alias("weight"),
    )
    return detail.join(share, "feature").groupBy(*group).agg(
        F.sum(F.col("weight") * F.col("psi")).alias("weighted_feature_shift"),
        F.avg("psi").alias("mean_feature_psi"),
        F.max("psi").alias("max_feature_psi"),
    )


def difficulty_table(metrics, feature_shift, composition_shift, keys=("split", "year")) -> DataFrame:
    """Yearly metrics with both shifts and a dense difficulty rank (1 = hardest)."""
    joined = metrics.join(feature_shift, list(keys), "left").join(
        composition_shift, list(keys), "left"
    )
    source = F.coalesce("ranking_difficulty", "operational_difficulty")
    # one row per evaluated year
    w = Window.orderBy(source.desc())
    return joined.withColumn("difficulty_rank", F.dense_rank().over(w))
