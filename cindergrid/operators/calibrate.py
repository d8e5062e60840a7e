"""Probability calibration, score mapping and grouped thresholds."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.functions.labels import finite
from cindergrid.functions.probability import EPS, clip, logit, ratio, sigmoid
from cindergrid.operators.ranking import best_f1, exact_quantiles, row_positions, running_sums

# --- Platt ----------------------------------------------------------------------


MAX_LEVELS = 1000  # dummy levels that one fit takes


class PlattCalibrator:
    """Weighted unpenalised logistic fit of the label on logit(score) and dummies.

    Dummy levels are the months and countries of the fit table (a bounded list);
    a level not seen in the fit adds nothing. A table with one class only yields
    the constant prevalence.
    """

    def __init__(self, dummies=(), score="prob_raw", label="is_fire", weight="eval_weight"):
        self.dummies = list(dummies)
        self.score, self.label, self.weight = score, label, weight
        self.levels: dict[str, list] = {}
        self.coefficients: list[float] = []
        self.intercept = 0.0
        self.constant: float | None = None

    def _terms(self):
        terms = [logit(self.score)]
        for c in self.dummies:
            # every level has a term, so that an unknown one gets no other level's effect
            terms += [(F.col(c).cast("string") == v).cast("double") for v in self.levels[c]]
        return terms

    def fit(self, df) -> "PlattCalibrator":
        y, w = F.col(self.label).cast("double"), F.coalesce(finite(self.weight), F.lit(1.0))
        clean = df.filter(finite(self.score).isNotNull() & y.isNotNull() & (w > 0))
        row = clean.agg(F.sum(y * w).alias("p"), F.sum((1 - y) * w).alias("n")).first()
        pos, neg = row["p"] or 0.0, row["n"] or 0.0
        if pos <= 0 or neg <= 0:
            self.constant = pos / (pos + neg) if pos + neg > 0 else 0.0
            return self
        for c in self.dummies:
            found = clean.select(F.col(c).cast("string").alias("v")).dropna().distinct().limit(MAX_LEVELS + 1).collect()
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
            self.levels[c] = sorted(r["v"] for r in found)
        names = [f"_x{i}" for i in range(len(self._terms()))]
        # equal inputs are merged first: the fit depends on weight sums only
        table = (
            clean.select(*[t.alias(n) for t, n in zip(self._terms(), names)], y.alias("y"), w.alias("w"))
            .groupBy(*names, "y").agg(F.sum("w").alias("w"))
        )
        vector = VectorAssembler(inputCols=names, outputCol="_f").transform(table)
        model = LogisticRegression(
            featuresCol="_f", labelCol="y", weightCol="w", regParam=0.0, maxIter=200, tol=1e-10,
            standardization=True,
        ).fit(vector.select("_f", "y", "w"))
        self.coefficients = [float(v) for v in model.coefficients]
        self.intercept = float(model.intercept)
        return self

    def apply(self, df, out="prob_calibrated") -> DataFrame:
        if self.constant is not None:
            return df.withColumn(out, F.lit(self.constant))
        z = F.lit(self.intercept)
        for k, term in zip(self.coefficients, self._terms()):
            z = z + F.coalesce(term, F.lit(0.0)) * k
        return df.withColumn(out, sigmoid(z))


# --- prior offsets --------------------------------------------------------------


def fit_offsets(df, group=(), raw=None, score="prob_raw", label="is_fire", weight="eval_weight",
                fanout=32, passes=9, rel_tol=1e-6) -> DataFrame:
    """Per group the shift b with sum(w * sigmoid(s + b)) = sum(w * y), on [-80, 80].

    All groups are narrowed together: one aggregation over score-collapsed rows
    evaluates fanout - 1 trial shifts of every open group, so the bracket shrinks
    32-fold per pass. Only (group, bracket) rows reach the driver. The row with
    NULL keys is the whole table's offset.
    """
    g = list(group)
    s = finite(raw) if raw else logit(score)
    y, w = F.col(label).cast("double"), F.coalesce(finite(weight), F.lit(1.0))
    base = df.select(*g, F.coalesce(s, F.lit(0.0)).alias("_s"), y.alias("_y"), w.alias("_w")).filter(
        (F.col("_w") > 0) & F.col("_y").isNotNull()
    )
    rows = base.groupBy(*g, "_s").agg(
        F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_y")).alias("_o")
    )
    if g:
        whole = rows.groupBy("_s").agg(F.sum("_w").alias("_w"), F.sum("_o").alias("_o"))
        for c in g:
            whole = whole.withColumn(c, F.lit(None).cast(dict(df.dtypes)[c]))
        rows = rows.withColumn("_all", F.lit(False)).unionByName(
            whole.withColumn("_all", F.lit(True))
        )
    else:
        rows = rows.withColumn("_all", F.lit(True))
    keys = [*g, "_all"]
    rows = rows.persist()
    spark = df.sparkSession
    fields = [*rows.select(*keys).schema.fields, T.StructField("lo", T.DoubleType()),
              T.StructField("hi", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    done, live = {}, {}
    for r in rows.groupBy(*keys).agg(F.sum("_o").alias("o"), F.sum("_w").alias("w")).collect():
        target = r["o"] if r["o"] > 0 else EPS * r["w"]
        live[tuple(r[k] for k in keys)] = (-80.0, 80.0, target)
    for _ in range(passes):
        if not live:
            break
        state = spark.createDataFrame([(*k, v[0], v[1]) for k, v in live.items()], schema)
        names = {k: f"_j{i}" for i, k in enumerate(keys)}
        state = state.withColumnsRenamed(names)
        on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        step = (F.col("hi") - F.col("lo")) / fanout
        # one row per group: a sorted join would lay a whole group into one task
        sums = rows.join(F.broadcast(state), on).groupBy(*keys).agg(
            *[
                F.sum(F.col("_w") * sigmoid(F.col("_s") + F.col("lo") + step * j)).alias(f"e{j}")
                for j in range(1, fanout)
            ]
        )
        after = {}
        for r in sums.collect():
            k = tuple(r[c] for c in keys)
            lo, hi, target = live[k]
            width = (hi - lo) / fanout
            tol = max(1e-9, abs(target) * rel_tol)
            values = [r[f"e{j}"] for j in range(1, fanout)]
            near = min(range(len(values)), key=lambda i: abs(values[i] - target))
            if abs(values[near] - target) <= tol:
                done[k] = lo + width * (near + 1)
                continue
            below = sum(v < target for v in values)
            after[k] = (lo + width * below, lo + width * (below + 1), target)
        live = after
    for k, (lo, hi, _) in live.items():
        done[k] = (lo + hi) / 2
    rows.unpersist()
    out = T.StructType([*schema.fields[:-2], T.StructField("offset", T.DoubleType())])
    return spark.createDataFrame([(*k, v) for k, v in done.items()], out)


def apply_offsets(df, offsets, group=(), raw=None, score="prob_raw", out="prob_calibrated"):
    """Shifted probabilities; groups not in the fit use the whole table's offset."""
    g = list(group)
    whole = offsets.filter("_all").agg(F.max("offset")).scalar()
    s = F.coalesce(finite(raw), F.lit(0.0)) if raw else logit(score)
    joined = df
    if g:
        joined = df.join(F.broadcast(offsets.filter("not _all").select(*g, "offset")), g, "left")
    else:
        joined = df.withColumn("offset", F.lit(None).cast("double"))
    return joined.withColumn("_whole", whole).withColumn(
        out, sigmoid(s + F.coalesce("offset", "_whole"))
    ).drop("offset", "_whole")


def calibration_metadata(df, method, score="prob_raw", label="is_fire", weight="eval_weight",
                         calibrated="prob_calibrated") -> DataFrame:
    """One row describing a calibration run."""
    w = F.col(weight)
    return df.agg(
        F.lit(method).alias("method"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).alias("positives"),
        F.sum(w).alias("weighted_support"),
        F.sum(w * F.col(label)).alias("observed"),
        F.sum(w * F.col(score)).alias("expected_before"),
        F.sum(w * F.col(calibrated)).alias("expected_after"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ).withColumns(
        {
            "prevalence": ratio("observed", "weighted_support"),
            "ratio_before": ratio("expected_before", F.nullif("observed", F.lit(0.0))),
            "ratio_after": ratio("expected_after", F.nullif("observed", F.lit(0.0))),
        }
    )


def platt_with_prevalence(df, score="prob_raw", label="is_fire", weight="eval_weight",
                          out="prob_calibrated") -> tuple[DataFrame, DataFrame]:
    """Diagnostic test-set Platt fit, rescaled so that expected counts match observed.

    With one class only, scores are scaled by the count ratio instead.
    """
    model = PlattCalibrator((), score, label, weight).fit(df)
    fitted = model.apply(df, out) if model.constant is None else df.withColumn(out, F.col(score))
    w = F.col(weight)
    scale = fitted.agg(
        F.struct(
            F.coalesce(ratio(F.sum(w * F.col(label)), F.sum(w * F.col(out))), F.lit(1.0)).alias("k"),
        )
    ).scalar()
    scaled = fitted.withColumn("_k", scale).withColumn(
        out, clip(F.col(out) * F.col("_k.k"), 0.0, 1.0)
    ).drop("_k")
    method = "platt" if model.constant is None else "count_ratio"
    return scaled, calibration_metadata(scaled, method, score, label, weight, out)


# --- score mapping --------------------------------------------------------------


def quantile_map(scores, truth, score="score", value="truth", key="key", out="mapped") -> DataFrame:
    """Scores replaced by truth values of the same rank.

    Position i of n scores takes the truth at floor(i * (m - 1) / (n - 1)). If
    nothing was observed, scores above their 99th percentile become 1, others 0.
    """
    placed = row_positions(scores, score, F.col(key))
    want = F.when(
        F.col("_size") > 1,
        F.floor(F.col("_pos") * (F.col("_m") - 1) / (F.col("_size") - 1)),
    ).otherwise(0).cast("long")
    stats = truth.agg(
        F.struct(F.count(F.lit(1)).alias("m"), F.max(value).alias("top"))
    ).scalar()
    cut = exact_quantiles(scores, score, {"q": 0.99}).scalar()
    placed = placed.withColumns({"_t": stats, "_cut": cut}).withColumn("_m", F.col("_t.m"))
    placed = placed.withColumn("_at", want)
    # truth as runs of equal values; wide runs are cut so that no run is a hot key
    runs = truth.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    runs = running_sums(runs, value, ["_n"], descending=False).select(
        F.col(value).alias("_v"), (F.col("cum__n") - F.col("_n")).cast("long").alias("_from"),
        F.col("cum__n").cast("long").alias("_to"),
    )
    size = 4096
    blocks = runs.withColumn(
        "_blk", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size)))
    )
    at = placed.withColumn("_blk", F.floor(F.col("_at") / size))
    hit = at.join(blocks, "_blk").filter(
        (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    )
    flat = (F.col(score) > F.col("_cut")).cast("double")
    return hit.withColumn(
        out, F.when(F.col("_t.top") == 0, flat).otherwise(F.col("_v"))
    ).select(*scores.columns, out)


def ratio_threshold(scores, truth, score="score", value="truth") -> DataFrame:
    """Score threshold giving the observed share of events; 0.999 / 0.001 at the ends."""
    binary = F.when(F.col(value) > 0, 1.0).otherwise(0.0)
    rate = truth.agg(
        F.when(F.max(value) > 1, F.avg(binary)).otherwise(F.avg(F.col(value).cast("double"))).alias("r")
    ).scalar()
    counts = scores.groupBy(F.col(score).alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranked = running_sums(counts, "_v", ["_n"], descending=False).withColumn("_r", rate)
    h = (1 - F.col("_r")) * (F.col("tot__n") - 1)
    lo, hi = F.col("cum__n") - F.col("_n"), F.col("cum__n")
    value_at = lambda p: F.max(F.when((p >= lo) & (p < hi), F.col("_v")))
    t = ranked.agg(
        value_at(F.floor(h)).alias("a"), value_at(F.ceil(h)).alias("b"), F.max(h - F.floor(h)).alias("f"),
        F.max("_r").alias("event_rate"),
    )
    return t.select(
        "event_rate",
        F.when(F.col("event_rate") == 0, 0.999).when(F.col("event_rate") == 1, 0.001)
        .otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("threshold"),
    )


# --- grouped thresholds ---------------------------------------------------------

STRATEGIES = {
    "global": [], "season": ["season"], "region": ["region"], "region_season": ["region", "season"],
}


def threshold_policy(validation, strategy, p="prob", label="is_fire", min_rows=1000,
                     min_positives=20, min_negatives=20, min_precision=None, min_recall=None):
    """F1-optimal threshold per group; thin groups fall back to the global one."""
    from cindergrid.operators.ranking import ranked_scores

    keys = STRATEGIES[strategy]
    named = validation.withColumn(
        "group", F.concat_ws("|", *keys) if keys else F.lit("global")
    )
    limits = dict(ties="lowest", min_precision=min_precision, min_recall=min_recall, epsilon=1e-12)

    def fit(df, g):
        return best_f1(ranked_scores(df, label, p, None, g), g, **limits)

    whole = fit(named, [])
    table = fit(named, ["group"]) if keys else whole.withColumn("group", F.lit("global"))
    sizes = named.groupBy("group").agg(
        F.count(F.lit(1)).alias("support"), F.sum(label).cast("long").alias("positives"),
    ).withColumn("negatives", F.col("support") - F.col("positives"))
    joined = sizes.join(table, "group", "left").withColumn(
        "_g", whole.select(F.struct("threshold", "f1")).scalar()
    )
    enough = (
        (F.col("support") >= min_rows) & (F.col("positives") >= min_positives)
        & (F.col("negatives") >= min_negatives)
    )
    reason = (
        F.when(~enough, "too_few_rows")
        .when(F.col("f1").isNull(), "constraints_unsatisfied").otherwise("validation_f1_max")
    )
    ok = reason == "validation_f1_max"
    return joined.select(
        "group", "support", "positives", "negatives",
        F.when(ok, F.col("threshold")).otherwise(F.col("_g.threshold")).alias("threshold"),
        F.when(ok, F.col("f1")).alias("validation_f1"),
        reason.alias("reason"), F.col("_g.threshold").alias("global_threshold"),
    )


def apply_policy(test, policy, strategy, p="prob", out="pred") -> DataFrame:
    """Predictions by each row's group threshold; unseen groups use the global one."""
    keys = STRATEGIES[strategy]
    lookup = policy.agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct("group", "threshold"))).alias("m"),
            F.max("global_threshold").alias("g"),
        )
    ).scalar()
    named = test.withColumns(
        {"group": F.concat_ws("|", *keys) if keys else F.lit("global"), "_m": lookup}
    )
    t = F.coalesce(F.try_element_at(F.col("_m.m"), F.col("group")), F.col("_m.g"))
    return named.withColumn("threshold", t).withColumn(
        out, (F.col(p) >= F.col("threshold")).cast("int")
    ).drop("_m")
