"""Detection thresholds, static-context masks and label weights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DetectionThresholds:
    brightness: float = 320.0
    confidence: float = 85.0
    brightness_high_lat: float = 310.0
    confidence_high_lat: float = 75.0
    high_latitude: float = 58.0
    use_high_latitude: bool = True
    use_special_box: bool = True


def confidence_scale(df: DataFrame, column: str, threshold: float, group=()) -> DataFrame:
    """One row (per group): the scale of a confidence column and the threshold on it.

    The 95th percentile never exceeds the maximum, so "either is above 1" is
    decided by the maximum alone; no percentile pass is needed.
    """
    value = F.col(column).cast("double")
    top = F.max(F.when(~F.isnan(value), value))
    scale = (
        F.when(top.isNull(), "unknown").when(top > 1.0, "percent_0_100").otherwise("fraction_0_1")
    )
    t = F.lit(float(threshold))
    rescaled = (
        F.when((F.col("scale") == "percent_0_100") & (t <= 1.0), t * 100.0)
        .when((F.col("scale") == "fraction_0_1") & (t > 1.0), t / 100.0)
        .otherwise(t)
    )
    return (
        df.groupBy(*group)
        .agg(top.alias("max_confidence"), scale.alias("scale"))
        .withColumn("threshold", rescaled)
    )


def detection_filter(t: DetectionThresholds) -> Column:
    """Strict thresholds by latitude band, with the relaxed north-western box."""
    b, c = F.col("brightness"), F.col("confidence")
    if not t.use_high_latitude:
        return (b > t.brightness) & (c > t.confidence)
    high = F.abs(F.col("latitude")) > t.high_latitude
    keep = (~high & (b > t.brightness) & (c > t.confidence)) | (
        high & (b > t.brightness_high_lat) & (c > t.confidence_high_lat)
    )
    if t.use_special_box:
        slack = 15.0 if t.confidence_high_lat > 1 else 0.15
        keep = keep | (
            (F.col("latitude") > t.high_latitude)
            & (F.col("longitude") < 45.0)
            & (b > max(t.brightness_high_lat - 30.0, 0.0))
            & (c > max(t.confidence_high_lat - slack, 0.0))
        )
    return keep


@dataclass(frozen=True)
class StaticContext:
    """Settings of the burnable, urban and large-city masks."""

    require_land: bool = True
    land_column: str = "landseamask"
    land_threshold: float = 70.0
    require_burnable: bool = True
    cover_columns: tuple[str, ...] = ()
    category_columns: tuple[str, ...] = ()
    min_cover: float = 0.05
    min_category: float = 1.0
    keep_unknown: bool = True
    light_columns: tuple[str, ...] = ()
    max_light: float | None = None
    population_columns: tuple[str, ...] = ()
    max_population: float | None = None
    city_population_columns: tuple[str, ...] = ("population",)
    city_min_population: float | None = None
    city_light_columns: tuple[str, ...] = ()
    city_min_light: float | None = None
    city_require_land: bool = True
    strata: dict = field(default_factory=dict)


def finite(column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def burnable_mask(columns, s: StaticContext) -> Column:
    mask = F.lit(True)
    unknown = F.lit(s.keep_unknown)
    if s.require_land:
        if s.land_column in columns:
            mask = mask & F.coalesce(finite(s.land_column) < s.land_threshold, unknown)
        else:
            mask = mask & unknown
    if s.require_burnable:
        cover = [c for c in s.cover_columns if c in columns]
        category = [c for c in s.category_columns if c in columns]
        present, least = (cover, s.min_cover) if cover else (category, s.min_category)
        if present:
            best = F.array_max(F.array(*[finite(c) for c in present]))
            mask = mask & F.coalesce(best >= least, unknown)
        else:
            mask = mask & unknown
    return mask


def _any_above(columns, names, limit, strict=True) -> Column:
    out = F.lit(False)
    if limit is None:
        return out
    for name in names:
        if name in columns:
            v = finite(name)
            out = out | F.coalesce(v > limit if strict else v >= limit, F.lit(False))
    return out


def urban_artifact_mask(columns, s: StaticContext) -> Column:
    return _any_above(columns, s.light_columns, s.max_light) | _any_above(
        columns, s.population_columns, s.max_population
    )


def large_city_mask(columns, s: StaticContext) -> Column:
    city = _any_above(
        columns, s.city_population_columns, s.city_min_population, strict=False
    ) | _any_above(columns, s.city_light_columns, s.city_min_light, strict=False)
    if s.city_require_land and s.land_column in columns:
        city = city & F.coalesce(finite(s.land_column) < s.land_threshold, F.lit(False))
    return city


def filter_labels(df: DataFrame, s: StaticContext) -> DataFrame:
    cols = df.columns
    return df.filter(burnable_mask(cols, s) & ~urban_artifact_mask(cols, s))


def label_filter_report(df: DataFrame, s: StaticContext) -> DataFrame:
    """Removal counts of the label filter, in one aggregation pass."""
    cols = df.columns
    burn, urban = burnable_mask(cols, s), urban_artifact_mask(cols, s)
    return df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(~burn).alias("removed_non_burnable"),
        F.count_if(burn & urban).alias("removed_urban_artifact"),
        F.count_if(~(burn & ~urban)).alias("removed_total"),
        F.count_if(burn & ~urban).alias("output_rows"),
    )


def boost_weight(lat, lon, boxes) -> Column:
    """Largest multiplier over the boxes holding a point; missing sides are open."""
    weight = F.lit(1)
    for box in boxes:
        inside = F.lit(True)
        for side, col, op in (
            ("min_lat", lat, "ge"), ("max_lat", lat, "le"),
            ("min_lon", lon, "ge"), ("max_lon", lon, "le"),
        ):
            if box.get(side) is not None:
                bound = F.lit(float(box[side]))
                inside = inside & (F.col(col) >= bound if op == "ge" else F.col(col) <= bound)
        weight = F.greatest(weight, F.when(inside, F.lit(int(box.get("multiplier", 1)))))
    return weight


def soft_label(
    count="count",
    distance="nearest_positive_distance_cells",
    delta="nearest_positive_delta_days",
    max_distance=5.0,
    max_delta=7.0,
    spatial_decay=2.0,
    temporal_decay=7.0,
    max_negative=0.35,
) -> Column:
    """1 for events; for near negatives a value decaying in space and time."""
    d, t = finite(distance), finite(delta)
    soft = (
        F.lit(max_negative)
        * F.exp(-F.greatest(d - 1.0, F.lit(0.0)) / max(spatial_decay, 1e-6))
        * F.exp(-F.greatest(t, F.lit(0.0)) / max(temporal_decay, 1e-6))
    )
    value = (
        F.when(F.coalesce(F.col(count), F.lit(0)) > 0, 1.0)
        .when((d <= max_distance) & (t <= max_delta), soft)
        .otherwise(0.0)
    )
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
