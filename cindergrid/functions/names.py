"""Feature-name taxonomies, computed on a catalogue DataFrame of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (group, pattern) pairs tried in order on the lower-case name.
STUDY_GROUPS = [
    ("seasonality", r"^month$|dayofyear|^doy|_sin$|_cos$|^is_weekend_|^is_holiday_"),
    ("weather_history", r"^(t2m|d2m|tp|stl1|u10|v10|msl|sd)_"),
    ("fire_weather_fwi", r"^fire_index_"),
    ("anthropogenic", r"road|population|night_light|light_density|distance_to_light"),
    ("vegetation_fuel_ecoregion",
     r"ecoregion|^slt$|^tvh$|^tvl$|^slt_soil_type_stream_oper_daily_mean$"),
    ("vegetation_fuel_ecoregion", r"lai|forest|vegetation|soil_type"),
    ("terrain_topography",
     r"elevation|topography|slope|aspect|anor|isor|slor|sdor|sdfor|^z$"),
    ("historical_fire_context",
     r"historical|prior_fire|past_fire|fire_density|fire_count|burned|proximity_fire"),
    ("location", r"^(lat|lon)_rounded$"),
    ("coast_landmask", r"landseamask|distance_to_coast|coast"),
]
MODEL_GROUPS = [
    ("climate_t2m", r"^t2m$|^t2m_|_t2m_"),
    ("climate_d2m", r"^d2m$|^d2m_|_d2m_"),
    ("climate_tp", r"^tp$|^tp_|_tp_"),
    ("climate_stl1", r"^stl1$|^stl1_|_stl1_"),
    ("ecoregion", r"ecoregion|^realm$|^biome$"),
    ("geospatial", r"lat|lon|elevation|topography|slope|aspect"),
    ("infrastructure", r"road"),
    ("night_lights", r"night|light"),
    ("population", r"population"),
    ("land_static", r"forest|vegetation|soil|landsea|land_sea|tvl|tvh|slt"),
    ("fire_index", r"fire_index"),
    ("time", r"date|time|year|month|day"),
]


def _first_match(name: Column, rules, default: Column) -> Column:
    low = F.lower(name)
    chain = None
    for group, pattern in rules:
        chain = F.when(low.rlike(pattern), group) if chain is None else chain.when(
            low.rlike(pattern), group
        )
    return chain.otherwise(default)


def study_group(name="feature") -> Column:
    return _first_match(F.col(name), STUDY_GROUPS, F.lit("other"))


def model_group(name="feature") -> Column:
    low = F.lower(F.col(name))
    default = F.when(low.contains("_"), F.split_part(low, F.lit("_"), F.lit(1))).otherwise("other")
    return _first_match(F.col(name), MODEL_GROUPS, default)


def window_days(name="feature") -> Column:
    """Last all-digit token of a name split on underscores, else NULL."""
    digits = F.filter(F.split(F.lower(F.col(name)), "_"), lambda t: t.rlike(r"^\d+$"))
    return F.try_element_at(digits, F.lit(-1)).cast("int")


def feature_catalogue(names: DataFrame, feature="feature") -> DataFrame:
    """feature -> both groups, window days and the flags used by ablation sets."""
    low = F.lower(F.col(feature))
    seasonal = low.rlike(r"dayofyear|day_of_year|doy") & low.rlike(r"sin|cos")
    smoothed = low.contains("gaussian") & low.rlike(r"road|light|pop")
    geography = low.rlike(
        r"^(lat_rounded|lon_rounded|latitude|longitude|lat|lon|country|country_code|admin|region)$"
        r"|^(lat|lon|latitude|longitude|country|admin)_"
    ) | study_group(feature).isin("location", "coast_landmask")
    return names.select(
        F.col(feature).alias("feature"),
        study_group(feature).alias("study_group"),
        model_group(feature).alias("model_group"),
        window_days(feature).alias("window_days"),
        seasonal.alias("periodic_seasonality"),
        smoothed.alias("smoothed_anthropogenic"),
        low.contains("ecoregion").alias("ecoregion"),
        geography.alias("direct_geography"),
    )


def ablation_sets(catalogue: DataFrame) -> DataFrame:
    """(feature_set, feature) membership rows of the study's ablations."""
    g = F.col("study_group")
    weather, fwi = g == "weather_history", g == "fire_weather_fwi"
    rules = {
        "full": F.lit(True),
        "weather_only": weather,
        "fwi_only": fwi,
        "no_anthropogenic": g != "anthropogenic",
        "no_ecoregion": ~F.col("ecoregion"),
        "no_geography": ~F.col("direct_geography"),
        "no_fuel_ecoregion_vegetation": g != "vegetation_fuel_ecoregion",
        "no_terrain": g != "terrain_topography",
        "no_seasonality": g != "seasonality",
        "no_history": g != "historical_fire_context",
        "no_temporal_history": ~weather,
        "shorter_sequence_30d": ~(weather & F.coalesce(F.col("window_days") > 30, F.lit(False))),
        "no_periodic_seasonality": ~F.col("periodic_seasonality"),
        "no_gaussian_smoothing": ~F.col("smoothed_anthropogenic"),
        "static_only": ~weather & ~fwi,
        "dynamic_weather_fwi_only": weather | fwi,
    }
    members = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return catalogue.select(
        F.explode(F.array_compact(members)).alias("feature_set"), "feature", "study_group"
    )


def lead_limited(catalogue: DataFrame, lead_days: int, full_lead: int = 30) -> DataFrame:
    """All features at the full lead; below it, only weather windows it can still see."""
    if lead_days == full_lead:
        return catalogue
    windows = [w for w in (7, 14) if w <= lead_days]
    usable = F.lower(F.col("feature")).rlike("|".join(f"_{w}" for w in windows) or "$^")
    return catalogue.filter((F.col("study_group") != "weather_history") | usable)


def leakage(catalogue: DataFrame, forbidden) -> DataFrame:
    """Rows naming a label or detection column that must not be a model input."""
    return catalogue.filter(F.col("feature").isin(list(forbidden)))
