"""Detection files: scan by country and date range, tag by polygon, write per country."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("latitude", "longitude", "acq_date", "brightness", "confidence")

DETECTION_SCHEMA = (
    "latitude double, longitude double, acq_date date, brightness double, confidence double"
)


def require_columns(df: DataFrame, names=REQUIRED) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def select_detections(df, countries=None, start: date | None = None, end: date | None = None):
    """Rows of the chosen countries inside the closed date range."""
    df = require_columns(df)
    if countries is not None:
        df = df.filter(F.col("country").isin(list(countries)))
    if start is not None:
        df = df.filter(F.col("acq_date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("acq_date") <= F.lit(end))
    return df


def scan_detections(
    spark: SparkSession, root: str, countries, start: date, end: date, schema=DETECTION_SCHEMA,
    prefix: str = "modis",
) -> DataFrame:
    """Read <root>/<prefix>/<year>/<prefix>_<year>_<country>.csv for the wanted files.

    Only the wanted paths are looked at, so the cost does not grow with the tree; those
    that do not exist are left out. A path may be a file or a folder of part files.
    """
    wanted = [
        f"{root}/{prefix}/{year}/{prefix}_{year}_{country}.csv"
        for year in range(start.year, end.year + 1) for country in dict.fromkeys(countries)
    ]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    setup = spark.sparkContext._jsc.hadoopConfiguration()
    places = [(p, hadoop.Path(p)) for p in wanted]
    there = [p for p, place in places if place.getFileSystem(setup).exists(place)]
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    raw = reader.csv(there) if there else spark.createDataFrame([], schema)
    file = F.input_file_name()
    pattern = rf"/{prefix}_(\d{{4}})_([^/]+)\.csv(/|$)"
    tagged = raw.withColumns(
        {
            "year": F.regexp_extract(file, pattern, 1).cast("int"),
            "country": F.regexp_extract(file, pattern, 2),
        }
    )
    return select_detections(tagged, None, start, end)


def write_by_country(df, path: str, country="_source_country", extra=()) -> None:
    """One folder per country (and extra partition columns) from one pass.

    Rows are first spread by country and a hash slice, so a country holding most
    of the rows is written by many tasks instead of one.
    """
    spread = df.repartition(country, F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    spread.write.mode("overwrite").partitionBy(country, *extra).parquet(path)


def narrow_types(df: DataFrame) -> DataFrame:
    """float64 -> float32 and int64 -> int32 for the sink."""
    to = {"double": "float", "bigint": "int"}
    return df.select(*[F.col(c).cast(to.get(t, t)).alias(c) for c, t in df.dtypes])
