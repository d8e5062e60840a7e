"""The six fixture views over the driver's tables, as text valid in both engines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_KEY = (
    "CONCAT_WS(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), "
    "CAST(CAST(l_shipdate AS DATE) AS STRING), CAST(CAST(l_quantity AS INT) AS STRING))"
)

# view -> (source table, select list, tail)
_VIEWS = {
    "detections": (
        "lineitem",
        [
            f"{_ROW_KEY} AS detection_id",
            "CONCAT('C', CAST(l_suppkey % 5 AS STRING)) AS country",
            "50.0E0 + CAST(l_suppkey % 20 AS DOUBLE)/10 + CAST(l_partkey % 7 AS DOUBLE)*0.013E0"
            " AS latitude",
            "100.0E0 + CAST(l_partkey % 25 AS DOUBLE)/10 + CAST(l_orderkey % 7 AS DOUBLE)*0.013E0"
            " AS longitude",
            "CAST(l_shipdate AS DATE) AS acq_date",
            "300.0E0 + l_quantity*3 AS brightness",
            "CAST(l_orderkey % 101 AS DOUBLE) AS confidence",
        ],
        "",
    ),
    "predictions": (
        "lineitem",
        [
            f"{_ROW_KEY} AS row_id",
            "CAST(l_shipdate AS DATE) AS date",
            "CONCAT('C', CAST(l_suppkey % 5 AS STRING)) AS country",
            "500 + l_suppkey % 20 AS lat_key",
            "1000 + l_partkey % 25 AS lon_key",
            "CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS is_fire",
            "l_quantity AS eval_weight",
            "(CAST((l_orderkey*7919 + l_linenumber*104729) % 9973 AS DOUBLE)+0.5E0)/9973 AS prob_raw",
            "CONCAT('m', CAST(l_linenumber % 2 AS STRING)) AS model_name",
        ],
        "",
    ),
    "raster": (
        "part",
        [
            "CAST(FLOOR(p_partkey/50) AS INT) AS r",
            "CAST(p_partkey % 50 AS INT) AS c",
            "p_retailprice AS v",
            "CASE WHEN p_size<=3 THEN 1 ELSE 0 END AS src",
        ],
        "",
    ),
    "polygons": (
        "nation",
        [
            "n_nationkey",
            "n_name",
            "100.3E0 + CAST(n_nationkey % 5 AS DOUBLE)*0.6E0 AS cx",
            "50.2E0 + FLOOR(CAST(n_nationkey AS DOUBLE)/5)*0.45E0 AS cy",
            "0.3003E0 AS hx",
            "0.2507E0 AS hy",
        ],
        "",
    ),
    "regions": (
        "region",
        [
            "r_regionkey",
            "r_name",
            "500 + 4*r_regionkey AS lat_min",
            "507 + 4*r_regionkey AS lat_max",
            "1000 + 3*r_regionkey AS lon_min",
            "1012 + 3*r_regionkey AS lon_max",
        ],
        "",
    ),
}

SQL = {
    name: f"SELECT {', '.join(cols)} FROM {table}{tail}"
    for name, (table, cols, tail) in _VIEWS.items()
}
SQL["cube"] = (
    "SELECT CAST(l_shipdate AS DATE) AS date, 500 + l_suppkey % 20 AS lat_key, "
    "1000 + 5*(l_partkey % 5) AS lon_key, SUM(l_quantity) AS v FROM lineitem GROUP BY 1,2,3"
)


class Tables:
    """The driver's tables and the fixture views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        table, cols, _ = _VIEWS[name]
        return self.table(table).selectExpr(*cols)

    @cached_property
    def detections(self) -> DataFrame:
        return self._view("detections")

    @cached_property
    def predictions(self) -> DataFrame:
        return self._view("predictions")

    @cached_property
    def raster(self) -> DataFrame:
        return self._view("raster")

    @cached_property
    def regions(self) -> DataFrame:
        return self._view("regions")

    @cached_property
    def cube(self) -> DataFrame:
        return (
            self.table("lineitem")
            .selectExpr(
                "CAST(l_shipdate AS DATE) AS date",
                "500 + l_suppkey % 20 AS lat_key",
                "1000 + 5*(l_partkey % 5) AS lon_key",
                "l_quantity",
            )
            .groupBy("date", "lat_key", "lon_key")
            .agg(F.sum("l_quantity").alias("v"))
        )

    @cached_property
    def polygons(self) -> DataFrame:
        """Diamonds with their closed ring as an array of (x, y) structs."""
        p = self._view("polygons")

        def vertex(x, y):
            return F.struct(x.alias("x"), y.alias("y"))

        cx, cy, hx, hy = (F.col(c) for c in ("cx", "cy", "hx", "hy"))
        ring = F.array(
            vertex(cx + hx, cy), vertex(cx, cy + hy), vertex(cx - hx, cy), vertex(cx, cy - hy),
            vertex(cx + hx, cy),
        )
        return p.withColumn("ring", ring)
