"""Registry: a query, the shape of its result, and the SQL giving the same rows."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.catalog import views
from cindergrid.session import shared_folder


@dataclass
class Entry:
    name: str
    shape: str
    build: Callable
    sql: str | None


ENTRIES: dict[str, Entry] = {}

_SPARK = {"i": "bigint", "t": "date", "b": "boolean", "s": "string"}
_DUCK = {"i": "BIGINT", "t": "DATE", "b": "BOOLEAN", "s": "VARCHAR"}


def _fields(shape: str):
    for item in shape.split():
        name, _, kind = item.partition(":")
        yield name, kind or "s"


def _spark_column(name, kind):
    c = F.col(name)
    if kind.startswith("d"):
        # adding 0.0 turns -0.0 into 0.0
        return (F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)).alias(name)
    return c.cast(_SPARK[kind]).alias(name)


def _duck_column(name, kind):
    if kind.startswith("d"):
        return f'ROUND(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + 0.0E0 AS "{name}"'
    return f'CAST("{name}" AS {_DUCK[kind]}) AS "{name}"'


def query(name: str, shape: str, sql: str | None = None, uses: str = ""):
    """Register a query. `uses` lists the fixture views its SQL needs."""

    def register(build):
        text = None
        if sql is not None:
            body = sql.strip()
            ctes = [f"{v} AS ({views.SQL[v]})" for v in uses.split()]
            if body[:6].upper() == "SELECT":
                inner = f"WITH {', '.join(ctes)} {body}" if ctes else body
            else:
                inner = "WITH " + ", ".join([*ctes, body])
            cols = ", ".join(_duck_column(n, k) for n, k in _fields(shape))
            text = f"SELECT {cols} FROM ({inner}) AS q"
        ENTRIES[name] = Entry(name, shape, build, text)
        return build

    return register


def run(entry: Entry, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entry.build(views.Tables(spark, sf_dir))
    return out.select(*[_spark_column(n, k) for n, k in _fields(entry.shape)])


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/{label}-{os.urandom(6).hex()}"
