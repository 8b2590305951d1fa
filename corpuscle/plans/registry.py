"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows where there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    """A few literal rows that both engines read alike."""

    def __init__(self, schema: str, *rows: Sequence[Any]):
        self.schema, self.rows = schema, [tuple(r) for r in rows]
        self.fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @staticmethod
    def _literal(value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (list, tuple)):
            return "[" + ", ".join(map(Fixture._literal, value)) + "]"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)

    @property
    def sql(self) -> str:
        names = ", ".join(n for n, _ in self.fields)
        casts = ", ".join(f"CAST({n} AS {_TYPES[t]}) AS {n}" for n, t in self.fields)
        return f"(SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(self._literal, r)) + ')' for r in self.rows)}) AS f({names}))"
