"""Small literal tables that a plan and its SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(names: list[str], rows: list[tuple]) -> str:
    """(VALUES ...) AS t(names), for DuckDB."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ") AS t(" + ", ".join(names) + ")"


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)
