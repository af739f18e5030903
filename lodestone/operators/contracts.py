"""Checks of records against what they promise, as rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, error) for each check that a row fails; a check that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(F.col(key), F.explode(failed).alias("error"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def unknown(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a key that is not there; nulls refer to nothing."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")
