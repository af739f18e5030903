"""Queries on fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.packed import unpack
from lodestone.tables import table

FIELDS = ("s_aliases", "o_aliases", "possible_answers")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "popqa_raw_sample")
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("packed")) for f in FIELDS])).alias("x")
    fields = rows.select(F.col("line_no").alias("key"), packed).select("key", "x.field", "x.packed")
    return unpack(fields).withColumnRenamed("key", "line_no")


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
