"""Running totals that gather no whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total_before(rows: DataFrame, keys: list[str], order: list[str], value: str, bucket: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows before each within ``keys``, by ``order``.

    ``bucket`` must not fall as ``order`` rises. Rows are windowed within a bucket; only the buckets' sums are summed over a
    whole key. Null values count as nothing.
    """
    sums = rows.groupBy(*keys, bucket).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(sums, [*keys, bucket]).withColumn("before", F.col("_base") + F.col("_own")).drop("_base", "_own")
