"""Measures of systems, judges and selective answering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.running import total_before
from lodestone.session import materialise, small_enough


def _share(x: Column, y: Column) -> Column:
    return F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))


def binary(rows: DataFrame, *by: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of ``predicted`` against ``actual`` (booleans), by the given columns.

    Rows with a null side are not counted; a ratio over nothing is 0.
    """
    rows = rows.where("predicted is not null and actual is not null")
    p, a = F.col("predicted"), F.col("actual")
    counts = rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    six = lambda x, n: F.round(x, 6).alias(n)
    return counts.select(*by, "tp", "tn", "fp", "fn", six(_share(tp + tn, tp + tn + fp + fn), "accuracy"), six(precision, "precision"), six(recall, "recall"), six(_share(2 * precision * recall, precision + recall), "f1"))


def medians(rows: DataFrame, by: str, value: str, buckets: int = 4_096) -> DataFrame:
    """(by, median) of the values that are not null; of an even number the mean of the middle two. Exact.

    Equal values are counted, and the counts summed within buckets of values first, so that no task holds all values of a key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("all"))
    placed = counts.join(ends, by).withColumn("bucket", F.coalesce(F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * buckets), F.lit(0).cast("long")))
    placed = total_before(placed, [by], ["v"], "n", "bucket")
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = placed.where(holds(low) | holds(high)).groupBy(by).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return middle.select(by, ((F.col("a") + F.col("b")) / 2).alias("median"))


def summary(runs: DataFrame, by: str = "system") -> DataFrame:
    """Counts, rates and latencies of each system. ``runs``: system, status, correct, unsupported, latency_ms, iterations."""
    n = F.count("*")
    rate = lambda c, name: F.round(F.count_if(c) / n, 6).alias(name)
    rows = runs.groupBy(by).agg(
        n.alias("questions"), F.count_if("correct").alias("correct"), rate(F.col("correct"), "accuracy"), rate(F.col("unsupported"), "unsupported_rate"),
        rate(F.col("status") == "unanswerable", "abstention_rate"), F.round(F.avg("iterations"), 6).alias("mean_iterations"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency"),
    )
    return rows.join(medians(runs, by, "latency_ms"), by, "left").select(*rows.columns, F.round("median", 6).alias("median_latency"))


def probability(sufficiency: Column, confidence: Column, w1: float = 2.5, w2: float = 1.5, b: float = -2.0) -> Column:
    z = F.lit(w1) * sufficiency + F.lit(w2) * confidence + F.lit(b)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-25.0), F.least(F.lit(25.0), z))))


def accuracy_coverage(records: DataFrame, thresholds: int = 50) -> DataFrame:
    """tau, attempted, correct, coverage, accuracy at each of ``thresholds`` + 1 thresholds. ``records``: p, correct.

    Each record is counted once into the highest threshold it passes; the sums over thresholds follow from those counts.
    Accuracy is 1 where nothing is attempted; without records there is no row.
    """
    # the floor of p * thresholds, corrected where floating point put it beside the threshold it meets
    guess = F.floor(F.col("p") * thresholds)
    top = F.when((guess + 1) / F.lit(float(thresholds)) <= F.col("p"), guess + 1).when(guess / F.lit(float(thresholds)) > F.col("p"), guess - 1).otherwise(guess)
    counts = records.groupBy(top.cast("long").alias("i")).agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    grid = records.sparkSession.range(thresholds + 1).withColumnRenamed("id", "i")
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the thresholds only
    rows = grid.join(counts, "i", "left").withColumn("attempted", F.coalesce(F.sum("n").over(down), F.lit(0))).withColumn("right", F.coalesce(F.sum("c").over(down), F.lit(0)))
    total = records.agg(F.count("*").alias("total")).where("total > 0")
    return rows.join(F.broadcast(total)).select((F.col("i") / F.lit(float(thresholds))).alias("tau"), "attempted", F.col("right").alias("correct"), (F.col("attempted") / F.col("total")).alias("coverage"), F.coalesce(F.col("right") / F.nullif("attempted", F.lit(0)), F.lit(1.0)).alias("accuracy"), "total")


def area(curve: DataFrame) -> DataFrame:
    """One row: area under the curve by trapezoids over coverage, the best coverage at 90 and at 95 percent accuracy, and
    what answering only at tau 0.5 gains in accuracy."""
    order = Window.orderBy("coverage", "tau")  # over the thresholds only
    steps = curve.withColumn("next_c", F.lead("coverage").over(order)).withColumn("next_a", F.lead("accuracy").over(order))
    at = lambda a: F.coalesce(F.max(F.when(F.col("accuracy") >= a, F.col("coverage"))), F.lit(0.0))
    gain = F.max(F.when(F.col("tau") == 0.5, F.col("accuracy"))) - F.max(F.when(F.col("tau") == 0.0, F.col("accuracy")))
    return steps.agg(
        F.round(F.coalesce(F.sum((F.col("accuracy") + F.col("next_a")) / 2 * (F.col("next_c") - F.col("coverage"))), F.lit(0.0)), 6).alias("auacc"),
        F.round(at(0.9), 6).alias("coverage_90"), F.round(at(0.95), 6).alias("coverage_95"), F.round(gain, 6).alias("rejection_quality"),
    )


def fit_selective(records: DataFrame, epochs: int = 250, rate: float = 0.1, most: int = 100_000) -> tuple[float, float, float]:
    """Weights of ``probability`` by gradient descent over all records (sufficiency, confidence, correct).

    Equal records are counted, not kept. Up to ``most`` distinct ones (a grid of two coarse scores) are fitted on the driver; of
    more, Spark sums the gradient in every epoch.
    """
    counted = materialise(records.groupBy("sufficiency", "confidence", "correct").count(), "scores")
    few = small_enough(counted, most)
    rows = counted.collect() if few else []
    w1, w2, b, n = 2.5, 1.5, -2.0, counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    for _ in range(epochs if n else 0):
        g1 = g2 = g0 = 0.0
        for r in rows:
            z = max(-25.0, min(25.0, w1 * r.sufficiency + w2 * r.confidence + b))
            e = (1 / (1 + math.exp(-z)) - float(r.correct)) * r["count"]
            g1, g2, g0 = g1 + e * r.sufficiency, g2 + e * r.confidence, g0 + e
        if not few:
            e = (probability(F.col("sufficiency"), F.col("confidence"), w1, w2, b) - F.col("correct").cast("double")) * F.col("count")
            g1, g2, g0 = counted.agg(F.sum(e * F.col("sufficiency")), F.sum(e * F.col("confidence")), F.sum(e)).first()
        w1, w2, b = w1 - rate * g1 / n, w2 - rate * g2 / n, b - rate * g0 / n
    return w1, w2, b
