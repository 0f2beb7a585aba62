"""Robust statistics: skew of a page from its lines, medians, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lines needed, spread kept around the quartiles, angle under which a page is straight.
LEAST_LINES, LEAST_STRIPS, SPREAD, DEADBAND = 6, 4, 1.5, 0.55


def folded_angle(angle):
    """Angle of a text line from that of any line: steep ones are turned by 90 degrees, others beyond 30 are dropped."""
    return F.when(F.abs(angle) <= 30, angle).when(angle >= 60, angle - 90).when(angle <= -60, angle + 90)


def weighted_median_angle(lines: DataFrame, key: str, angle: str, weight: str) -> DataFrame:
    """(key, skew): weighted median of the angles within 1.5 quartile ranges, 0 below the deadband; keys with 6 lines or more."""
    rows = lines.where(F.col(angle).isNotNull() & (F.col(weight) > 0)).select(key, F.col(angle).alias("a"), F.col(weight).alias("w"))
    q = rows.groupBy(key).agg(F.percentile("a", 0.25).alias("q1"), F.percentile("a", 0.75).alias("q3"), F.count("*").alias("n")).where(F.col("n") >= LEAST_LINES)
    room = (F.col("q3") - F.col("q1")) * SPREAD
    kept = rows.join(q, key).where((F.col("a") >= F.col("q1") - room) & (F.col("a") <= F.col("q3") + room))
    run = Window.partitionBy(key).orderBy("a").rangeBetween(Window.unboundedPreceding, 0)
    summed = kept.select(key, "a", F.sum("w").over(run).alias("up_to"), F.sum("w").over(Window.partitionBy(key)).alias("total"))
    median = summed.where(F.col("up_to") >= F.col("total") / 2).groupBy(key).agg(F.min("a").alias("m"))
    return median.select(key, F.round(F.when(F.abs("m") < DEADBAND, 0.0).otherwise(F.col("m")), 6).alias("skew"))


def median_angle(strips: DataFrame, key: str, angle: str, least: int = LEAST_STRIPS) -> DataFrame:
    """(key, skew): plain median of the angles, 0 below the deadband; keys with `least` strips or more."""
    median = strips.where(F.col(angle).isNotNull()).groupBy(key).agg(F.percentile(angle, 0.5).alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    return median.select(key, F.round(F.when(F.abs("m") < DEADBAND, 0.0).otherwise(F.col("m")), 6).alias("skew"))


def best_so_far(metrics: DataFrame, run: str, step: str, accuracy: str, loss: str) -> DataFrame:
    """metrics with best_accuracy and least_loss up to each step, and is_best where a step equals or betters the one or lowers the other."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    first = F.max(accuracy).over(before).isNull()
    return metrics.select(
        "*", F.max(accuracy).over(upto).alias("best_accuracy"), F.min(loss).over(upto).alias("least_loss"),
        (first | (F.col(accuracy) >= F.max(accuracy).over(before)) | (F.col(loss) < F.min(loss).over(before))).alias("is_best"),
    )
