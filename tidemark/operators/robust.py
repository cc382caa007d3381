"""Robust statistics, as aggregates and as driver-side scalars of bounded results."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scale of the median absolute deviation, and least relative dispersion (fixed values of the method).
MAD_SCALE, FLOOR_SHARE = 1.4826, 0.05


def mad(values: list[float]) -> float:
    middle = statistics.median(values)
    return statistics.median(abs(v - middle) for v in values)


def robust_sigma(values: list[float]) -> float:
    return MAD_SCALE * mad(values)


def floored_sigma(values: list[float]) -> float:
    return max(robust_sigma(values), FLOOR_SHARE * abs(statistics.median(values)))


def recommended_wait(days: list[float]) -> int:
    return math.ceil(statistics.fmean(days) + 2 * statistics.pstdev(days))


def median_and_sigma(df: DataFrame, value: str) -> DataFrame:
    """One row: median, mad, floored sigma and count of a column, by two aggregates."""
    middle = df.agg(F.median(value).alias("median"), F.count(value).alias("n"))
    spread = df.crossJoin(F.broadcast(middle)).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.first("n").alias("n"))
    return spread.select("median", "mad", F.greatest(F.lit(MAD_SCALE) * F.col("mad"), F.lit(FLOOR_SHARE) * F.abs("median")).alias("sigma"), "n")


def percentile_summary(days: DataFrame, least: int) -> DataFrame:
    """(pct, mean, std, wait) over months; null where a month is over the cap or months are fewer than least."""
    g = days.groupBy("pct").agg(F.avg("days").alias("mean"), F.stddev_pop("days").alias("std"), F.max("over_cap").alias("over"), F.count(F.lit(1)).alias("months"))
    good = ~F.col("over") & (F.col("months") >= least)
    return g.select("pct", F.when(good, F.col("mean")).alias("mean"), F.when(good, F.col("std")).alias("std"), F.when(good, F.ceil(F.col("mean") + 2 * F.col("std"))).cast("long").alias("wait"))


def fill_band(forecast: float, share: float, sigma: float, mads: float) -> tuple[float, float]:
    """Expected rows so far, and its tolerance on both sides."""
    return forecast * share - mads * share * sigma, forecast * share + mads * share * sigma
