"""Cumulative completion curves by month, their percentiles and pointwise statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PERCENTS


def curve_cells(cells: DataFrame, lag: str = "lag_day") -> DataFrame:
    """(event_month, lag_day, rows) of cells that count for curves: the excluded lag does not."""
    return cells.where(F.col("event_month").isNotNull() & (F.col(lag) >= 0)).groupBy("event_month", F.col(lag).alias("lag_day")).agg(F.sum("row_count").alias("rows"))


def cumulative(curve: DataFrame) -> DataFrame:
    """Share of a month's final count that had arrived by each lag."""
    w = Window.partitionBy("event_month")
    upto = w.orderBy("lag_day").rowsBetween(Window.unboundedPreceding, 0)
    return curve.select("event_month", "lag_day", "rows", (F.sum("rows").over(upto) / F.sum("rows").over(w)).alias("cum_frac"))


def days_to_percent(curves: DataFrame, cap: int, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Smallest lag at which each percentage had arrived; over_cap, and no days, where it had not by the cap."""
    rows = curves.select("event_month", "lag_day", "cum_frac", F.explode(F.array(*map(F.lit, percents))).alias("pct"))
    reached = rows.groupBy("event_month", "pct").agg(
        F.min(F.when((F.col("cum_frac") >= F.col("pct") / 100) & (F.col("lag_day") <= cap), F.col("lag_day"))).alias("days"),
    )
    return reached.select("event_month", "pct", "days", F.col("days").isNull().alias("over_cap"))


def on_grid(curves: DataFrame, last: int) -> DataFrame:
    """Each month's curve at every day from 0 to last: the latest value, 0 before the first."""
    months = curves.select("event_month").distinct()
    days = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("day")
    grid = months.select("event_month", days)
    joined = grid.join(curves.select("event_month", F.col("lag_day").alias("day"), "cum_frac"), ["event_month", "day"], "left")
    w = Window.partitionBy("event_month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("event_month", "day", F.coalesce(F.last("cum_frac", ignorenulls=True).over(w), F.lit(0.0)).alias("frac"))


def median_curve(grid: DataFrame) -> DataFrame:
    """Pointwise median of months."""
    return grid.groupBy("day").agg(F.median("frac").alias("frac"))


def quantile_bands(grid: DataFrame) -> DataFrame:
    """Pointwise 10th, 50th and 90th percentile of months, interpolated."""
    return grid.groupBy("day").agg(F.percentile("frac", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).select("day", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def lag_week_shares(curve: DataFrame) -> DataFrame:
    """Share of each month's rows by lag week, in long form."""
    weeks = curve.groupBy("event_month", F.floor(F.col("lag_day") / 7).cast("int").alias("lag_week")).agg(F.sum("rows").alias("rows"))
    return weeks.select("event_month", "lag_week", (F.col("rows") / F.sum("rows").over(Window.partitionBy("event_month"))).alias("share"))
