"""Metric datasets as plans over cells: each takes and gives a DataFrame, nothing is collected."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PERCENTS
from tidemark.functions.times import elapsed_days, month_end, timestamp
from tidemark.operators.cells import MONTH_BATCH, MONTH_LAG
from tidemark.operators.robust import MAD_SCALE, median_and_sigma

#: Counts below this are hidden where small counts are (a fixed value).
SMALL = 5


def ended(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Months whose end is so many days old."""
    return df.where(month_end(F.col("event_month")).cast("timestamp_ntz") <= timestamp(as_of - timedelta(days=days)))


def month_volumes(cells: DataFrame) -> DataFrame:
    return cells.where("lag_day >= 0").groupBy("event_month").agg(F.sum("row_count").alias("volume"))


def month_counts(staged: DataFrame) -> DataFrame:
    """Rows of each month, those of the excluded lag included."""
    return staged.where("event_month is not null").groupBy("event_month").agg(F.count(F.lit(1)).alias("n"))


def with_state(volumes: DataFrame, as_of: datetime, days: int) -> DataFrame:
    end = month_end(F.col("event_month")).cast("timestamp_ntz")
    state = F.when(end > timestamp(as_of), "open").when(end <= timestamp(as_of - timedelta(days=days)), "mature").otherwise("immature")
    return volumes.select("event_month", "volume", state.alias("state"))


def _wait() -> list:
    over = F.max("over_cap")
    return [F.when(~over, F.ceil(F.avg("days") + 2 * F.stddev_pop("days"))).cast("long").alias("wait"), F.count(F.lit(1)).alias("months")]


def training_wait(days: DataFrame) -> DataFrame:
    return days.where("pct = 95").agg(*_wait())


def backtest_halves(days: DataFrame) -> DataFrame:
    """The wait of the older and the younger half of the training months; a window over months alone, of which there are few."""
    d = days.where("pct = 95")
    d = d.withColumn("r", F.row_number().over(Window.orderBy("event_month"))).crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))
    return d.groupBy(F.when(F.col("r") <= F.floor(F.col("n") / 2), "older").otherwise("younger").alias("half")).agg(*_wait())


def back_to(days: DataFrame, as_of: datetime) -> DataFrame:
    out = days.agg(*_wait()).select("wait")
    return out.select("wait", F.date_sub(timestamp(as_of).cast("date"), F.col("wait").cast("int")).alias("complete_back_to"))


def baseline(volumes: DataFrame, as_of: datetime, days: int, recent: int) -> DataFrame:
    """Median and floored sigma of mature months but the last observed ones."""
    w = Window.orderBy(F.col("event_month").desc())
    return median_and_sigma(ended(volumes.withColumn("r", F.row_number().over(w)).where(F.col("r") > recent), as_of, days), "volume")


def outliers(volumes: DataFrame, base: DataFrame, as_of: datetime, days: int, amber: float = 2.0, red: float = 3.0) -> DataFrame:
    d = ended(volumes, as_of, days).crossJoin(F.broadcast(base))
    off = F.abs(F.col("volume") - F.col("median"))
    return d.select("event_month", "volume", F.when(off > red * F.col("sigma"), "RED").when(off > amber * F.col("sigma"), "AMBER").otherwise("GREEN").alias("severity"))


def gaps(volumes: DataFrame) -> DataFrame:
    """Months between the first and the last that have no rows."""
    span = volumes.agg(F.min("event_month").alias("a"), F.max("event_month").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("event_month"))
    return every.join(volumes, "event_month", "left_anti")


def last_run_below(volumes: DataFrame, low: float) -> DataFrame:
    """The run of consecutive months below low that ends at the last month, by gaps and islands."""
    last = volumes.agg(F.max("event_month").alias("last"))
    place = F.year("event_month") * 12 + F.month("event_month")
    islands = volumes.where(F.col("volume") < low).withColumn("island", place - F.row_number().over(Window.orderBy("event_month")))
    runs = islands.groupBy("island").agg(F.min("event_month").alias("first_month"), F.max("event_month").alias("last_month"), F.count(F.lit(1)).alias("months"))
    return runs.join(F.broadcast(last), F.col("last_month") == F.col("last")).select("first_month", "last_month", "months")


def filling(volumes: DataFrame, curve: DataFrame, base: DataFrame, as_of: datetime, days: int, last: int) -> DataFrame:
    """Expected rows so far and nowcast of months that have ended but are not mature."""
    d = with_state(volumes, as_of, days).where("state = 'immature'")
    age = F.floor(elapsed_days(month_end(F.col("event_month")).cast("timestamp_ntz"), timestamp(as_of)))
    d = d.withColumn("day", F.least(F.greatest(age, F.lit(0)), F.lit(last)).cast("int"))
    d = d.join(curve, "day").crossJoin(F.broadcast(base))
    return d.select("event_month", "volume", (F.col("median") * F.col("frac")).alias("expected"), F.try_divide("volume", "frac").alias("nowcast"))


def cadence(epochs: DataFrame, column: str, as_of: datetime, tolerance: float = 1.0) -> DataFrame:
    """Usual days between epochs, their robust sigma, and the days since the last."""
    gap = elapsed_days(F.lag(column).over(Window.orderBy(column)), F.col(column))
    d = epochs.select(gap.alias("gap"), column)
    one = d.agg(F.median("gap").alias("cadence"), F.max(column).alias("last"), F.count(F.lit(1)).alias("epochs"))
    out = d.crossJoin(F.broadcast(one)).agg(F.first("cadence").alias("cadence"), F.greatest(F.lit(MAD_SCALE) * F.median(F.abs(F.col("gap") - F.col("cadence"))), F.lit(tolerance)).alias("sigma"), F.first("last").alias("last"), F.first("epochs").alias("epochs"))
    return out.select("cadence", "sigma", F.round(elapsed_days(F.col("last"), timestamp(as_of)), 6).alias("since"), "epochs")


def batch_runs(cells: DataFrame) -> DataFrame:
    """Rows and first load of each batch, from all its cells."""
    return cells.where("batch_id is not null").groupBy("batch_id").agg(F.sum("n_eligible").alias("rows"), F.min("min_load_time").alias("first_load"))


def runs_per_month(cells: DataFrame) -> DataFrame:
    """Batches of each month, those without an eligible row among them, and eligible rows of no batch."""
    d = cells.where("event_month is not null")
    return d.groupBy("event_month").agg(F.count("batch_id").alias("runs"), F.sum(F.when(F.col("batch_id").isNull(), F.col("n_eligible")).otherwise(0)).alias("null_batch_rows"))


def batch_completion(cells: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Days from a month's end to the batch with which each percentage had arrived; batches in order of time, then id.

    cells: those of (month, lag), which give a month's whole, and of (month, batch); a batch's time is the first of all its
    cells. The plan holds the cells once; all windows run over cells alone, whose number is capped.
    """
    ts = F.min("min_load_time").over(Window.partitionBy("batch_id"))
    volume = F.sum(F.when((F.col("grouping_id") == MONTH_LAG) & (F.col("lag_day") >= 0), F.col("row_count"))).over(Window.partitionBy("event_month"))
    d = cells.where(F.col("grouping_id").isin(MONTH_LAG, MONTH_BATCH)).withColumn("ts", ts).where("event_month is not null").withColumn("volume", volume)
    rows = d.where((F.col("grouping_id") == MONTH_BATCH) & F.col("batch_id").isNotNull() & (F.col("n_eligible") > 0))
    w = Window.partitionBy("event_month").orderBy("ts", "batch_id").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.select("event_month", "ts", (F.sum("n_eligible").over(w) / F.col("volume")).alias("share"))
    d = d.select("*", F.explode(F.array(*map(F.lit, percents))).alias("pct"))
    days = F.datediff(F.col("ts").cast("date"), month_end(F.col("event_month")))
    return d.groupBy("event_month", "pct").agg(F.min(F.when(F.col("share") >= F.col("pct") / 100, days)).alias("days"))


def parity(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Counts of both sides by month, one-sided months included."""
    d = left.withColumnRenamed("n", "left_count").join(right.withColumnRenamed("n", "right_count"), "event_month", "full_outer")
    diff = F.coalesce("left_count", F.lit(0)) - F.coalesce("right_count", F.lit(0))
    verdict = F.when(F.col("right_count").isNull(), "left_only").when(F.col("left_count").isNull(), "right_only").when(F.abs(diff) <= tolerance, "match").otherwise("mismatch")
    return d.select("event_month", "left_count", "right_count", diff.alias("diff"), verdict.alias("verdict"))


def reconciliation(world: DataFrame) -> DataFrame:
    classed = F.col("n_eligible") + F.col("n_null_event_time") + F.col("n_null_load_time_only") + F.col("n_negative_lag_excluded") + F.col("n_join_unmatched")
    return world.select("row_count", classed.alias("classed"), (F.col("row_count") - classed).alias("other"))


def negative_excess(world: DataFrame) -> DataFrame:
    rest = F.col("row_count") - F.col("n_null_event_time") - F.col("n_null_load_time_only") - F.col("n_join_unmatched")
    return world.select(F.coalesce(F.try_divide(F.col("n_negative_lag_excluded"), rest), F.lit(0.0)).alias("excess"))


def suppress(df: DataFrame, columns: list[str], least: int = SMALL) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(c) < least, None).otherwise(F.col(c)) for c in columns})


def in_window(df: DataFrame, start: str, end: str, column: str = "event_month") -> DataFrame:
    return df.where((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date")))


def probe_slice(df: DataFrame, probe: str) -> DataFrame:
    return df.where(F.col("probe") == probe)
