"""The narrow projection: admission, row classes and grouping keys of every admitted row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Probe
from tidemark.functions.times import day_difference, extraction_start, month_floor, time_bucket, timestamp

#: Lag of rows that are excluded as too early (a fixed value).
EXCLUDED_LAG = -1
FLAGS = ("is_join_unmatched", "is_null_event_time", "is_null_load_time_only", "is_negative_lag_excluded", "is_eligible", "is_negative_clipped", "is_overflow", "is_compare_mismatch", "is_ambiguous", "is_base_row")


def admitted(df: DataFrame, load_time: str, as_of: datetime) -> DataFrame:
    """Rows loaded by as_of, and rows without a load time; the filter reaches the scan."""
    load = F.col(load_time)
    return df.where((load <= timestamp(as_of)) | load.isNull())


def one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def key_of(columns: list[str]) -> Column:
    """One value for a key of several columns; nulls are values of their own."""
    return F.struct(*(F.col(c) for c in columns))


def key_hash(columns: list[str]) -> Column:
    """SHA-256 of an injective text of the key: type, length and value of each column, nulls marked."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.when(F.col(c).isNull(), F.lit("n;")).otherwise(F.concat(F.lit("v"), F.typeof(F.col(c)), F.lit(":"), F.length(text).cast("string"), F.lit(":"), text, F.lit(";"))))
    return F.sha2(F.concat(*parts), 256)


def classify(df: DataFrame, probe: Probe, as_of: datetime, event_time: str | None = None) -> DataFrame:
    """Flags, keys and probe columns; df is admitted base rows, or what the via join made of them (`_base`, `_matched`, `_first`, `_dup`)."""
    a = probe.analysis
    via = "_base" in df.columns
    base = F.col("_base").isNotNull() if via else F.lit(True)
    matched = F.col("_matched").isNotNull() if via else F.lit(True)
    event, load = F.col(event_time or probe.event_time), F.col(probe.load_time)
    if a.extraction_months is not None:
        df = df.where((event >= F.lit(extraction_start(as_of, a.extraction_months))) | event.isNull() | ~base)
    lag = day_difference(event, load)
    both = base & matched & event.isNotNull() & load.isNotNull()
    excluded = both & (lag < -a.clock_skew_tolerance_days)
    eligible = both & (lag >= -a.clock_skew_tolerance_days)
    compare = F.col(probe.compare_event_time) if probe.compare_event_time else None
    mismatch = F.lit(False) if compare is None else eligible & (compare.isNull() | (day_difference(compare, event) != 0))
    return df.select(
        one(base & ~matched).alias("is_join_unmatched"),
        one(base & matched & event.isNull()).alias("is_null_event_time"),
        one(base & matched & event.isNotNull() & load.isNull()).alias("is_null_load_time_only"),
        one(excluded).alias("is_negative_lag_excluded"),
        one(eligible).alias("is_eligible"),
        one(eligible & (lag < 0)).alias("is_negative_clipped"),
        one(eligible & (lag > a.lag_cap_days)).alias("is_overflow"),
        one(mismatch).alias("is_compare_mismatch"),
        one(base & matched & (F.col("_first") == 1) & (F.col("_dup") > 1) if via else F.lit(False)).alias("is_ambiguous"),
        one(base).alias("is_base_row"),
        (F.when(base & ~matched, 1).when(base & F.coalesce(F.col("_first") == 1, F.lit(False)), 1).otherwise(0) if via else F.lit(1)).alias("is_base_once"),
        (F.col("_dup").cast("long") if via else F.lit(None).cast("long")).alias("lookup_dup"),
        F.when(excluded | eligible, month_floor(event)).alias("event_month"),
        F.when(excluded, EXCLUDED_LAG).when(eligible & (lag > a.lag_cap_days), a.lag_cap_days + 1).when(eligible & (lag < 0), 0).when(eligible, lag).cast("int").alias("lag_day"),
        F.when(base, time_bucket(load, a.freshness_bucket)).alias("load_epoch"),
        F.when(base & load.isNotNull(), F.col(probe.batch_col).cast("string") if probe.batch_col else None).alias("batch_id"),
        F.when(base, F.col(probe.alt_col).cast("string") if probe.alt_col else None).alias("alt_value"),
        F.when(base, load).alias("load_time"),
        (F.when(base, key_of(list(probe.key_cols))) if probe.key_cols else F.lit(None).cast("string")).alias("key"),
    )


def staging(base: DataFrame, probe: Probe, as_of: datetime, lookup: DataFrame | None = None, every: bool = True) -> DataFrame:
    """The projection of a probe: admission below the via join, classes above it; every as in via_join."""
    from tidemark.operators.via import via_join

    rows = admitted(base.select(*probe.columns), probe.load_time, as_of)
    if probe.event_time_via is None:
        return classify(rows, probe, as_of)
    return classify(via_join(rows, lookup, probe.event_time_via, every), probe, as_of, "_event")


def dual_staging(base: DataFrame, probe: Probe, as_of: datetime, lookup: DataFrame | None = None, every: bool = True) -> DataFrame:
    """As staging for the lag from event to source insertion, with the days from there to load."""
    from tidemark.operators.via import via_join

    a = probe.analysis
    rows = admitted(base.select(*probe.columns), probe.load_time, as_of)
    if probe.event_time_via is not None:
        rows = via_join(rows, lookup, probe.event_time_via, every)
    via = probe.event_time_via is not None
    base_row = F.col("_base").isNotNull() if via else F.lit(True)
    event, source, load = F.col("_event" if via else probe.event_time), F.col(probe.source_insert_time), F.col(probe.load_time)
    if a.extraction_months is not None:
        rows = rows.where((event >= F.lit(extraction_start(as_of, a.extraction_months))) | event.isNull() | ~base_row)
    lag = day_difference(event, source)
    both = base_row & event.isNotNull() & source.isNotNull()
    excluded, eligible = both & (lag < -a.clock_skew_tolerance_days), both & (lag >= -a.clock_skew_tolerance_days)
    return rows.select(
        one(base_row & event.isNull()).alias("is_null_event_time"),
        one(base_row & event.isNotNull() & source.isNull()).alias("is_null_source_only"),
        one(excluded).alias("is_negative_lag_excluded"),
        one(eligible).alias("is_eligible"),
        one(eligible & (lag < 0)).alias("is_negative_clipped"),
        one(eligible & (lag > a.lag_cap_days)).alias("is_overflow"),
        one(base_row).alias("is_base_row"),
        (F.col("_dup").cast("long") if via else F.lit(None).cast("long")).alias("lookup_dup"),
        F.when(excluded | eligible, month_floor(event)).alias("event_month"),
        F.when(excluded, EXCLUDED_LAG).when(eligible & (lag > a.lag_cap_days), a.lag_cap_days + 1).when(eligible & (lag < 0), 0).when(eligible, lag).cast("int").alias("src_lag_day"),
        F.when(base_row & source.isNotNull() & load.isNotNull(), day_difference(source, load)).cast("int").alias("delta_day"),
    )
