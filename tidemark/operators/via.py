"""Borrowed event time: outer join with a guard against keys that the lookup holds twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Via


class JoinNotUnique(ValueError):
    """The lookup holds a key more than once."""


def guarded_lookup(lookup: DataFrame, via: Via) -> DataFrame:
    """Lookup rows with _dup (rows of their key) and _first (1 for one of them); keys are renamed first, so the join reuses the shuffle."""
    keys = [f"_k{i}" for i in range(len(via.on))]
    narrow = lookup.select(*(F.col(c).alias(k) for k, (_, c) in zip(keys, via.on)), F.col(via.column).alias("_event"))
    w = Window.partitionBy(*keys)
    return narrow.select("*", F.count(F.lit(1)).over(w).alias("_dup"), F.row_number().over(w.orderBy(*keys)).alias("_first"), F.lit(1).alias("_matched"))


def via_join(base: DataFrame, lookup: DataFrame, via: Via, every: bool = True) -> DataFrame:
    """Every base row, and with every, each lookup row: base rows alone are unmatched, lookup rows alone only serve the guard.

    Without every (where assert_unique has passed over all keys) the join is a left one, which can be broadcast, and whose
    skewed keys, null ones of the base among them, are split at run time; lookup rows of null keys match nothing and stay
    out of the shuffle.
    """
    if not every:
        lookup = lookup.dropna(subset=[c for _, c in via.on])
    right = guarded_lookup(lookup, via)
    on = [base[b] == right[f"_k{i}"] for i, (b, _) in enumerate(via.on)]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return base.withColumn("_base", F.lit(1)).join(right, condition, "full_outer" if every else "left_outer")


def duplicated_keys(lookup: DataFrame, via: Via) -> DataFrame:
    """Keys that the lookup holds more than once; null keys are one group."""
    keys = [c for _, c in via.on]
    return lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def assert_unique(lookup: DataFrame, via: Via) -> None:
    """Cheap guard before the join, whichever keys the base uses."""
    if duplicated_keys(lookup, via).head(1):
        raise JoinNotUnique(via.table)
