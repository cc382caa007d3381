"""Grouping-set cells of the canonical and dual passes, and the global row that exists even for an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the grouping columns and the ids that follow (fixed values of the result format).
WEIGHTS = {"event_month": 16, "lag_day": 8, "load_epoch": 4, "batch_id": 2, "alt_value": 1}
MONTH_LAG, EPOCH, MONTH_BATCH, ALT, GLOBAL = 7, 27, 13, 30, 31
SETS = {MONTH_LAG: ("event_month", "lag_day"), EPOCH: ("load_epoch",), MONTH_BATCH: ("event_month", "batch_id"), ALT: ("alt_value",)}
DUAL_WEIGHTS = {"event_month": 4, "src_lag_day": 2, "delta_day": 1}
DUAL_MONTH_LAG, DUAL_DELTA, DUAL_GLOBAL = 1, 6, 7
DUAL_SETS = {DUAL_MONTH_LAG: ("event_month", "src_lag_day"), DUAL_DELTA: ("delta_day",)}

MEASURES = {
    "row_count": "is_base_row",
    "n_eligible": "is_eligible",
    "n_null_event_time": "is_null_event_time",
    "n_null_load_time_only": "is_null_load_time_only",
    "n_negative_lag_excluded": "is_negative_lag_excluded",
    "n_negative_clipped": "is_negative_clipped",
    "n_overflow": "is_overflow",
    "n_join_unmatched": "is_join_unmatched",
    "n_compare_mismatch": "is_compare_mismatch",
    "n_base_rows": "is_base_once",
    "n_ambiguous_rows": "is_ambiguous",
}
DUAL_MEASURES = {"row_count": "is_base_row", "n_eligible": "is_eligible", "n_null_event_time": "is_null_event_time", "n_null_source_only": "is_null_source_only", "n_negative_lag_excluded": "is_negative_lag_excluded", "n_negative_clipped": "is_negative_clipped", "n_overflow": "is_overflow"}


class CellCapExceeded(ValueError):
    """A grouping set has more cells than the cap allows."""


def total(flag: str) -> Column:
    return F.coalesce(F.sum(flag), F.lit(0)).cast("long")


def measures(names: dict[str, str], dual: bool = False) -> list[Column]:
    rest = [F.max("lookup_dup").alias("lookup_dup_max")]
    if not dual:
        rest += [F.min("load_time").alias("min_load_time"), F.count(F.lit(1)).alias("n_staged_rows")]
    return [*(total(flag).alias(name) for name, flag in names.items()), *rest]


def _sets(staged: DataFrame, sets: dict[int, tuple[str, ...]], weights: dict[str, int], names: dict[str, str], dual: bool) -> DataFrame:
    """All sets in one scan (one Expand, partial and final aggregation); cells of guard rows alone are dropped."""
    used = [c for c in weights if any(c in s for s in sets.values())]
    free = sum(w for c, w in weights.items() if c not in used)
    grouping = sum((F.grouping(c).cast("int") * weights[c] for c in used), F.lit(free))
    cells = staged.groupingSets([[F.col(c) for c in s] for s in sets.values()], *(F.col(c) for c in used))
    out = cells.agg(grouping.alias("grouping_id"), *measures(names, dual)).where("row_count > 0")
    types = {c: staged.schema[c].dataType for c in weights}
    return out.select("grouping_id", *((F.col(c) if c in used else F.lit(None)).cast(types[c]).alias(c) for c in weights), *names, "lookup_dup_max", *([] if dual else ["min_load_time", "n_staged_rows"]))


def canonical_cells(staged: DataFrame, batch: bool = False, alt: bool = False) -> DataFrame:
    """Cells of (month, lag), (epoch) and, where configured, (month, batch) and (alt)."""
    wanted = [MONTH_LAG, EPOCH, *([MONTH_BATCH] if batch else []), *([ALT] if alt else [])]
    return _sets(staged, {i: SETS[i] for i in wanted}, WEIGHTS, MEASURES, False)


def dual_cells(staged: DataFrame) -> DataFrame:
    return _sets(staged, DUAL_SETS, DUAL_WEIGHTS, DUAL_MEASURES, True)


def _global(staged: DataFrame, weights: dict[str, int], names: dict[str, str], gid: int, dual: bool) -> DataFrame:
    out = staged.agg(*measures(names, dual))
    return out.select(F.lit(gid).alias("grouping_id"), *(F.lit(None).cast(staged.schema[c].dataType).alias(c) for c in weights), *names, "lookup_dup_max", *([] if dual else ["min_load_time", "n_staged_rows"]))


def global_row(staged: DataFrame) -> DataFrame:
    """One row over all, zeros for an empty table: an ungrouped aggregate, as grouping sets give none there."""
    return _global(staged, WEIGHTS, MEASURES, GLOBAL, False)


def dual_global_row(staged: DataFrame) -> DataFrame:
    return _global(staged, DUAL_WEIGHTS, DUAL_MEASURES, DUAL_GLOBAL, True)


def derived_global_row(cells: DataFrame, gid: int = MONTH_LAG, to: int = GLOBAL) -> DataFrame:
    """The global row as the sum of one partition of all rows; exact, and no second scan once the cells are kept."""
    skip = {"grouping_id", "lookup_dup_max", "min_load_time", *WEIGHTS, *DUAL_WEIGHTS}
    part = cells.where(F.col("grouping_id") == gid)
    out = part.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in cells.columns if c not in skip), *(f(c).alias(c) for c, f in (("lookup_dup_max", F.max), ("min_load_time", F.min)) if c in cells.columns))
    keys = [c for c in cells.columns if c in {*WEIGHTS, *DUAL_WEIGHTS}]
    return out.select(*((F.lit(to) if c == "grouping_id" else F.lit(None).cast(cells.schema[c].dataType) if c in keys else F.col(c)).alias(c) for c in cells.columns))


def distinct_keys(staged: DataFrame) -> DataFrame:
    """Exact number of distinct keys, nulls counted as values; kept out of the grouping sets, which would shuffle every row once a set."""
    return staged.where("is_base_row = 1").agg(F.countDistinct("key").cast("long").alias("distinct_keys"))


def with_global(cells: DataFrame, gid: int = MONTH_LAG, to: int = GLOBAL) -> DataFrame:
    """The cells and the global row, in one plan that holds them once: cells of one partition of all rows count twice.

    A row of zeros stands for the global one, so that it is there for an empty table.
    """
    keys = [c for c in cells.columns if c in {*WEIGHTS, *DUAL_WEIGHTS}]
    rest = {c: f for c, f in (("lookup_dup_max", F.max), ("min_load_time", F.min)) if c in cells.columns}
    sums = [c for c in cells.columns if c not in {"grouping_id", *keys, *rest}]
    types = {f.name: f.dataType for f in cells.schema}
    now = F.col("grouping_id")
    twice = cells.withColumn("grouping_id", F.explode(F.when(now == gid, F.array(now, F.lit(to).cast(types["grouping_id"]))).otherwise(F.array(now))))
    twice = twice.withColumns({c: F.when(now != to, F.col(c)) for c in keys})
    seed = cells.sparkSession.range(1).select(*(F.lit(to if c == "grouping_id" else 0 if c in sums else None).cast(types[c]).alias(c) for c in cells.columns))
    out = twice.unionByName(seed).groupBy("grouping_id", *keys).agg(*(F.sum(c).alias(c) for c in sums), *(f(c).alias(c) for c, f in rest.items()))
    return out.select(cells.columns)


def canonical_pass(staged: DataFrame, batch: bool = False, alt: bool = False) -> DataFrame:
    """Cells of all sets and the global row, from one scan."""
    return with_global(canonical_cells(staged, batch, alt)).orderBy("grouping_id")


def dual_pass(staged: DataFrame) -> DataFrame:
    return with_global(dual_cells(staged), DUAL_MONTH_LAG, DUAL_GLOBAL).orderBy("grouping_id")


def result_cells(cells: DataFrame) -> DataFrame:
    """Cells without those of a null month or epoch; sets by alt value and the global row keep theirs."""
    gid = F.col("grouping_id")
    return cells.where(gid.isin(ALT, GLOBAL) | (gid.isin(MONTH_LAG, MONTH_BATCH) & F.col("event_month").isNotNull()) | ((gid == EPOCH) & F.col("load_epoch").isNotNull()))


def assessed_cells(cells: DataFrame) -> DataFrame:
    """result_cells, and the cells of every batch: one that came first with rows of no month came then all the same."""
    gid = F.col("grouping_id")
    kept = gid.isin(ALT, GLOBAL) | ((gid == MONTH_LAG) & F.col("event_month").isNotNull()) | ((gid == EPOCH) & F.col("load_epoch").isNotNull())
    return cells.where(kept | ((gid == MONTH_BATCH) & (F.col("event_month").isNotNull() | F.col("batch_id").isNotNull())))


def dual_result_cells(cells: DataFrame) -> DataFrame:
    gid = F.col("grouping_id")
    return cells.where((gid == DUAL_GLOBAL) | ((gid == DUAL_MONTH_LAG) & F.col("event_month").isNotNull()) | ((gid == DUAL_DELTA) & F.col("delta_day").isNotNull()))


def bounded(cells: DataFrame, cap: int) -> DataFrame:
    """The cells with a bound on their number that no set within its cap reaches, so a result can never grow beyond it."""
    return cells.limit(cap * (len(SETS) + 1) + 1)


def check_cap(cells: DataFrame, cap: int) -> None:
    """Raise where a set has more cells than cap, before anything reaches the driver."""
    over = cells.groupBy("grouping_id").count().where(F.col("count") > cap).head(1)
    if over:
        raise CellCapExceeded(f"set {over[0]['grouping_id']}: {over[0]['count']} cells, cap {cap}")
