"""Verdicts: checks, severities in order of precedence, reasons and exit codes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the verdict vocabulary: severities from worst to best, checks, and the severities of each reason.
SEVERITIES = ("RED", "AMBER", "INDETERMINATE", "INSUFFICIENT_HISTORY", "SKIPPED", "GREEN")
CHECKS = ("probe", "reconciliation", "uniqueness", "completion", "volume", "freshness", "batch", "dual_lag", "parity")
REASONS = {
    "missing_table": ("RED",),
    "optional_table_absent": ("SKIPPED",),
    "scan_budget_exceeded": ("RED",),
    "scan_budget_unverifiable": ("RED",),
    "result_cell_cap_exceeded": ("RED",),
    "join_not_unique": ("RED",),
    "reconciliation_mismatch": ("RED",),
    "negative_lag_excess": ("RED",),
    "insufficient_mature_months": ("INSUFFICIENT_HISTORY",),
    "percentile_over_cap": ("INSUFFICIENT_HISTORY",),
    "backtest_disagreement": ("INSUFFICIENT_HISTORY",),
    "duplicate_keys": ("RED",),
    "zero_row_month": ("RED",),
    "volume_gap": ("RED",),
    "volume_collapse": ("RED",),
    "volume_outlier": ("RED", "AMBER"),
    "arrival_deficit": ("AMBER",),
    "insufficient_epochs": ("INSUFFICIENT_HISTORY",),
    "stale_feed": ("RED", "AMBER"),
    "null_batch_ids": ("AMBER",),
    "parity_prereq_read_uncommitted": ("INDETERMINATE",),
    "parity_prereq_uniqueness": ("INDETERMINATE",),
    "parity_prereq_negative_lag": ("INDETERMINATE",),
    "parity_one_sided_month": ("RED",),
    "parity_mismatch": ("RED",),
}
STATUS_SCHEMA = "probe string, `check` string, severity string, reason string, detail string"


@dataclass(frozen=True)
class Status:
    """One verdict; a reason is given exactly where the severity is not GREEN."""

    check: str
    severity: str
    reason: str | None = None
    detail: str = ""

    def __post_init__(self) -> None:
        if self.check not in CHECKS or self.severity not in SEVERITIES:
            raise ValueError(f"unknown check or severity: {self.check}, {self.severity}")
        if (self.severity == "GREEN") != (self.reason is None):
            raise ValueError("a reason belongs to every severity but GREEN")
        if self.reason is not None and self.severity not in REASONS.get(self.reason, ()):
            raise ValueError(f"{self.reason} cannot be {self.severity}")


def green(check: str, detail: str = "") -> Status:
    return Status(check, "GREEN", None, detail)


def worst(severities: Iterable[str]) -> str:
    """The first in precedence; GREEN where there is none."""
    return min(severities, key=SEVERITIES.index, default="GREEN")


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(SEVERITIES)))
    return F.try_element_at(table, severity)


def worst_by(statuses: DataFrame, *keys: str) -> DataFrame:
    """Worst severity of each group of statuses."""
    names = F.array(*map(F.lit, SEVERITIES))
    return statuses.groupBy(*keys).agg(F.element_at(names, F.min(severity_rank(F.col("severity"))) + 1).alias("severity"))


def exit_code(statuses: Iterable[Status], failed: bool = False) -> int:
    """1 after an execution error, else 2 with any RED, else 0."""
    return 1 if failed else 2 if any(s.severity == "RED" for s in statuses) else 0
