"""One probe: passes over the source, assessments of their cells, rows of the snapshot tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import PERCENTS, Probe
from tidemark.functions.times import extraction_start
from tidemark.operators import cells as C
from tidemark.operators import classify as K
from tidemark.operators.via import JoinNotUnique, duplicated_keys
from tidemark.plans import assess as A
from tidemark.sources.tables import column_types, read_table, table_exists
from tidemark.status import Status, exit_code

STATUS_VERSION = 2


@dataclass
class Result:
    """Verdicts and table rows of a probe; an aborted one has only statuses and its run."""

    probe: Probe
    statuses: list[Status]
    tables: dict[str, list[dict]] = field(default_factory=dict)
    side: A.Side | None = None


#: Times that a probe's passes may read its tables, together.
SCAN_BUDGET = 3


class ScanBudgetExceeded(ValueError):
    """The plans read the tables more often than the budget allows."""


def scans(*frames: DataFrame) -> int:
    """Table reads in the optimised plans."""
    return sum(f._jdf.queryExecution().optimizedPlan().collectLeaves().size() for f in frames)


class Ledger:
    """Table reads of all plans that a probe runs, each counted before it runs."""

    def __init__(self, tables: int, budget: int = SCAN_BUDGET):
        self.limit, self.used = tables * budget, 0

    def enter(self, plan: DataFrame) -> DataFrame:
        """The plan, or an error where it would read more than is left."""
        self.used += scans(plan)
        if self.used > self.limit:
            raise ScanBudgetExceeded(f"{self.used} table reads, budget {self.limit}")
        return plan


def _pass(cells: DataFrame, world: Callable, result: Callable, cap: int, ledger: Ledger) -> tuple[list[dict], dict]:
    """Cells and the global row, by one job each over kept cells; only cells within the cap reach the driver."""
    cells = ledger.enter(cells).persist()
    try:
        C.check_cap(cells, cap)
        rows = [r.asDict() for r in C.bounded(result(cells), cap).collect()]
        return rows, world(cells).first().asDict()
    finally:
        cells.unpersist()


def canonical(staged: DataFrame, probe: Probe, ledger: Ledger) -> tuple[list[dict], dict, int | None]:
    """Cells, the global row and the number of distinct keys.

    The global row is summed from the kept cells, so the table is read once, and once more for keys.
    """
    cells = C.canonical_cells(staged, probe.batch_col is not None, probe.alt_col is not None)
    rows, world = _pass(cells, C.derived_global_row, C.assessed_cells, probe.analysis.result_cell_cap, ledger)
    if (world["lookup_dup_max"] or 0) > 1:
        raise JoinNotUnique(probe.event_time_via.table)
    keys = ledger.enter(C.distinct_keys(staged)).first()[0] if probe.key_cols else None
    return rows, world, keys


def dual(staged: DataFrame, probe: Probe, ledger: Ledger) -> tuple[list[dict], dict]:
    derive = lambda cells: C.derived_global_row(cells, C.DUAL_MONTH_LAG, C.DUAL_GLOBAL)
    return _pass(C.dual_cells(staged), derive, C.dual_result_cells, probe.analysis.result_cell_cap, ledger)


def _text(value) -> str | None:
    return None if value is None else value.isoformat() if isinstance(value, (date, datetime)) else str(value)


def _summary(found: dict) -> dict:
    return {f"p{p}_{k}": None if found.get(p) is None else found[p][i] for p in PERCENTS for i, k in enumerate(("mean", "std"))}


def in_window(month: date, window: tuple[date, date] | None) -> bool:
    return window is None or window[0] <= month < window[1]


def run_probe(spark: SparkSession, source: dict, probe: Probe, as_of: datetime, window: tuple[date, date] | None = None) -> Result:
    """All metrics of a probe; expected failures become verdicts."""
    started, clock, name = datetime.now(timezone.utc), time.monotonic(), probe.name
    world: dict = {}

    def ran(mode: str) -> dict:
        months = probe.analysis.extraction_months
        return {"probe": name, "extraction_started": started.isoformat(), "extraction_finished": datetime.now(timezone.utc).isoformat(), "duration_seconds": time.monotonic() - clock, "execution_mode": mode, "extraction_months": months, "extraction_start": _text(extraction_start(as_of, months)) if months else None, "n_staged_rows": world.get("n_staged_rows")}

    def stop(status: Status, mode: str = "aborted") -> Result:
        return Result(probe, [status], {"probe_runs": [ran(mode)]})

    if not table_exists(spark, source, probe.table):
        return stop(Status("probe", "SKIPPED", "optional_table_absent", probe.table) if probe.optional else Status("probe", "RED", "missing_table", probe.table))
    base, lookup, via = read_table(spark, source, probe.table), None, probe.event_time_via
    # a via probe's guard reads the lookup once more than its passes do
    ledger = Ledger(1 if via is None else 2, SCAN_BUDGET + (via is not None))
    try:
        column_types(base, probe.columns)
        if via is not None:
            if not table_exists(spark, source, via.table):
                return stop(Status("probe", "RED", "missing_table", via.table))
            lookup = read_table(spark, source, via.table)
            column_types(lookup, [*(b for _, b in via.on), via.column])
            if ledger.enter(duplicated_keys(lookup, via)).head(1):
                raise JoinNotUnique(via.table)
        staged = K.staging(base, probe, as_of, lookup, every=False)
        cells, world, keys = canonical(staged, probe, ledger)
        two = dual(K.dual_staging(base, probe, as_of, lookup, every=False), probe, ledger) if probe.source_insert_time else None
    except KeyError as e:
        return stop(Status("probe", "RED", "missing_table", f"column {e}"))
    except JoinNotUnique as e:
        return stop(Status("probe", "RED", "join_not_unique", str(e)))
    except ScanBudgetExceeded as e:
        return stop(Status("probe", "RED", "scan_budget_exceeded", str(e)))
    except C.CellCapExceeded as e:
        return stop(Status("probe", "RED", "result_cell_cap_exceeded", str(e)))

    done = A.assess_completion(cells, world, probe, as_of)
    volume = A.assess_volume(cells, world, probe, as_of, done, keys)
    fresh = A.assess_freshness(cells, probe, as_of)
    statuses = [*done.statuses, *volume.statuses, *fresh.statuses]
    tables: dict[str, list[dict]] = {"probe_runs": [ran("via" if via else "direct")]}
    known = ("n_eligible", "n_null_event_time", "n_null_load_time_only", "n_negative_lag_excluded", "n_join_unmatched")
    tables["population_buckets"] = [{"probe": name, **{k: world[k] for k in C.MEASURES}, "other": world["row_count"] - sum(world[k] for k in known), "distinct_keys": keys}]
    tables["completion_summary"] = [{"probe": name, "learned_wait": done.learned_wait, "horizon": done.horizon, "recommended_wait": done.wait, "complete_back_to": _text(done.back_to), "negative_lag_excess_fraction": done.excess, **_summary(done.summary)}]
    tables["volume_summary"] = [{"probe": name, "baseline_median": volume.median, "baseline_sigma": volume.sigma, "forecast": volume.forecast, "duplicate_rows": volume.duplicates, "gaps": ",".join(f"{m:%Y-%m}" for m in volume.gaps)}]
    tables["completion_percentiles"] = [{"probe": name, "month": _text(m), "pct": p, "days": d, "over_cap": d is None, "lag_resolution": probe.lag_resolution} for m, row in done.days.items() if in_window(m, window) for p, d in row.items()]
    tables["month_volumes"] = [{"probe": name, "month": _text(m), "volume": v, "state": volume.states.get(m), "expected_low": volume.fill.get(m, {}).get("low"), "expected_high": volume.fill.get(m, {}).get("high"), "nowcast": volume.fill.get(m, {}).get("nowcast"), "deficit": volume.fill.get(m, {}).get("deficit")} for m, v in volume.volumes.items()]
    tables["month_lag_cells"] = [{"probe": name, "event_month": _text(c["event_month"]), "lag_day": c["lag_day"], "row_count": c["row_count"]} for c in A.of_set(cells, C.MONTH_LAG)]
    tables["epoch_cells"] = [{"probe": name, "load_epoch_day": _text(c["load_epoch"]), "row_count": c["row_count"]} for c in A.of_set(cells, C.EPOCH)]
    tables["freshness"] = [{"probe": name, "epoch_count": len(fresh.epochs), "last_epoch": _text(fresh.epochs[-1]) if fresh.epochs else None, "cadence_median_days": fresh.cadence, "cadence_sigma_days": fresh.sigma, "days_since_last": fresh.since}]
    if probe.batch_col:
        batch = A.assess_batch(cells, probe)
        statuses += batch.statuses
        tables["batch_runs"] = [{"probe": name, "batch_id": b, "rows": n} for b, n in sorted(batch.rows.items())]
        tables["batch_months"] = [{"probe": name, "month": _text(m), "runs": x["runs"], "null_batch_rows": x["null_batch_rows"], **{f"days_to_p{p}": d for p, d in x["days"].items()}} for m, x in batch.months.items()]
    if two is not None:
        lag = A.assess_dual(*two, probe)
        statuses += lag.statuses
        tables["dual_summary"] = [{"probe": name, "n_null_source_only": lag.null_source, "n_delta_rows": sum(lag.delta.values()), "negative_lag_excess_fraction": lag.excess}]
        tables["dual_lag_cells"] = [{"probe": name, "event_month": _text(c["event_month"]), "lag_day": c["src_lag_day"], "row_count": c["row_count"]} for c in A.of_set(two[0], C.DUAL_MONTH_LAG)]
        tables["dual_percentiles"] = [{"probe": name, "month": _text(m), "pct": p, "days": d, "over_cap": d is None, "lag_resolution": probe.lag_resolution} for m, row in lag.days.items() if in_window(m, window) for p, d in row.items()]
        tables["dual_delta"] = [{"probe": name, "delta_day": d, "row_count": n} for d, n in sorted(lag.delta.items())]
    tables["compare_mismatch"] = [{"probe": name, "month": _text(m), "mismatches": n} for m, n in done.mismatches.items() if in_window(m, window)]
    return Result(probe, statuses, tables, A.Side(probe, cells, done, volume.duplicates, world["n_null_load_time_only"]))


def run_all(spark: SparkSession, source: dict, probes: tuple[Probe, ...], as_of: datetime, window: tuple[date, date] | None = None) -> tuple[dict[str, list[dict]], int]:
    """Rows of every snapshot table and the exit code: probes one after another, then parity of the named pairs."""
    results = {p.name: run_probe(spark, source, p, as_of, window) for p in probes}
    tables: dict[str, list[dict]] = {}
    for r in results.values():
        if r.probe.parity_with and r.side is not None:
            found = A.assess_parity(r.side, results[r.probe.parity_with].side, as_of)
            r.statuses += found.statuses
            r.tables["parity_months"] = [{"probe": r.probe.name, **x, "month": _text(x["month"])} for x in found.rows]
        for table, rows in r.tables.items():
            tables.setdefault(table, []).extend(rows)
        tables.setdefault("statuses", []).extend({"probe": r.probe.name, "check": s.check, "severity": s.severity, "reason": s.reason, "detail": s.detail, "status_schema_version": STATUS_VERSION} for s in r.statuses)
    return tables, exit_code(s for r in results.values() for s in r.statuses)
