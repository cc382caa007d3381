"""The six assessments on collected cells, whose number the cell cap bounds."""

from __future__ import annotations

import statistics
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from tidemark.config import DAYS_A_MONTH, PERCENTS, Probe
from tidemark.functions.times import complete_back_to, next_month, normal_watermark
from tidemark.operators import cells as C
from tidemark.operators.robust import MAD_SCALE, fill_band, floored_sigma, mad, recommended_wait
from tidemark.status import Status, green

#: Least training months of the backtest and the disagreement it allows: days, and share of the longer wait.
BACKTEST_MONTHS, BACKTEST_DAYS, BACKTEST_SHARE = 6, 7, 0.25


def of_set(cells: list[dict], gid: int) -> list[dict]:
    return [c for c in cells if c["grouping_id"] == gid]


def month_curves(cells: list[dict], lag: str = "lag_day", count: str = "row_count") -> dict[date, dict[int, int]]:
    """Rows by lag of each month; the excluded lag is no part of a curve."""
    out: dict[date, dict[int, int]] = defaultdict(dict)
    for c in cells:
        if c["event_month"] is not None and c[lag] is not None and c[lag] >= 0:
            out[c["event_month"]][c[lag]] = out[c["event_month"]].get(c[lag], 0) + c[count]
    return dict(sorted(out.items()))


def percentile_day(curve: dict[int, int], pct: int, cap: int) -> int | None:
    """Smallest lag by which pct percent had arrived; None where that is beyond the cap."""
    final, seen = sum(curve.values()), 0
    for lag in sorted(curve):
        seen += curve[lag]
        if lag <= cap and seen / final >= pct / 100:
            return lag
    return None


def share_at(curve: dict[int, int], day: int) -> float:
    final = sum(curve.values())
    return sum(n for lag, n in curve.items() if lag <= day) / final if final else 0.0


def negative_excess(world: dict, null_load: str = "n_null_load_time_only") -> float:
    rest = world["row_count"] - world["n_null_event_time"] - world[null_load] - world.get("n_join_unmatched", 0)
    return world["n_negative_lag_excluded"] / rest if rest else 0.0


def summarise(days: dict[int, list[int | None]], least: int) -> dict[int, tuple[float, float] | None]:
    return {p: (statistics.fmean(v), statistics.pstdev(v)) if len(v) >= least and None not in v else None for p, v in days.items()}


@dataclass
class Completion:
    statuses: list[Status]
    days: dict[date, dict[int, int | None]] = field(default_factory=dict)
    training: list[date] = field(default_factory=list)
    mature: list[date] = field(default_factory=list)
    learned_wait: int | None = None
    horizon: int | None = None
    wait: int | None = None
    back_to: date | None = None
    excess: float = 0.0
    curve: list[float] | None = None
    summary: dict = field(default_factory=dict)
    mismatches: dict[date, int] = field(default_factory=dict)


def reconciled(world: dict, null_load: str = "n_null_load_time_only") -> Status:
    known = sum(world.get(k, 0) for k in ("n_eligible", "n_null_event_time", null_load, "n_negative_lag_excluded", "n_join_unmatched"))
    if known != world["row_count"]:
        return Status("reconciliation", "RED", "reconciliation_mismatch", f"{world['row_count']} rows, {known} in classes")
    return green("reconciliation")


def assess_completion(cells: list[dict], world: dict, probe: Probe, as_of: datetime) -> Completion:
    a, as_of = probe.analysis, normal_watermark(as_of)
    out = Completion([reconciled(world)])
    if probe.event_time_via is not None and world["n_base_rows"] != world["row_count"]:  # with a unique lookup they are equal
        out.statuses.append(Status("reconciliation", "RED", "reconciliation_mismatch", f"{world['n_base_rows']} rows before the join, {world['row_count']} after"))
    curves = month_curves(of_set(cells, C.MONTH_LAG))
    out.mismatches = defaultdict(int)
    for c in of_set(cells, C.MONTH_LAG):
        if c["event_month"] is not None and probe.compare_event_time:
            out.mismatches[c["event_month"]] += c["n_compare_mismatch"]
    out.days = {m: {p: percentile_day(c, p, a.lag_cap_days) for p in PERCENTS} for m, c in curves.items()}
    out.excess = negative_excess(world)
    if out.excess > a.negative_lag_red_fraction:
        out.statuses.append(Status("completion", "RED", "negative_lag_excess", f"{out.excess:.6f}"))
    ends = {m: next_month(m) for m in curves}
    out.training = [m for m in curves if ends[m] <= as_of - timedelta(days=a.training_cutoff_days)]
    p95 = [out.days[m][95] for m in out.training]
    if not out.training:
        out.statuses.append(Status("completion", "INSUFFICIENT_HISTORY", "insufficient_mature_months", "no training month"))
    elif None in p95:
        out.statuses.append(Status("completion", "INSUFFICIENT_HISTORY", "percentile_over_cap", "a training month is not complete by the cap"))
    else:
        out.learned_wait = recommended_wait(p95)
    if len(p95) >= BACKTEST_MONTHS:
        half = len(p95) // 2
        old, young = (None if None in h else recommended_wait(h) for h in (p95[:half], p95[half:]))
        if (old is None) != (young is None) or (old is not None and abs(old - young) > max(BACKTEST_DAYS, BACKTEST_SHARE * max(old, young))):
            out.learned_wait = None
            out.statuses.append(Status("completion", "INSUFFICIENT_HISTORY", "backtest_disagreement", f"older half {old}, younger half {young}"))
    if out.learned_wait is not None:  # maturity is measured by the wait, once
        out.horizon = max(a.training_cutoff_days, out.learned_wait)
        out.mature = [m for m in curves if ends[m] <= as_of - timedelta(days=out.horizon)]
        if len(out.mature) < a.min_mature_months:
            out.statuses.append(Status("completion", "INSUFFICIENT_HISTORY", "insufficient_mature_months", f"{len(out.mature)} mature months"))
        elif any(out.days[m][95] is None for m in out.mature):
            out.statuses.append(Status("completion", "INSUFFICIENT_HISTORY", "percentile_over_cap", "a mature month is not complete by the cap"))
        else:
            out.wait = recommended_wait([out.days[m][95] for m in out.mature])
    if out.mature:
        out.curve = [statistics.median(share_at(curves[m], d) for m in out.mature) for d in range(a.lag_cap_days + 2)]
    out.summary = summarise({p: [out.days[m][p] for m in out.mature] for p in PERCENTS}, a.min_mature_months)
    out.back_to = complete_back_to(as_of, out.wait)
    if all(s.severity == "GREEN" for s in out.statuses):
        out.statuses.append(green("completion"))
    return out


@dataclass
class Volume:
    statuses: list[Status]
    volumes: dict[date, int] = field(default_factory=dict)
    states: dict[date, str] = field(default_factory=dict)
    median: float | None = None
    sigma: float | None = None
    forecast: float | None = None
    duplicates: int | None = None
    gaps: list[date] = field(default_factory=list)
    fill: dict[date, dict] = field(default_factory=dict)


def _index(m: date) -> int:
    return m.year * 12 + m.month - 1


def _month(i: int) -> date:
    return date(i // 12, i % 12 + 1, 1)


def assess_volume(cells: list[dict], world: dict, probe: Probe, as_of: datetime, completion: Completion, distinct_keys: int | None = None) -> Volume:
    a, as_of = probe.analysis, normal_watermark(as_of)
    out = Volume([])
    if distinct_keys is not None:
        out.duplicates = world["row_count"] - distinct_keys
        out.statuses.append(Status("uniqueness", "RED", "duplicate_keys", f"{out.duplicates} duplicate rows") if out.duplicates else green("uniqueness"))
    out.volumes = {m: sum(c.values()) for m, c in month_curves(of_set(cells, C.MONTH_LAG)).items()}
    if not out.volumes:
        out.statuses.append(Status("volume", "RED", "zero_row_month", "no month has rows"))
        return out
    months = list(out.volumes)
    out.gaps = [_month(i) for i in range(_index(months[0]), _index(months[-1])) if _month(i) not in out.volumes]
    if out.gaps:
        out.statuses.append(Status("volume", "RED", "volume_gap", ", ".join(f"{m:%Y-%m}" for m in out.gaps)))
    mature = set(completion.mature)
    out.states = {m: "mature" if m in mature else "open" if next_month(m) > as_of else "immature" for m in months}
    recent = set(months[len(months) - a.evaluation_window_months :]) if a.evaluation_window_months else set()
    base = [out.volumes[m] for m in months if m in mature and m not in recent]
    if completion.horizon is None or len(base) < a.min_mature_months:
        out.statuses.append(Status("volume", "INSUFFICIENT_HISTORY", "insufficient_mature_months", f"{len(base)} baseline months"))
        return out
    out.median, out.sigma = float(statistics.median(base)), floored_sigma(base)
    out.forecast = out.median
    red_low = out.median - a.volume_red_mads * out.sigma
    ripe = [m for m in months if m in mature]
    run: list[date] = []
    for m in reversed(ripe):
        if out.volumes[m] >= red_low or (run and _index(run[-1]) - _index(m) != 1):
            break
        run.append(m)
    # an absent month after the run, which could be mature too, leaves its end open
    edge = as_of - timedelta(days=completion.horizon)
    latest = _index(date(edge.year, edge.month, 1)) - 1
    absent = bool(run) and any(_month(i) not in out.volumes for i in range(_index(run[0]) + 1, min(latest, _index(months[-1])) + 1))
    collapsed = set(run) if len(run) >= 2 and not absent else set()
    if collapsed:
        out.statuses.append(Status("volume", "RED", "volume_collapse", f"{min(collapsed):%Y-%m} to {max(collapsed):%Y-%m}"))
    for m in ripe:
        off = abs(out.volumes[m] - out.median)
        if m not in collapsed and off > a.volume_amber_mads * out.sigma:
            out.statuses.append(Status("volume", "RED" if off > a.volume_red_mads * out.sigma else "AMBER", "volume_outlier", f"{m:%Y-%m}: {out.volumes[m]}"))
    if completion.curve is not None:
        spread = floored_sigma([out.volumes[m] for m in ripe])
        for m in months:
            if out.states[m] != "immature":
                continue
            age = min(max(int((as_of - next_month(m)) / timedelta(days=1)), 0), a.lag_cap_days + 1)
            share = completion.curve[age]
            low, high = fill_band(out.forecast, share, spread, a.expected_fill_band_mads)
            out.fill[m] = {"low": low, "high": high, "nowcast": out.volumes[m] / share if share else None, "deficit": out.volumes[m] < low}
            if out.fill[m]["deficit"]:
                out.statuses.append(Status("volume", "AMBER", "arrival_deficit", f"{m:%Y-%m}: {out.volumes[m]} of at least {low:.0f}"))
    if not any(s.check == "volume" for s in out.statuses):
        out.statuses.append(green("volume"))
    return out


@dataclass
class Freshness:
    statuses: list[Status]
    epochs: list[datetime] = field(default_factory=list)
    cadence: float | None = None
    sigma: float | None = None
    since: float | None = None


def batch_times(cells: list[dict]) -> dict[str, datetime]:
    """First load of each batch, from all its cells: rows that give no month arrived all the same."""
    out: dict[str, datetime] = {}
    for c in of_set(cells, C.MONTH_BATCH):
        if c["batch_id"] is not None and c["min_load_time"] is not None:
            out[c["batch_id"]] = min(out.get(c["batch_id"], c["min_load_time"]), c["min_load_time"])
    return out


def assess_freshness(cells: list[dict], probe: Probe, as_of: datetime) -> Freshness:
    a, as_of, day = probe.analysis, normal_watermark(as_of), timedelta(days=1)
    epochs = sorted(set(batch_times(cells).values()) if probe.batch_col else {c["load_epoch"] for c in of_set(cells, C.EPOCH) if c["load_epoch"] is not None})
    out = Freshness([], epochs)
    if epochs:
        out.since = (as_of - epochs[-1]) / day
    if len(epochs) < max(a.freshness_min_epochs, 2):
        out.statuses.append(Status("freshness", "INSUFFICIENT_HISTORY", "insufficient_epochs", f"{len(epochs)} epochs"))
        return out
    gaps = [(y - x) / day for x, y in zip(epochs, epochs[1:])]
    out.cadence = statistics.median(gaps)
    out.sigma = max(MAD_SCALE * mad(gaps), a.freshness_zero_mad_tolerance_days)
    late = next((s for s, k in (("RED", a.freshness_red_mads), ("AMBER", a.freshness_amber_mads)) if out.since > out.cadence + k * out.sigma), None)
    out.statuses.append(Status("freshness", late, "stale_feed", f"{out.since:.2f} days, usually {out.cadence:.2f}") if late else green("freshness"))
    return out


@dataclass
class Batch:
    statuses: list[Status]
    rows: dict[str, int] = field(default_factory=dict)
    months: dict[date, dict] = field(default_factory=dict)


def assess_batch(cells: list[dict], probe: Probe) -> Batch:
    out, times = Batch([]), batch_times(cells)
    final = {m: sum(c.values()) for m, c in month_curves(of_set(cells, C.MONTH_LAG)).items()}
    by_month: dict[date, dict[str | None, int]] = defaultdict(lambda: defaultdict(int))  # with batches of no eligible row
    for c in of_set(cells, C.MONTH_BATCH):
        if c["event_month"] is not None:
            by_month[c["event_month"]][c["batch_id"]] += c["n_eligible"]
            if c["batch_id"] is not None:
                out.rows[c["batch_id"]] = out.rows.get(c["batch_id"], 0) + c["n_eligible"]
    lost = 0
    for m in sorted(by_month):
        batches = dict(by_month[m])
        none, seen = batches.pop(None, 0), 0
        lost += none
        whole = final.get(m, sum(batches.values()))
        days: dict[int, int | None] = dict.fromkeys(PERCENTS)
        for b in sorted(batches, key=lambda b: (times[b], b)):
            seen += batches[b]
            for p in PERCENTS:
                if days[p] is None and whole and seen / whole >= p / 100:
                    days[p] = (times[b].date() - next_month(m).date()).days
        out.months[m] = {"runs": len(batches), "null_batch_rows": none, "days": days}
    out.statuses.append(Status("batch", "AMBER", "null_batch_ids", f"{lost} rows") if lost else green("batch"))
    return out


@dataclass
class DualLag:
    statuses: list[Status]
    days: dict[date, dict[int, int | None]] = field(default_factory=dict)
    delta: dict[int, int] = field(default_factory=dict)
    null_source: int = 0
    excess: float = 0.0


def assess_dual(cells: list[dict], world: dict, probe: Probe) -> DualLag:
    """Months and percentiles of any age count: one beyond the cap is known only as such, and the check is not GREEN."""
    a = probe.analysis
    status = reconciled(world, "n_null_source_only")
    out = DualLag([status], null_source=world["n_null_source_only"], excess=negative_excess(world, "n_null_source_only"))
    curves = month_curves(of_set(cells, C.DUAL_MONTH_LAG), "src_lag_day")
    out.days = {m: {p: percentile_day(c, p, a.lag_cap_days) for p in PERCENTS} for m, c in curves.items()}
    out.delta = {c["delta_day"]: c["row_count"] for c in of_set(cells, C.DUAL_DELTA) if c["delta_day"] is not None}
    if out.excess > a.negative_lag_red_fraction:
        out.statuses.append(Status("dual_lag", "RED", "negative_lag_excess", f"{out.excess:.6f}"))
    if late := [m for m, days in out.days.items() if None in days.values()]:
        out.statuses.append(Status("dual_lag", "INSUFFICIENT_HISTORY", "percentile_over_cap", f"{len(late)} months with a percentile beyond the cap, from {late[0]:%Y-%m} on"))
    if all(s.severity == "GREEN" for s in out.statuses):
        out.statuses.append(green("dual_lag"))
    return out


@dataclass
class Parity:
    """Months that differ; rows without a load time are told beside them and are in no difference."""

    statuses: list[Status]
    rows: list[dict] = field(default_factory=list)
    null_load: tuple[int, int] = (0, 0)


@dataclass
class Side:
    """What parity needs of one probe."""

    probe: Probe
    cells: list[dict]
    completion: Completion
    duplicates: int | None
    null_load: int = 0


def month_counts(cells: list[dict]) -> dict[date, int]:
    """Rows of each month, those of the excluded lag included."""
    out: dict[date, int] = defaultdict(int)
    for c in of_set(cells, C.MONTH_LAG):
        if c["event_month"] is not None:
            out[c["event_month"]] += c["row_count"]
    return dict(out)


def assess_parity(left: Side, right: Side | None, as_of: datetime) -> Parity:
    null_load = (left.null_load, right.null_load if right else 0)

    def refuse(reason: str, detail: str) -> Parity:
        return Parity([Status("parity", "INDETERMINATE", reason, detail)], [], null_load)

    if right is None:
        return refuse("parity_prereq_uniqueness", "the partner has no result")
    if left.probe.parity_with not in (None, right.probe.name):
        raise ValueError(f"{left.probe.name} names {left.probe.parity_with}, not {right.probe.name}")
    for s in (left, right):
        if s.probe.read_uncommitted:
            return refuse("parity_prereq_read_uncommitted", s.probe.name)
    for s in (left, right):
        if not s.probe.key_cols or s.duplicates:
            return refuse("parity_prereq_uniqueness", s.probe.name)
    for s in (left, right):
        if s.completion.excess >= s.probe.analysis.negative_lag_red_fraction:
            return refuse("parity_prereq_negative_lag", s.probe.name)
    if left.completion.horizon is None or right.completion.horizon is None:
        return Parity([Status("parity", "INSUFFICIENT_HISTORY", "insufficient_mature_months", "a side has no mature months")], [], null_load)
    edge = normal_watermark(as_of) - timedelta(days=max(left.completion.horizon, right.completion.horizon))
    counts = [{m: n for m, n in month_counts(s.cells).items() if next_month(m) <= edge} for s in (left, right)]
    months = sorted(set(counts[0]) | set(counts[1]))
    out, tolerance = Parity([], [], null_load), left.probe.analysis.parity_tolerance
    for m in months:
        x, y = counts[0].get(m), counts[1].get(m)
        diff = (x or 0) - (y or 0)
        verdict = "left_only" if y is None else "right_only" if x is None else "match" if abs(diff) <= tolerance else "mismatch"
        out.rows.append({"month": m, "partner": right.probe.name, "left_count": x, "right_count": y, "diff": diff, "verdict": verdict})
        if verdict != "match":
            out.statuses.append(Status("parity", "RED", "parity_mismatch" if verdict == "mismatch" else "parity_one_sided_month", f"{m:%Y-%m}: {verdict} {diff:+d}"))
    return Parity(out.statuses or [green("parity")], out.rows, null_load)


def p95_text(summary: tuple[float, float | None] | None, cap: int | None, months: bool = False) -> str:
    """Cell of the dashboard: mean and deviation in days, the mean in months, or more than a cap, or that there is none."""
    if summary is None and cap is None:
        return "—"
    mark, days = ("> ", cap) if summary is None else ("", summary[0])
    if months:
        return f"{mark}{days / DAYS_A_MONTH:.1f} mo"
    spread = "" if summary is None or summary[1] is None else f" ± {summary[1]:.0f}"
    return f"{mark}{days:.0f}{spread} d"
