"""What reports show: suppressed frames, the datasets of eight figures, SVG, HTML and Markdown."""

from __future__ import annotations

import html
import statistics
from collections import defaultdict
from datetime import datetime, timezone

from tidemark.config import PERCENTS, Analysis, Campaign, Probe
from tidemark.functions.cron import next_expected
from tidemark.plans.assess import p95_text
from tidemark.status import worst

#: Counts below this are hidden where a probe asks for it, and the columns that hold counts (fixed values).
SMALL = 5
COUNTS = {"month_volumes": ("volume",), "month_lag_cells": ("row_count",), "epoch_cells": ("row_count",), "batch_runs": ("rows",), "batch_months": ("null_batch_rows",), "dual_lag_cells": ("row_count",), "dual_delta": ("row_count",), "compare_mismatch": ("mismatches",), "parity_months": ("left_count", "right_count", "diff")}
FIGURES = ("volume", "completion_curves", "completion_heatmap", "percentiles", "dual_overlay", "dual_delta", "batch", "parity")


def display_count(n: int | None, suppressed: bool = False) -> str:
    return "—" if n is None else "<5" if suppressed and abs(n) < SMALL else f"{n:,}"


def frames_for_probe(tables: dict[str, list[dict]], probe: str, suppress: bool = False) -> dict[str, list[dict]]:
    """Rows of one probe, with small counts null where asked."""
    out = {t: [dict(r) for r in rows if r.get("probe") == probe] for t, rows in tables.items()}
    if suppress:
        for table, columns in COUNTS.items():
            for row in out.get(table, ()):
                for c in columns:
                    if row.get(c) is not None and abs(row[c]) < SMALL:
                        row[c] = None
    return out


def _curves(rows: list[dict]) -> dict[str, list[tuple[int, float]]]:
    """Visible cumulative shares by month; hidden cells are left out and the rest is the whole."""
    by: dict[str, dict[int, int]] = defaultdict(dict)
    for r in rows:
        if r["lag_day"] is not None and r["lag_day"] >= 0 and r["row_count"] is not None:
            by[r["event_month"]][r["lag_day"]] = r["row_count"]
    out = {}
    for month, cells in sorted(by.items()):
        total, seen, points = sum(cells.values()), 0, []
        for lag in sorted(cells):
            seen += cells[lag]
            points.append((lag, seen / total))
        out[month] = points
    return out


def _at(points: list[tuple[int, float]], day: int) -> float:
    return max((v for d, v in points if d <= day), default=0.0)


def _quantile(values: list[float], q: float) -> float:
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def figure_data(frames: dict[str, list[dict]], probe: Probe | None = None) -> dict[str, list[dict]]:
    """Rows of every figure that the probe's tables can fill; the probe gives the thresholds of the marks."""
    a = probe.analysis if probe else Analysis()
    out: dict[str, list[dict]] = {}
    summary = next(iter(frames.get("volume_summary", [])), {})
    median, sigma = summary.get("baseline_median"), summary.get("baseline_sigma")
    marks = []
    for r in frames.get("month_volumes", []):
        known = None not in (r["volume"], median, sigma) and r["state"] == "mature"
        off = abs(r["volume"] - median) if known else 0
        mark = "red" if known and off > a.volume_red_mads * sigma else "amber" if known and off > a.volume_amber_mads * sigma else "deficit" if r.get("deficit") else None
        marks.append(r | {"mark": mark})
    out["volume"] = marks
    curves = _curves(frames.get("month_lag_cells", []))
    mature = {r["month"] for r in frames.get("month_volumes", []) if r["state"] == "mature"}
    out["completion_curves"] = [{"month": m, "day": d, "share": v} for m, points in curves.items() for d, v in points]
    ripe = [p for m, p in curves.items() if m in mature]
    grid = sorted({d for p in ripe for d, _ in p})
    out["completion_curves"] += [{"month": "mature", "day": d, **{f"p{int(q * 100)}": _quantile([_at(p, d) for p in ripe], q) for q in (0.1, 0.5, 0.9)}} for d in grid]
    weeks: dict[tuple[str, int], int] = defaultdict(int)
    for r in frames.get("month_lag_cells", []):
        if r["lag_day"] is not None and r["lag_day"] >= 0 and r["row_count"] is not None:
            weeks[r["event_month"], r["lag_day"] // 7] += r["row_count"]
    totals: dict[str, int] = defaultdict(int)
    for (m, _), n in weeks.items():
        totals[m] += n
    out["completion_heatmap"] = [{"month": m, "lag_week": w, "share": n / totals[m]} for (m, w), n in sorted(weeks.items())]
    done = next(iter(frames.get("completion_summary", [])), {})
    out["percentiles"] = [r | {"mean": done.get(f"p{r['pct']}_mean"), "std": done.get(f"p{r['pct']}_std")} for r in frames.get("completion_percentiles", [])]
    if frames.get("dual_lag_cells"):
        for side, rows in (("load", frames.get("month_lag_cells", [])), ("source", frames["dual_lag_cells"])):
            found = _curves(rows)
            days = sorted({d for p in found.values() for d, _ in p})
            out.setdefault("dual_overlay", []).extend({"side": side, "day": d, "share": statistics.median(_at(p, d) for p in found.values())} for d in days)
        out["dual_delta"] = frames.get("dual_delta", [])
    out["batch"] = frames.get("batch_months", [])
    out["parity"] = frames.get("parity_months", [])
    return {k: out[k] for k in FIGURES if out.get(k)}


#: Colours by what they say.
COLOURS = {"red": "#c0392b", "amber": "#e08e0b", "deficit": "#c0392b", "match": "#4878a8", "mismatch": "#c0392b", "left_only": "#c0392b", "right_only": "#c0392b", "mature": "#4878a8", "immature": "#a8c0d8", "open": "#d3d3d3"}
SHADES = ("#4878a8", "#2e8b57", "#8e44ad", "#7f8c8d")
WIDTH, HEIGHT, LEFT, BASE, TOP = 720, 240, 40, 206, 26


class Chart:
    """A plain SVG chart; everything is placed by the data's order, so equal data gives equal bytes.

    Months or days stand on the x axis by their place among labels; values from 0 to top on the y axis.
    """

    def __init__(self, title: str, labels: list, values: list[float | None]):
        self.title, self.labels = title, {x: i for i, x in enumerate(labels)}
        self.top = max((abs(v) for v in values if v is not None), default=0) or 1
        self.step = (WIDTH - LEFT - 10) / max(1, len(self.labels))
        self.parts: list[str] = []

    def place(self, label, value: float) -> tuple[float, float]:
        return LEFT + (self.labels[label] + 0.5) * self.step, BASE - (BASE - TOP) * min(1.0, abs(value) / self.top)

    def bars(self, rows: list[tuple], opacity: float = 1.0) -> Chart:
        """(label, value, colour) each; a missing value leaves its place empty."""
        for label, value, colour in rows:
            if value is not None:
                x, y = self.place(label, value)
                width = max(1.0, self.step - 1)
                self.parts.append(f'<rect x="{x - width / 2:.1f}" y="{y:.1f}" width="{width:.1f}" height="{BASE - y:.1f}" fill="{colour}" fill-opacity="{opacity:g}"><title>{html.escape(str(label))}: {value:g}</title></rect>')
        return self

    def line(self, points: list[tuple], colour: str, dash: str = "", name: str = "", opacity: float = 1.0) -> Chart:
        """(label, value) each; a missing value breaks the line."""
        runs: list[list[str]] = [[]]
        for label, value in points:
            if value is None:
                runs.append([])
            else:
                runs[-1].append("{:.1f},{:.1f}".format(*self.place(label, value)))
        for run in runs:
            if run:
                self.parts.append(f'<polyline fill="none" stroke="{colour}" stroke-opacity="{opacity:g}" stroke-dasharray="{dash}" points="{" ".join(run)}"><title>{html.escape(name)}</title></polyline>')
        return self

    def band(self, points: list[tuple], colour: str, name: str) -> Chart:
        """(label, low, high) each."""
        if points:
            edge = [self.place(x, high) for x, _, high in points] + [self.place(x, low) for x, low, _ in reversed(points)]
            self.parts.append(f'<polygon fill="{colour}" fill-opacity="0.2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in edge)}"><title>{html.escape(name)}</title></polygon>')
        return self

    def marks(self, points: list[tuple], sign: str) -> Chart:
        """(label, value, colour, name) each, as a sign over the value."""
        for label, value, colour, name in points:
            x, y = self.place(label, value or 0)
            self.parts.append(f'<text x="{x:.1f}" y="{max(TOP, y - 3):.1f}" font-size="11" text-anchor="middle" fill="{colour}">{sign}<title>{html.escape(name)}</title></text>')
        return self

    def svg(self) -> str:
        ends = [str(x) for x in self.labels]
        axis = "".join(f'<text x="{x}" y="{HEIGHT - 14}" font-size="11" text-anchor="{a}">{html.escape(t)}</text>' for x, a, t in ((LEFT, "start", ends[0]), (WIDTH - 10, "end", ends[-1]))) if ends else ""
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img"><title>{html.escape(self.title)}</title><text x="{LEFT}" y="16" font-size="13">{html.escape(self.title)}</text><text x="{LEFT - 4}" y="{TOP + 6}" font-size="10" text-anchor="end">{self.top:g}</text>{"".join(self.parts)}{axis}</svg>'


def _volume(rows: list[dict], title: str) -> Chart:
    chart = Chart(title, [r["month"] for r in rows], [*(r["volume"] for r in rows), *(r.get("expected_low") for r in rows)])
    chart.bars([(r["month"], r["volume"], COLOURS.get(r["state"], "#4878a8")) for r in rows])
    chart.marks([(r["month"], r["volume"], COLOURS[r["mark"]], f"volume outlier ({r['mark']})") for r in rows if r["mark"] in ("red", "amber")], "×")
    chart.marks([(r["month"], r["volume"], COLOURS["deficit"], "arrival deficit") for r in rows if r.get("deficit")], "▼")
    return chart.line([(r["month"], r.get("expected_low")) for r in rows], "#7f8c8d", "2 3", "expected so far (low)")


def _completion(rows: list[dict], title: str) -> Chart:
    chart = Chart(title, sorted({r["day"] for r in rows}), [1.0])
    months: dict[str, list[tuple]] = defaultdict(list)
    ripe = [r for r in rows if r["month"] == "mature"]
    for r in rows:
        if r["month"] != "mature":
            months[r["month"]].append((r["day"], r["share"]))
    for month, points in months.items():
        chart.line(points, "#4878a8", "", month, 0.35)
    chart.band([(r["day"], r["p10"], r["p90"]) for r in ripe], "#c0392b", "mature months, p10 to p90")
    return chart.line([(r["day"], r["p50"]) for r in ripe], "#c0392b", "", "median of mature months")


def _percentiles(rows: list[dict], title: str) -> Chart:
    months = sorted({r["month"] for r in rows})
    highs = [r["mean"] + r["std"] for r in rows if r["mean"] is not None and r["std"] is not None]
    chart = Chart(title, months, [*(r["days"] for r in rows), *highs])
    for shade, pct in zip(SHADES, sorted({r["pct"] for r in rows})):
        some = sorted((r for r in rows if r["pct"] == pct), key=lambda r: r["month"])
        if some[0]["mean"] is not None and some[0]["std"] is not None:
            low, high = max(0.0, some[0]["mean"] - some[0]["std"]), some[0]["mean"] + some[0]["std"]
            chart.band([(m, low, high) for m in (months[0], months[-1])], shade, f"p{pct}: mean of mature months and one deviation")
        chart.line([(r["month"], r["days"]) for r in some], shade, "", f"days to {pct} %")
        chart.marks([(r["month"], chart.top, shade, f"{pct} % beyond the cap") for r in some if r.get("over_cap")], "↑")
    return chart


def _batch(rows: list[dict], title: str) -> Chart:
    days = [r[f"days_to_p{p}"] for r in rows for p in PERCENTS if r.get(f"days_to_p{p}") is not None]
    chart = Chart(title, [r["month"] for r in rows], [*(r["runs"] for r in rows), *days])
    chart.bars([(r["month"], r["runs"], "#a8c0d8") for r in rows])
    for shade, p in zip(SHADES, PERCENTS):
        chart.line([(r["month"], None if r.get(f"days_to_p{p}") is None else max(0, r[f"days_to_p{p}"])) for r in rows], shade, "", f"days to {p} %")
    return chart.marks([(r["month"], r["runs"], COLOURS["amber"], "rows of no batch") for r in rows if r.get("null_batch_rows")], "!")


def _heatmap(rows: list[dict], title: str) -> str:
    months, weeks = sorted({r["month"] for r in rows}), sorted({r["lag_week"] for r in rows})
    row, column = {m: i for i, m in enumerate(months)}, {w: i for i, w in enumerate(weeks)}
    cells = "".join(f'<rect x="{30 + 680 * column[r["lag_week"]] / len(weeks):.1f}" y="{26 + 6 * row[r["month"]]}" width="{max(1, 680 / len(weeks)):.1f}" height="6" fill="#1f4e79" fill-opacity="{r["share"]:.3f}"/>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 720 {40 + 6 * len(months)}" role="img"><text x="30" y="18" font-size="13">{html.escape(title)}</text>{cells}</svg>'


def _overlay(rows: list[dict], title: str) -> Chart:
    chart = Chart(title, sorted({r["day"] for r in rows}), [1.0])
    for side, colour in (("load", "#4878a8"), ("source", "#c0392b")):
        chart.line([(r["day"], r["share"]) for r in rows if r["side"] == side], colour, "", side)
    return chart


TITLES = {"volume": "Rows by month", "completion_curves": "Share arrived by day of lag", "completion_heatmap": "Share by lag week", "percentiles": "Days to each percentage by month", "dual_overlay": "Share arrived, by load and by source", "dual_delta": "Days from source to load", "batch": "Runs and days to each percentage by month", "parity": "Difference by month"}


def figure_svg(kind: str, rows: list[dict], probe: Probe | None = None) -> str:
    """A figure's chart; times that only stand in for others are named as such."""
    title = TITLES[kind] + (" (proxy times)" if probe is not None and probe.proxy else "")
    if kind == "completion_heatmap":
        return _heatmap(rows, title)
    if kind == "parity":
        return Chart(title, [r["month"] for r in rows], [r["diff"] for r in rows]).bars([(r["month"], r["diff"], COLOURS[r["verdict"]]) for r in rows]).svg()
    if kind == "dual_delta":
        return Chart(title, [r["delta_day"] for r in rows], [r["row_count"] for r in rows]).bars([(r["delta_day"], r["row_count"], "#4878a8") for r in rows]).svg()
    draw = {"volume": _volume, "completion_curves": _completion, "percentiles": _percentiles, "batch": _batch, "dual_overlay": _overlay}
    return draw[kind](rows, title).svg()


#: What stands where a probe has no verdict of a kind.
NO_STATUS = "no status"


def _updating(statuses: list[dict]) -> str:
    fresh = [s["severity"] for s in statuses if s["check"] == "freshness"]
    return worst(fresh) if fresh else NO_STATUS


def dashboard_rows(tables: dict[str, list[dict]], suppress: frozenset[str] = frozenset(), probes: tuple[Probe, ...] = (), source: dict | None = None) -> list[dict]:
    """One row a probe: where its table is, healthy (worst of all), updating (worst of freshness), complete back to, p95 of the load lag.

    A probe bounded to some months says so. Without a p95, a completion verdict of a percentile beyond the cap gives the cap.
    """
    out, known = [], {p.name: p for p in probes}
    for name in dict.fromkeys([*known, *(r["probe"] for r in tables.get("statuses", []))]):
        f, probe = frames_for_probe(tables, name, name in suppress), known.get(name)
        statuses = f.get("statuses", [])
        done = next(iter(f.get("completion_summary", [])), {})
        p95 = None if done.get("p95_mean") is None else (done["p95_mean"], done.get("p95_std"))
        over = any(s["check"] == "completion" and s["reason"] == "percentile_over_cap" for s in statuses)
        a = probe.analysis if probe else Analysis()
        cap = a.lag_cap_days if over else None
        out.append({
            "database": (source or {}).get("database") or (source or {}).get("path") or "—",
            "table": ".".join(x for x in ((source or {}).get("schema"), probe.table) if x) if probe else "—",
            "probe": f"{name} (≤{a.extraction_months}m)" if a.extraction_months else name,
            "healthy": worst(s["severity"] for s in statuses) if statuses else NO_STATUS,
            "updating": _updating(statuses),
            "complete_back_to": done.get("complete_back_to") or "—",
            "p95": p95_text(p95, cap),
            "p95_months": p95_text(p95, cap, True),
            "reasons": ", ".join(dict.fromkeys(s["reason"] for s in statuses if s["reason"])),
        })
    return out


def expected_by(campaign: Campaign, run_at: str) -> str:
    """When the next run is due, its grace included; run_at without a zone is UTC."""
    at = datetime.fromisoformat(run_at)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    due = next_expected(campaign.cron, at.astimezone(timezone.utc), campaign.timezone, campaign.grace_hours)
    return "manual runs only" if due is None else f"{due:%Y-%m-%d %H:%M} {campaign.timezone}"


def markdown(rows: list[dict], title: str, facts: dict[str, str] | None = None) -> str:
    """The dashboard: facts of the run, then a table for each database."""
    lines = [f"# {title}", "", *(f"**{k}:** {v}  " for k, v in (facts or {}).items())]
    names = [n for n in (rows[0] if rows else {"probe": ""}) if n != "database"]
    for database in dict.fromkeys(r["database"] for r in rows):
        lines += ["", f"## {database}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        lines += ["| " + " | ".join(str(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows if r["database"] == database]
    return "\n".join(lines) + "\n"


def report_html(tables: dict[str, list[dict]], title: str, suppress: frozenset[str] = frozenset(), probes: tuple[Probe, ...] = (), source: dict | None = None, facts: dict[str, str] | None = None) -> str:
    """One page that loads nothing: the dashboard and each probe's figures."""
    rows, known = dashboard_rows(tables, suppress, probes, source), {p.name: p for p in probes}
    head = "".join(f"<th>{html.escape(n)}</th>" for n in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    said = "".join(f"<p><b>{html.escape(k)}:</b> {html.escape(v)}</p>" for k, v in (facts or {}).items())
    parts = []
    for name in dict.fromkeys([*known, *(r["probe"] for r in tables.get("statuses", []))]):
        frames = frames_for_probe(tables, name, name in suppress)
        probe = known.get(name)
        counts = next(iter(frames.get("population_buckets", [])), None)
        note = f"<p>{display_count(counts['row_count'], name in suppress)} rows, {display_count(counts['n_eligible'], name in suppress)} eligible</p>" if counts else ""
        parts.append(f"<h2>{html.escape(name)}</h2>{note}" + "".join(f"<figure>{figure_svg(k, v, probe)}</figure>" for k, v in figure_data(frames, probe).items()))
    policy = "default-src 'none'; style-src 'unsafe-inline'; img-src data:"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{said}<table><tr>{head}</tr>{body}</table>{"".join(parts)}</body></html>'
