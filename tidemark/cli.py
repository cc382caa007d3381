"""Command line: run, discover, report, publish, abort and serve."""

from __future__ import annotations

import argparse
import re
import sys
import uuid
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.config import Config, ConfigError, compose, digest, load_config
from tidemark.functions.times import extraction_start, next_month, normal_watermark
from tidemark.plans.measures import probe_slice
from tidemark.plans.present import dashboard_rows, expected_by, markdown, report_html
from tidemark.plans.probe import run_all
from tidemark.sources.deliver import DeliveryError, deliver, guard, marked
from tidemark.sources.jdbc_store import JdbcStore
from tidemark.sources.store import TABLES, ParquetStore, Run, StoreError
from tidemark.sources.tables import draft_config, list_tables, read_table


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def window_of(text: str | None, year: int | None, as_of: datetime) -> tuple[date, date] | None:
    """--window Nm: the last N months, as_of's own included; --year Y: that year."""
    if year is not None:
        return date(year, 1, 1), date(year + 1, 1, 1)
    if text is None:
        return None
    if not (m := re.fullmatch(r"([1-9][0-9]*)m", text)):
        raise ConfigError("--window takes a number of months, such as 24m")
    return extraction_start(as_of, int(m[1])), next_month(as_of.date().replace(day=1)).date()


def load(paths: list[str]) -> Config:
    return compose([load_config(p) for p in paths])


def open_store(spark: SparkSession, config: Config) -> ParquetStore | JdbcStore:
    return JdbcStore(spark, dict(config.store_options)) if config.store_options else ParquetStore(spark, config.store_path)


def tables_of(store: ParquetStore | JdbcStore, run_id: str, probe: str | None = None) -> dict[str, list[dict]]:
    """Rows of a run's tables, those of one probe where it is given."""
    frames = {t: store.read_table(run_id, t) for t in TABLES}
    return {t: [r.asDict() for r in (probe_slice(d, probe) if probe else d).collect()] for t, d in frames.items()}


def latest(store: ParquetStore | JdbcStore, run_id: str | None) -> str:
    if run_id:
        return run_id
    if not (runs := store.list_runs()):
        raise StoreError("no committed run")
    return runs[-1]


def matching(store: ParquetStore | JdbcStore, run_id: str, config: Config) -> None:
    if store.manifest(run_id)["run"]["config_digest"] != digest(config):
        raise StoreError(f"run {run_id} was made with another configuration")


def cmd_run(args: argparse.Namespace, spark: SparkSession) -> int:
    """Analysis, then with --out the pages, then with --deliver their delivery; a resumed run goes on after its last stage."""
    config = load(args.config)
    store = open_store(spark, config)
    known = store.registered(args.resume_from) if args.resume_from else None
    if args.resume_from and known is None:
        raise StoreError(f"run {args.resume_from} is not registered")
    now = datetime.now(timezone.utc)
    as_of = normal_watermark(datetime.fromisoformat(known.as_of if known else args.as_of) if known or args.as_of else now)
    window = window_of(args.window, args.year, as_of)
    if args.dry_run:
        print("\n".join(f"{p.name}: {p.table} as of {as_of.isoformat()}" for p in config.probes))
        return 0
    run = known or Run(args.run_id or f"run-{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}", as_of.isoformat(), *(d.isoformat() if d else None for d in window or (None, None)), digest(config), now.isoformat())
    if run.config_digest != digest(config):
        raise StoreError("a run is resumed with its own configuration")
    store.register(run)
    done = store.stages(run.run_id) if known else []
    if "analysis" not in done:
        token = store.begin(run)
        try:
            tables, code = run_all(spark, config.source, config.probes, as_of, window)
            for name in TABLES:
                store.write_table(run, token, name, tables.get(name, []))
            store.commit(run, token, {"exit_code": code})
        except BaseException:
            store.abort(run.run_id)
            raise
        if config.retention:
            store.prune(config.retention, (run.run_id,))
    tables = tables_of(store, run.run_id)
    for row in dashboard_rows(tables, hidden(config), config.probes, config.source):
        print("  ".join(str(v) for v in row.values()))
    if args.out and "render" not in done:
        render(config, store, run.run_id, Path(args.out))
    if args.out and args.deliver and "publish" not in done:
        publish(config, store, run.run_id, Path(args.out), args.branch)
    return store.manifest(run.run_id)["exit_code"]


def hidden(config: Config) -> frozenset[str]:
    return frozenset(p.name for p in config.probes if p.suppress_small_counts)


def facts_of(config: Config, manifest: dict) -> dict[str, str]:
    run = manifest["run"]
    window = " to ".join(run[k][:10] for k in ("window_start", "window_end")) if run["window_start"] else "all months"
    return {"Generated": run["started_at"], "Run": run["run_id"], "As of": run["as_of"], "Window": window, "Next update expected by": expected_by(config.campaign, run["started_at"])}


def render(config: Config, store: ParquetStore | JdbcStore, run_id: str, out: Path) -> None:
    """The dashboard, its report and the mark of its run, unless the folder holds a later run."""
    tables, manifest = tables_of(store, run_id), store.manifest(run_id)
    run_at, facts = manifest["run"]["started_at"], facts_of(config, manifest)
    out.mkdir(parents=True, exist_ok=True)
    guard(out, run_at)
    (out / "README.md").write_text(markdown(dashboard_rows(tables, hidden(config), config.probes, config.source), "Data arrival", facts), encoding="utf-8")
    (out / "report.html").write_text(report_html(tables, f"Run {run_id}", hidden(config), config.probes, config.source, facts), encoding="utf-8")
    marked(out, run_id, run_at)
    store.record_stage(run_id, "render", {"out": str(out)})


def publish(config: Config, store: ParquetStore | JdbcStore, run_id: str, out: Path, branch: str) -> None:
    commits = deliver(out, config.remotes, branch, run_id, store.manifest(run_id)["run"]["started_at"])
    store.record_stage(run_id, "publish", {"branch": branch, "commits": commits})


def _chosen(args: argparse.Namespace, spark: SparkSession) -> tuple[Config, ParquetStore | JdbcStore, str]:
    config = load(args.config)
    store = open_store(spark, config)
    run_id = latest(store, args.run_id)
    matching(store, run_id, config)
    return config, store, run_id


def cmd_report(args: argparse.Namespace, spark: SparkSession) -> int:
    config, store, run_id = _chosen(args, spark)
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    probes = tuple(p for p in config.probes if args.probe in (None, p.name))
    if not probes:
        raise ConfigError(f"no probe is named {args.probe}")
    page = report_html(tables_of(store, run_id, args.probe), f"Run {run_id}", hidden(config), probes, config.source, facts_of(config, store.manifest(run_id)))
    (out / "report.html").write_text(page, encoding="utf-8")
    return 0


def cmd_publish(args: argparse.Namespace, spark: SparkSession) -> int:
    config, store, run_id = _chosen(args, spark)
    render(config, store, run_id, Path(args.out))
    if args.deliver:
        publish(config, store, run_id, Path(args.out), args.branch)
    return 0


def cmd_discover(args: argparse.Namespace, spark: SparkSession) -> int:
    """Every table of the source, or those named, by their columns alone: no rows are read."""
    source = load(args.config).source if args.config else {"kind": "parquet", "path": args.path}
    names = args.tables or list_tables(spark, source)
    print(draft_config({t: read_table(spark, source, t) for t in names}, source), end="")
    return 0


def cmd_abort(args: argparse.Namespace, spark: SparkSession) -> int:
    open_store(spark, load(args.config)).abort(args.run_id)
    return 0


def cmd_serve(args: argparse.Namespace, spark: SparkSession) -> int:
    print("serving is not part of this engine; publish writes static pages", file=sys.stderr)
    return 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, f, config: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(f=f)
        if config:
            c.add_argument("--config", action="append", required=True)
        return c

    run = add("run", cmd_run)
    for name in ("--window", "--run-id", "--as-of", "--resume-from"):
        run.add_argument(name)
    run.add_argument("--year", type=int)
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--out")
    for name, f in (("report", cmd_report), ("publish", cmd_publish)):
        c = add(name, f)
        c.add_argument("--run-id")
        c.add_argument("--out", default="site")
        if name == "report":
            c.add_argument("--probe")
    for c in (run, c):
        c.add_argument("--deliver", action="store_true")
        c.add_argument("--branch", default="main")
    d = add("discover", cmd_discover, False)
    where = d.add_mutually_exclusive_group(required=True)
    where.add_argument("--path")
    where.add_argument("--config", action="append")
    d.add_argument("tables", nargs="*")
    add("abort", cmd_abort).add_argument("--run-id", required=True)
    add("serve", cmd_serve)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.f(args, spark or session())
    except (ConfigError, StoreError, DeliveryError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
