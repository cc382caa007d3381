"""Hand-calculated boundaries, lifecycle and control plane."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.cli import main
from tidemark.config import Analysis, Campaign, Config, ConfigError, Probe, Via, compose, digest, expand_env, parse_config, redact
from tidemark.functions import cron
from tidemark.functions.times import complete_back_to, elapsed_days, extraction_start, normal_watermark
from tidemark.operators import cells as C
from tidemark.operators import classify as K
from tidemark.operators import robust as R
from tidemark.operators.via import JoinNotUnique, assert_unique
from tidemark.plans import assess as A
from tidemark.plans import present as P
from tidemark.plans.probe import Ledger, ScanBudgetExceeded, run_all, run_probe, scans
from tidemark.sources.deliver import deliver, git
from tidemark.sources.jdbc_store import JdbcStore
from tidemark.sources.store import TABLES, ParquetStore, Run, StoreError
from tidemark.sources.tables import candidates, column_types, draft_config, list_tables, match_roles, table_exists
from tidemark.status import Status, exit_code, worst

AS_OF = datetime(2026, 7, 1)
PROBE = Probe("p", "t", "load_time", event_time="event_time")


def months_from(start: date, n: int) -> list[date]:
    at = start.year * 12 + start.month - 1
    return [date((at + i) // 12, (at + i) % 12 + 1, 1) for i in range(n)]


def lag_cells(volumes: dict, lags=((3, 1.0),)) -> list[dict]:
    base = {"grouping_id": C.MONTH_LAG, "load_epoch": None, "batch_id": None, "n_compare_mismatch": 0}
    return [base | {"event_month": m, "lag_day": d, "row_count": round(v * share)} for m, v in volumes.items() for d, share in lags]


def world(n: int, **more) -> dict:
    return {"row_count": n, "n_eligible": n, "n_null_event_time": 0, "n_null_load_time_only": 0, "n_negative_lag_excluded": 0, "n_join_unmatched": 0} | more


def volume_of(volumes: dict, as_of=AS_OF, analysis=None, lags=((3, 1.0),)):
    probe = Probe("p", "t", "load_time", event_time="event_time", analysis=analysis or Analysis(evaluation_window_months=3))
    cells = lag_cells(volumes, lags)
    done = A.assess_completion(cells, world(sum(volumes.values())), probe, as_of)
    return A.assess_volume(cells, world(sum(volumes.values())), probe, as_of, done)


def reasons(x) -> list[tuple[str, str]]:
    return [(s.reason, s.severity) for s in x.statuses if s.reason]


def flat(n=24, rows=2000, start=date(2023, 1, 1)) -> dict:
    return dict.fromkeys(months_from(start, n), rows)


def test_robust_statistics():
    assert R.mad([1, 2, 3, 10]) == 1.0
    assert R.floored_sigma([2000] * 6) == 100
    assert R.recommended_wait([10, 12, 14]) == 16
    assert R.fill_band(1000, 0.5, 100, 2) == (400, 600)


@pytest.mark.parametrize("rows, expected", [(2200, []), (2210, [("volume_outlier", "AMBER")]), (2310, [("volume_outlier", "RED")])])
def test_volume_band_is_strict(rows, expected):
    v = flat()
    v[date(2023, 6, 1)] = rows
    assert reasons(volume_of(v)) == expected


@pytest.mark.parametrize(
    "tail, expected",
    [
        ([100], [("volume_outlier", "RED")]),
        ([100, 100], [("volume_collapse", "RED")]),
        ([100, 100, 2000], [("volume_outlier", "RED")] * 2),
    ],
)
def test_collapse_needs_two_months_at_the_end(tail, expected):
    v = flat()
    for m, n in zip(list(v)[-len(tail) :], tail):
        v[m] = n
    assert reasons(volume_of(v)) == expected


def test_a_gap_breaks_the_run():
    v = flat()
    months = list(v)
    v[months[-3]] = v[months[-1]] = 100
    del v[months[-2]]
    assert reasons(volume_of(v)) == [("volume_gap", "RED"), ("volume_outlier", "RED"), ("volume_outlier", "RED")]


def test_no_rows_is_red():
    assert reasons(volume_of({})) == [("zero_row_month", "RED")]


def test_still_filling_deficit():
    v = flat(30, start=date(2023, 6, 1))
    last = list(v)[-1]
    v[last] = 200
    found = volume_of(v, as_of=datetime(2026, 1, 1))
    assert found.states[last] == "immature" and ("arrival_deficit", "AMBER") in reasons(found)


def completion_of(lags_of: dict, as_of=AS_OF, analysis=None):
    probe = Probe("p", "t", "load_time", event_time="event_time", analysis=analysis or Analysis())
    cells = [c for m, lags in lags_of.items() for c in lag_cells({m: 1000}, lags)]
    return A.assess_completion(cells, world(1000 * len(lags_of)), probe, as_of)


def test_completion_wait_and_back_to():
    done = completion_of(dict.fromkeys(months_from(date(2023, 1, 1), 24), ((3, 0.6), (10, 0.3), (20, 0.1))))
    assert (done.learned_wait, done.horizon, done.wait) == (20, 365, 20)
    assert done.days[date(2023, 1, 1)] == {50: 3, 90: 10, 95: 20, 99: 20}
    assert done.back_to == date(2026, 6, 11) and done.curve[9] == 0.6 and done.curve[10] == 0.9
    assert [s.severity for s in done.statuses] == ["GREEN", "GREEN"]


def test_backtest_disagreement_and_censoring():
    months = months_from(date(2022, 1, 1), 24)
    drift = completion_of({m: (((7, 1.0),) if i < 12 else ((90, 1.0),)) for i, m in enumerate(months)})
    assert drift.learned_wait is None and ("backtest_disagreement", "INSUFFICIENT_HISTORY") in reasons(drift)
    half = completion_of({m: (((7, 1.0),) if i < 7 else ((7, 0.92), (366, 0.08))) for i, m in enumerate(months[:13])})
    assert ("backtest_disagreement", "INSUFFICIENT_HISTORY") in reasons(half) and ("percentile_over_cap", "INSUFFICIENT_HISTORY") in reasons(half)


def test_no_training_month_is_no_green():
    done = completion_of({date(2026, 5, 1): ((3, 1.0),)})
    assert reasons(done) == [("insufficient_mature_months", "INSUFFICIENT_HISTORY")] and done.horizon is None


def test_negative_lag_and_reconciliation():
    probe = PROBE
    done = A.assess_completion([], world(1000, n_eligible=990, n_negative_lag_excluded=10), probe, AS_OF)
    assert ("negative_lag_excess", "RED") in reasons(done) and done.excess == 0.01
    done = A.assess_completion([], world(1000, n_eligible=999), probe, AS_OF)
    assert ("reconciliation_mismatch", "RED") in reasons(done)


@pytest.mark.parametrize("since, severity", [(8.5, "GREEN"), (9.0, "GREEN"), (9.5, "AMBER"), (10.0, "AMBER"), (10.5, "RED")])
def test_freshness_bands(since, severity):
    last = datetime(2026, 6, 1)
    cells = [{"grouping_id": C.EPOCH, "load_epoch": last - timedelta(days=7 * i)} for i in range(8)]
    found = A.assess_freshness(cells, PROBE, last + timedelta(days=since))
    assert (found.cadence, found.sigma, found.statuses[0].severity) == (7.0, 1.0, severity)


def test_freshness_needs_epochs():
    one = [{"grouping_id": C.EPOCH, "load_epoch": datetime(2026, 6, 1)}]
    probe = Probe("p", "t", "load_time", event_time="event_time", analysis=Analysis(freshness_min_epochs=1))
    assert reasons(A.assess_freshness(one, probe, AS_OF)) == [("insufficient_epochs", "INSUFFICIENT_HISTORY")]


def batch_cells(early=False):
    out, m = [], date(2025, 1, 1)
    for day, share in ((3, 0.6), (10, 0.3), (20, 0.1)):
        ts = datetime(2025, 2, 1) + timedelta(days=day)
        out.append({"grouping_id": C.MONTH_BATCH, "event_month": m, "batch_id": f"run{day}", "n_eligible": 1000 * share, "min_load_time": ts})
    if early:  # rows without a month date the first batch earlier
        out.append({"grouping_id": C.MONTH_BATCH, "event_month": None, "batch_id": "run3", "n_eligible": 0, "min_load_time": datetime(2025, 2, 2)})
    return out + lag_cells({m: 1000})


def test_batch_schedule():
    probe = Probe("p", "t", "load_time", event_time="event_time", batch_col="batch_id")
    month = A.assess_batch(batch_cells(), probe).months[date(2025, 1, 1)]
    assert month["runs"] == 3 and month["days"][50] == 3 and month["days"][95] == month["days"][99] == 20
    assert A.assess_batch(batch_cells(True), probe).months[date(2025, 1, 1)]["days"][50] == 1


def side(name, volumes, **more):
    probe = Probe(name, "t", "load_time", event_time="event_time", key_cols=("k",), **more)
    cells = lag_cells(volumes)
    return A.Side(probe, cells, A.assess_completion(cells, world(sum(volumes.values())), probe, AS_OF), 0)


def test_parity():
    left, right = flat(), flat()
    del right[date(2024, 1, 1)]
    right[date(2024, 3, 1)] -= 50
    found = A.assess_parity(side("l", left), side("r", right), AS_OF)
    assert [(r["verdict"], r["diff"]) for r in found.rows if r["verdict"] != "match"] == [("left_only", 2000), ("mismatch", 50)]
    easy = A.assess_parity(side("l", left, analysis=Analysis(parity_tolerance=100)), side("r", left | {date(2024, 3, 1): 1950}), AS_OF)
    assert [s.severity for s in easy.statuses] == ["GREEN"]
    assert A.assess_parity(side("l", left, read_uncommitted=True), side("r", left), AS_OF).statuses[0].reason == "parity_prereq_read_uncommitted"
    assert A.assess_parity(side("l", left), None, AS_OF).statuses[0].reason == "parity_prereq_uniqueness"
    with pytest.raises(ValueError):
        A.assess_parity(side("l", left, parity_with="x"), side("r", left), AS_OF)
    one, two = side("l", left), side("r", left)
    one.null_load, two.null_load = 7, 2
    assert A.assess_parity(one, two, AS_OF).null_load == (7, 2)


def frame(spark, rows, kind="event_time timestamp_ntz, load_time timestamp_ntz, k long"):
    return spark.createDataFrame(rows, kind)


def test_row_classes(spark):
    e = datetime(2026, 1, 10, 23, 59, 59)
    rows = [(e, e + timedelta(seconds=2), 1), (None, e, 2), (e, None, 3), (e, e - timedelta(days=5), 4), (e, e - timedelta(hours=25), 5), (e, e + timedelta(days=400), 6), (None, None, 7), (e, AS_OF + timedelta(days=3000), 8)]
    staged = K.staging(frame(spark, rows), PROBE, AS_OF + timedelta(days=1000)).select("lag_day", *K.FLAGS[1:7]).collect()
    assert sorted((r["lag_day"] is None, r["lag_day"]) for r in staged if r["lag_day"] is not None) == [(False, -1), (False, 0), (False, 1), (False, 366)]
    assert [sum(r[f] for r in staged) for f in K.FLAGS[1:7]] == [2, 1, 1, 3, 1, 1]


def test_empty_table_has_a_global_row(spark):
    staged = K.staging(frame(spark, []), PROBE, AS_OF)
    assert [r["grouping_id"] for r in C.canonical_pass(staged).collect()] == [C.GLOBAL]
    assert C.derived_global_row(C.canonical_cells(staged)).first()["row_count"] == 0


def test_cell_cap(spark):
    e = datetime(2026, 1, 10)
    staged = K.staging(frame(spark, [(e, e + timedelta(days=i), i) for i in range(5)]), PROBE, AS_OF)
    C.check_cap(C.canonical_cells(staged), 5)
    with pytest.raises(C.CellCapExceeded):
        C.check_cap(C.canonical_cells(staged), 4)
    assert C.bounded(C.canonical_cells(staged), 1).count() == len(C.SETS) + 2 and C.bounded(C.canonical_cells(staged), 5).count() == C.canonical_cells(staged).count()


def test_keys_with_nulls_are_counted(spark):
    d = spark.createDataFrame([(1, 2), (1, None), (1, None), (None, None)], "a int, b int")
    assert d.select(F.countDistinct(K.key_of(["a", "b"]))).first()[0] == 3
    assert d.select(F.countDistinct(K.key_hash(["a", "b"]))).first()[0] == 3


def test_via_join(spark):
    via = Via("lk", (("ref", "id"),), "event_time")
    probe = Probe("v", "b", "load_time", event_time_via=via)
    e = datetime(2026, 1, 1)
    base = spark.createDataFrame([(1, e), (2, e), (9, e), (None, e)], "ref long, load_time timestamp_ntz")
    lookup = spark.createDataFrame([(1, e), (2, None), (3, e)], "id long, event_time timestamp_ntz")
    row = C.global_row(K.staging(base, probe, AS_OF, lookup)).first()
    assert (row["row_count"], row["n_join_unmatched"], row["n_null_event_time"], row["n_eligible"], row["n_base_rows"], row["lookup_dup_max"]) == (4, 2, 1, 1, 4, 1)
    twice = lookup.union(spark.createDataFrame([(3, e)], lookup.schema))  # no base row refers to it
    with pytest.raises(JoinNotUnique):
        assert_unique(twice, via)
    assert C.global_row(K.staging(base, probe, AS_OF, twice)).first()["lookup_dup_max"] == 2


def test_scan_budget(spark, tmp_path):
    frame(spark, [(AS_OF, AS_OF, 1)]).write.parquet(str(tmp_path / "t"))
    staged = K.staging(spark.read.parquet(str(tmp_path / "t")), PROBE, AS_OF)
    assert scans(C.canonical_cells(staged)) == 1
    ledger = Ledger(1)
    for _ in range(3):
        ledger.enter(staged)
    with pytest.raises(ScanBudgetExceeded):
        ledger.enter(staged)


def test_days(spark):
    row = spark.range(1).select(F.datediff(F.lit("2026-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2026-01-01 23:59:59").cast("timestamp_ntz")).alias("d"), elapsed_days(F.lit("2026-01-01 12:00:00").cast("timestamp_ntz"), F.lit("2026-01-03 00:00:00").cast("timestamp_ntz")).alias("e")).first()
    assert (row["d"], row["e"]) == (1, 1.5)
    assert extraction_start(datetime(2026, 7, 15), 36) == date(2023, 8, 1)
    assert normal_watermark(datetime.fromisoformat("2026-01-01T02:00:00.5+02:00")) == datetime(2026, 1, 1)
    assert complete_back_to(datetime(2026, 1, 10), 3) == date(2026, 1, 7)


def test_cron():
    fire = lambda x, at, zone="UTC": cron.next_fire(x, at, zone).replace(tzinfo=None)
    assert fire("0 6 * * 1", datetime(2026, 7, 9)) == datetime(2026, 7, 13, 6)
    assert fire("0 6 29 2 *", datetime(2026, 7, 9)) == datetime(2028, 2, 29, 6)
    assert fire("30 1 * * *", datetime(2026, 3, 29, 0, 30), "Europe/London") == datetime(2026, 3, 30, 1, 30)
    assert cron.matches("0 0 1 * 1", datetime(2026, 7, 6)) and cron.matches("0 0 1 * 1", datetime(2026, 7, 1))
    assert cron.next_expected("0 6 * * *", datetime(2026, 7, 9, 7), "UTC", 6).replace(tzinfo=None) == datetime(2026, 7, 10, 12)
    assert cron.next_expected(None, datetime(2026, 7, 9)) is None
    with pytest.raises(ValueError):
        cron.parse("61 * * * *")


def test_status_rules():
    with pytest.raises(ValueError):
        Status("volume", "GREEN", "volume_gap")
    with pytest.raises(ValueError):
        Status("volume", "AMBER", "volume_gap")
    assert worst(["GREEN", "SKIPPED", "AMBER"]) == "AMBER"
    assert exit_code([Status("volume", "RED", "volume_gap")]) == 2 and exit_code([]) == 0 and exit_code([], True) == 1


def test_config():
    raw = {"schema_version": 4, "source": {"path": "x", "password": "p"}, "store": {"path": "s"}, "probes": [{"name": "a", "table": "t", "load_time": "l", "event_time": "e", "parity_with": "b"}, {"name": "b", "table": "u", "load_time": "l", "event_time_via": {"join_table": "j", "on": [{"base_col": "x", "lookup_col": "y"}], "column": "c"}}]}
    config = parse_config(raw)
    assert config.probes[1].event_time_via.on == (("x", "y"),) and len(digest(config)) == 64
    assert redact({"password": "p", "url": "https://u:p@h/x"}) == {"password": "***", "url": "https://u:***@h/x"}
    assert expand_env({"a": "${X}/y"}, {"X": "z"}) == {"a": "z/y"}
    for wrong in ({"schema_version": 3}, {"probes": []}, {"probes": [raw["probes"][0] | {"oops": 1}]}, {"probes": [raw["probes"][0]]}, {"analysis": {"lag_cap_days": 400}}, {"delivery": {"remotes": ["https://u:p@h/r"]}}):
        with pytest.raises(ConfigError):
            parse_config(raw | wrong)
    with pytest.raises(ConfigError):
        compose([config, config])
    with pytest.raises(ConfigError):
        Analysis(extraction_months=12)


def test_discovery(spark):
    times = spark.createDataFrame([], "recorded_at timestamp, ingested_at timestamp, created_at date, load_batch string, event_day date, run_no int")
    assert candidates(times)["event_time"] == ["event_day", "recorded_at", "ingested_at", "created_at"] and candidates(times)["load_time"] == ["ingested_at"]
    assert match_roles(times) == {"load_time": ["ingested_at"], "source_insert_time": ["created_at"], "event_time": ["event_day", "recorded_at"], "batch_col": ["load_batch", "run_no"]}
    assert match_roles(times, {"event_time": ("RECORDED",)})["event_time"] == ["recorded_at"]
    text = draft_config({"a/b": times, "a_b": times}, {"kind": "parquet", "password": "p"})
    for line in ('event_time: "event_day"  # other candidates: recorded_at', "event_resolution: date", '# batch_col: "load_batch"', 'name: "a_b"', 'name: "a_b_2"', 'password: "***"'):
        assert line in text
    d = spark.createDataFrame([], "k long, OrderRef string, recorded_at timestamp")
    assert column_types(d, ["orderref"]) == {"orderref": "string"}
    with pytest.raises(KeyError):
        column_types(d, ["nope"])
    assert "load_time: FIXME" in draft_config({"t": d}, {"kind": "parquet"})


def test_presentation():
    tables = {"month_lag_cells": [{"probe": "p", "event_month": "2026-01-01", "lag_day": d, "row_count": n} for d, n in ((-1, 9), (0, 60), (8, 40), (9, 3))], "month_volumes": [{"probe": "p", "month": "2026-01-01", "volume": 103, "state": "mature"}], "volume_summary": [{"probe": "p", "baseline_median": 50.0, "baseline_sigma": 10.0}], "statuses": [{"probe": "p", "check": "volume", "severity": "AMBER", "reason": "volume_outlier", "detail": ""}]}
    data = P.figure_data(P.frames_for_probe(tables, "p", True))
    assert data["volume"][0]["mark"] == "red"
    assert [r["share"] for r in data["completion_curves"] if r["month"] != "mature"] == [0.6, 1.0]  # the small cell is hidden
    assert P.dashboard_rows(tables)[0]["healthy"] == "AMBER"
    page = P.report_html(tables, "t")
    assert "default-src 'none'" in page and "http-equiv" in page and "<svg" in page
    assert P.display_count(3, True) == "<5" and P.display_count(None) == "—"
    assert A.p95_text((12.4, 2.6), None) == "12 ± 3 d" and A.p95_text((12.4, 2.6), None, True) == "0.4 mo" and A.p95_text((12.5, None), None) == "12 d"
    assert A.p95_text(None, 365) == "> 365 d" and A.p95_text(None, 365, True) == "> 12.0 mo" and A.p95_text(None, None, True) == "—"


def test_dashboard_cells():
    row = lambda statuses, probe=PROBE, done=(): P.dashboard_rows({"statuses": [{"probe": "p", "detail": "", **s} for s in statuses], "completion_summary": list(done)}, probes=(probe,), source={"path": "/d", "schema": "s"})[0]
    red = {"check": "probe", "severity": "RED", "reason": "missing_table"}
    over = lambda check: {"check": check, "severity": "INSUFFICIENT_HISTORY", "reason": "percentile_over_cap"}
    assert [row([red])[k] for k in ("database", "table", "healthy", "updating", "p95")] == ["/d", "s.t", "RED", P.NO_STATUS, "—"]
    assert row([over("completion")])["p95"] == "> 365 d" and row([over("dual_lag")])["p95"] == "—"  # the column is of the load lag
    bounded = Probe("p", "t", "load_time", event_time="event_time", analysis=Analysis(extraction_months=24))
    assert row([red], bounded)["probe"] == "p (≤24m)" and row([])["healthy"] == P.NO_STATUS
    assert row([red], done=[{"probe": "p", "p95_mean": 2.5, "p95_std": 12.5}])["p95"] == "2 ± 12 d"
    assert P.expected_by(Campaign("0 6 * * 1", "Europe/London", 6), "2026-07-09T10:00:00") == "2026-07-13 12:00 Europe/London"
    assert P.expected_by(Campaign(), "2026-07-09T10:00:00+00:00") == "manual runs only"


def test_figures_mark_and_band():
    months = [{"probe": "p", "month": f"2026-0{i}-01", "volume": v, "state": s, "expected_low": low, "deficit": d} for i, v, s, low, d in ((1, 100, "mature", None, None), (2, 135, "mature", None, None), (3, 40, "immature", 60.0, True))]
    cells = [{"probe": "p", "event_month": f"2026-0{i}-01", "lag_day": d, "row_count": 50} for i in (1, 2) for d in (0, i)]
    pcts = [{"probe": "p", "month": f"2026-0{i}-01", "pct": p, "days": d, "over_cap": d is None} for i in (1, 2) for p, d in ((50, 0), (95, None if i == 2 else 1))]
    frames = {"month_volumes": months, "month_lag_cells": cells, "completion_percentiles": pcts, "volume_summary": [{"baseline_median": 100.0, "baseline_sigma": 10.0}], "completion_summary": [{"p50_mean": 1.0, "p50_std": 0.5, "p95_mean": None, "p95_std": None}]}
    frames["batch_months"] = [{"month": "2026-01-01", "runs": 2, "null_batch_rows": 1, "days_to_p50": 3, "days_to_p90": None, "days_to_p95": None, "days_to_p99": None}]
    wide = Probe("p", "t", "load_time", event_time="event_time", proxy=True, analysis=Analysis(volume_amber_mads=3, volume_red_mads=4))
    assert [[r["mark"] for r in P.figure_data(frames, p)["volume"]] for p in (None, wide)] == [[None, "red", "deficit"], [None, "amber", "deficit"]]
    svg = {k: P.figure_svg(k, v, wide) for k, v in P.figure_data(frames, wide).items()}
    assert "arrival deficit" in svg["volume"] and "expected so far (low)" in svg["volume"] and "proxy times" in svg["volume"]
    assert "p10 to p90" in svg["completion_curves"] and "one deviation" in svg["percentiles"] and "95 % beyond the cap" in svg["percentiles"]
    assert "days to 50 %" in svg["batch"] and "rows of no batch" in svg["batch"]
    assert svg == {k: P.figure_svg(k, v, wide) for k, v in P.figure_data(frames, wide).items()}


@pytest.fixture(scope="module")
def world_dir(spark, tmp_path_factory):
    """Two like tables of 20 months, a via pair, and a configuration."""
    root = tmp_path_factory.mktemp("world")
    d = spark.range(20 * 300).select(F.col("id").alias("k"), (F.add_months(F.lit("2023-01-01").cast("date"), F.floor(F.col("id") / 300).cast("int")).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 27).cast("int"))).alias("event_time"))
    d = d.withColumn("source_time", F.col("event_time") + F.expr("interval 2 day")).withColumn("load_time", F.col("event_time") + F.make_dt_interval((F.col("k") % 9 + 2).cast("int"))).withColumn("batch", F.date_format("load_time", "yyyy-MM"))
    for name in ("orders", "replica"):
        d.write.parquet(f"{root}/{name}.parquet")
    d.select("k", "load_time").write.parquet(f"{root}/lines.parquet")
    raw = {
        "schema_version": 4,
        "source": {"kind": "parquet", "path": str(root)},
        "store": {"backend": "parquet", "path": f"{root}/store", "retention": 2},
        "probes": [
            {"name": "orders", "table": "orders", "load_time": "load_time", "event_time": "event_time", "source_insert_time": "source_time", "compare_event_time": "source_time", "key_cols": ["k"], "batch_col": "batch", "parity_with": "replica"},
            {"name": "replica", "table": "replica", "load_time": "load_time", "event_time": "event_time", "key_cols": ["k"]},
            {"name": "lines", "table": "lines", "load_time": "load_time", "event_time_via": {"join_table": "orders", "on": [{"base_col": "k", "lookup_col": "k"}], "column": "event_time"}},
            {"name": "absent", "table": "absent", "load_time": "load_time", "event_time": "event_time", "optional": True},
        ],
    }
    (root / "c.json").write_text(json.dumps(raw))
    return root


def test_run_of_all_probes(spark, world_dir):
    config = parse_config(json.loads((world_dir / "c.json").read_text()))
    tables, code = run_all(spark, config.source, config.probes, datetime(2025, 7, 1))
    bad = [s for s in tables["statuses"] if s["severity"] in ("RED", "AMBER", "INDETERMINATE") and s["check"] != "freshness"]
    assert not bad and code in (0, 2)
    assert {(s["probe"], s["severity"]) for s in tables["statuses"] if s["check"] == "probe"} == {("absent", "SKIPPED")}
    assert {r["verdict"] for r in tables["parity_months"]} == {"match"}
    assert [(r["delta_day"], r["row_count"]) for r in tables["dual_delta"]][0][0] == 0
    direct, borrowed = ([(r["month"], r["pct"], r["days"]) for r in tables["completion_percentiles"] if r["probe"] == p] for p in ("orders", "lines"))
    assert direct == borrowed


def run_of(spark, path, rows, probe, as_of=AS_OF, kind="event_time timestamp_ntz, load_time timestamp_ntz, source_time timestamp_ntz, batch string"):
    spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/t.parquet")
    return run_probe(spark, {"kind": "parquet", "path": str(path)}, probe, as_of)


def test_batches_of_the_runner(spark, tmp_path):
    """A batch first seen on a row of no event time came then; one with no eligible row is a run all the same."""
    e, end = datetime(2025, 1, 10), datetime(2025, 2, 1)
    rows = [(e, end + timedelta(days=9), None, "a")] * 6 + [(None, end, None, "a")] + [(e, end + timedelta(days=12), None, "b")] * 4
    rows += [(e, e - timedelta(days=8), None, "early"), (datetime(2024, 12, 5), datetime(2024, 11, 1), None, "early"), (datetime(2024, 11, 5), end, None, None)]
    found = run_of(spark, tmp_path, rows, Probe("p", "t", "load_time", event_time="event_time", batch_col="batch"))
    months = {r["month"]: r for r in found.tables["batch_months"]}
    january = months["2025-01-01"]
    assert (january["days_to_p50"], january["days_to_p90"], january["runs"]) == (0, 12, 3)
    assert (months["2024-12-01"]["runs"], months["2024-12-01"]["days_to_p50"]) == (1, None)
    assert (months["2024-11-01"]["runs"], months["2024-11-01"]["null_batch_rows"], months["2024-11-01"]["days_to_p50"]) == (0, 1, None)
    assert {r["batch_id"]: r["rows"] for r in found.tables["batch_runs"]} == {"a": 6, "b": 4, "early": 0}
    assert found.tables["freshness"][0]["last_epoch"] == (end + timedelta(days=12)).isoformat() and found.tables["freshness"][0]["epoch_count"] == 3


def test_dual_lag_of_the_runner_is_censored(spark, tmp_path):
    """Any percentile of any month beyond the cap keeps the check from GREEN."""
    e = datetime(2026, 6, 10)
    rows = [(e, e + timedelta(days=5), e + timedelta(days=3 if i < 97 else 400), None) for i in range(100)]
    probe = Probe("p", "t", "load_time", event_time="event_time", source_insert_time="source_time")
    found = run_of(spark, tmp_path, rows, probe)
    assert [(s.severity, s.reason) for s in found.statuses if s.check == "dual_lag"] == [("INSUFFICIENT_HISTORY", "percentile_over_cap")]
    fine = run_of(spark, tmp_path, rows[:97], probe)
    assert [s.severity for s in fine.statuses if s.check == "dual_lag"] == ["GREEN"]


def test_join_is_reconciled(spark, tmp_path):
    probe = Probe("p", "t", "load_time", event_time_via=Via("lk", (("batch", "id"),), "event_time"))
    found = A.assess_completion([], world(10, n_base_rows=7), probe, AS_OF)
    assert ("reconciliation_mismatch", "RED") in reasons(found)
    assert ("reconciliation_mismatch", "RED") not in reasons(A.assess_completion([], world(10, n_base_rows=10), probe, AS_OF))
    e = datetime(2025, 1, 10)
    spark.createDataFrame([("x", e), (None, e)], "id string, event_time timestamp_ntz").write.parquet(f"{tmp_path}/lk.parquet")
    rows = [(None, e, None, "x")] * 3 + [(None, e, None, None)] * 2 + [(None, e, None, "y")]
    buckets = run_of(spark, tmp_path, rows, probe).tables["population_buckets"][0]
    assert (buckets["row_count"], buckets["n_base_rows"], buckets["n_join_unmatched"], buckets["n_eligible"]) == (6, 6, 3, 3)


def test_tables_of_a_database(spark):
    """A missing table is told apart from a source that cannot be reached."""
    source = {"kind": "jdbc", "options": database(spark, "probe"), "tables_query": "SELECT TABLENAME AS NAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'"}
    spark.createDataFrame([(1, AS_OF)], "k int, load_time timestamp").write.format("jdbc").options(**source["options"]).option("dbtable", "arrivals").mode("overwrite").save()
    assert table_exists(spark, source, "arrivals") and not table_exists(spark, source, "nothing")
    assert list_tables(spark, source) == ["ARRIVALS"]
    with pytest.raises(Exception):
        table_exists(spark, source | {"options": source["options"] | {"url": "jdbc:derby:memory:elsewhere"}}, "arrivals")


def test_missing_and_broken_tables(spark, world_dir):
    source = {"kind": "parquet", "path": str(world_dir)}
    lost = run_probe(spark, source, Probe("x", "nothing", "l", event_time="e"), AS_OF)
    assert reasons(lost) == [("missing_table", "RED")] and set(lost.tables) == {"probe_runs"}
    assert reasons(run_probe(spark, source, Probe("x", "orders", "no_such", event_time="event_time"), AS_OF)) == [("missing_table", "RED")]
    capped = Probe("x", "orders", "load_time", event_time="event_time", analysis=Analysis(result_cell_cap=3))
    assert reasons(run_probe(spark, source, capped, AS_OF)) == [("result_cell_cap_exceeded", "RED")]
    clash = Probe("x", "lines", "load_time", event_time_via=Via("orders", (("k", "batch"),), "event_time"))
    assert reasons(run_probe(spark, source, clash, AS_OF)) == [("join_not_unique", "RED")]


def test_command_line_lifecycle(spark, world_dir, capsys, tmp_path):
    conf = str(world_dir / "c.json")
    assert main(["run", "--config", conf, "--as-of", "2025-07-01", "--dry-run"], spark) == 0
    assert main(["run", "--config", conf, "--as-of", "2024-09-15", "--run-id", "one", "--year", "2023"], spark) in (0, 2)
    store = ParquetStore(spark, world_dir / "store")
    assert store.list_runs() == ["one"]
    months = {r["month"][:4] for r in store.read_table("one", "completion_percentiles").collect()}
    assert months == {"2023"} and store.read_table("one", "month_volumes").count() > 24
    assert {"run_id", "config_digest"} <= set(store.read_table("one", "statuses").columns)
    assert main(["run", "--config", conf, "--as-of", "2024-09-15", "--run-id", "one"], spark) == 1  # another identity
    assert main(["run", "--config", conf, "--window", "3d"], spark) == 1
    assert main(["report", "--config", conf, "--out", str(tmp_path / "r")], spark) == 0
    assert main(["report", "--config", conf, "--probe", "lines", "--out", str(tmp_path / "l")], spark) == 0
    assert "<h2>lines</h2>" in (tmp_path / "l/report.html").read_text() and "replica" not in (tmp_path / "l/report.html").read_text()
    assert main(["report", "--config", conf, "--probe", "none"], spark) == 1
    assert main(["publish", "--config", conf, "--out", str(tmp_path / "p")], spark) == 0
    page = (tmp_path / "p/README.md").read_text()
    assert "orders" in page and "manual runs only" in page and json.loads((tmp_path / "p/published.json").read_text())["run_id"] == "one"
    assert store.stages("one") == ["analysis", "render"]
    assert main(["run", "--config", conf, "--as-of", "2024-09-15", "--run-id", "two", "--out", str(tmp_path / "p")], spark) in (0, 2)
    assert main(["publish", "--config", conf, "--run-id", "one", "--out", str(tmp_path / "p")], spark) == 1  # a later run is there
    store.files.remove("stages/two/render.json")
    assert main(["run", "--config", conf, "--resume-from", "two", "--out", str(tmp_path / "q")], spark) in (0, 2)  # goes on with its pages
    assert (tmp_path / "q/report.html").exists() and store.stages("two") == ["analysis", "render"]
    assert main(["discover", "--path", str(world_dir)], spark) == 0 and "replica" in capsys.readouterr().out
    assert main(["serve", "--config", conf], spark) == 1
    assert main(["discover", "--path", str(world_dir), "orders"], spark) == 0
    assert 'event_time: "event_time"' in capsys.readouterr().out


def database(spark, name):
    """Options of an embedded database in memory, where there is one."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no embedded database")
    return {"url": f"jdbc:derby:memory:{name};create=true", "driver": driver}


def test_catalog_source(spark):
    source = {"kind": "catalog", "database": "probed"}
    spark.sql("CREATE DATABASE IF NOT EXISTS probed")
    frame(spark, [(AS_OF, AS_OF, 1)]).write.mode("overwrite").saveAsTable("probed.arrivals")
    assert list_tables(spark, source) == ["arrivals"] and table_exists(spark, source, "arrivals") and not table_exists(spark, source, "nothing")
    found = run_probe(spark, source, Probe("x", "arrivals", "load_time", event_time="event_time"), AS_OF)
    assert found.tables["population_buckets"][0]["row_count"] == 1
    assert reasons(run_probe(spark, source, Probe("x", "nothing", "load_time", event_time="event_time"), AS_OF)) == [("missing_table", "RED")]
    spark.sql("DROP DATABASE probed CASCADE")


def test_run_into_a_database(spark, world_dir, tmp_path):
    raw = json.loads((world_dir / "c.json").read_text())
    raw["store"] = {"backend": "jdbc", "options": database(spark, "runs")}
    raw["probes"] = [p for p in raw["probes"] if p["name"] == "lines"]
    (tmp_path / "c.json").write_text(json.dumps(raw))
    conf = str(tmp_path / "c.json")
    assert main(["run", "--config", conf, "--as-of", "2025-07-01", "--run-id", "one", "--out", str(tmp_path / "p")], spark) in (0, 2)
    assert "lines" in (tmp_path / "p/README.md").read_text()
    with pytest.raises(ConfigError):
        parse_config(raw | {"store": {"backend": "jdbc"}})


@pytest.mark.parametrize("kind", ["parquet", "jdbc"])
def test_store_claims_and_prune(spark, tmp_path, kind):
    store = ParquetStore(spark, tmp_path) if kind == "parquet" else JdbcStore(spark, database(spark, "store"))
    run = Run("r1", "2026-01-01", None, None, "d", "1")
    store.register(run)
    first, second = store.begin(run), store.begin(run)
    with pytest.raises(StoreError):
        store.write_table(run, first, "statuses", [])
    for name in TABLES:
        store.write_table(run, second, name, [])
    store.write_table(run, second, "statuses", [{"probe": "p", "check": "volume", "severity": "GREEN"}])
    store.commit(run, second, {})
    assert store.list_runs() == ["r1"] and store.read_table("r1", "statuses").count() == 1
    with pytest.raises(StoreError):
        store.begin(run)
    with pytest.raises(StoreError):
        Run("../x", "a", None, None, "d", "1")
    store.record_stage("r1", "render", {"out": "x"})
    assert store.stages("r1") == ["analysis", "render"] and store.registered("r1") == run and store.manifest("r1")["run"]["run_id"] == "r1"
    with pytest.raises(StoreError):
        store.register(Run("r1", "2026-01-02", None, None, "d", "1"))
    for i in (2, 3):
        r = Run(f"r{i}", "2026-01-01", None, None, "d", str(i))
        store.register(r)
        store.commit(r, store.begin(r), {})
    assert store.prune(1, ("r1",)) == ["r2"] and store.list_runs() == ["r1", "r3"]
    assert set(TABLES) >= {"statuses", "parity_months"}


def test_delivery(tmp_path):
    import subprocess

    remotes = [str(tmp_path / f"{i}.git") for i in range(2)]
    for r in remotes:
        subprocess.run(["git", "init", "-q", "--bare", "-b", "main", r], check=True)
    files = tmp_path / "files"
    files.mkdir()
    (files / "README.md").write_text("x")
    assert len(deliver(files, tuple(remotes), "main", "r1", "2026-01-02")) == 2
    before = [git(tmp_path, "ls-remote", r, "main") for r in remotes]
    with pytest.raises(Exception):
        deliver(files, tuple(remotes), "main", "r0", "2026-01-01")  # not before what is there
    with pytest.raises(Exception):
        deliver(files, (remotes[0], str(tmp_path / "none.git")), "main", "r2", "2026-01-03")
    assert [git(tmp_path, "ls-remote", r, "main") for r in remotes] == before


def test_config_type():
    assert Config((PROBE,), {}, "s").remotes == ()
