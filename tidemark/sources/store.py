"""Snapshot store: parquet tables of a run in a staging folder, committed by one rename."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that every stored row carries, and tables with their types (fixed values of the format).
STAMPS = ("run_id", "as_of", "window_start", "window_end", "config_digest", "started_at", "engine_version", "host_label", "snapshot_schema_version")
SNAPSHOT_VERSION = "6"
PCT = "p50_mean double, p50_std double, p90_mean double, p90_std double, p95_mean double, p95_std double, p99_mean double, p99_std double"
TABLES = {
    "statuses": "probe string, `check` string, severity string, reason string, detail string, status_schema_version long",
    "probe_runs": "probe string, extraction_started string, extraction_finished string, duration_seconds double, execution_mode string, extraction_months long, extraction_start string, n_staged_rows long",
    "population_buckets": "probe string, row_count long, n_eligible long, n_null_event_time long, n_null_load_time_only long, n_negative_lag_excluded long, n_negative_clipped long, n_overflow long, n_join_unmatched long, n_compare_mismatch long, n_base_rows long, n_ambiguous_rows long, other long, distinct_keys long",
    "completion_summary": f"probe string, learned_wait long, horizon long, recommended_wait long, complete_back_to string, negative_lag_excess_fraction double, {PCT}",
    "volume_summary": "probe string, baseline_median double, baseline_sigma double, forecast double, duplicate_rows long, gaps string",
    "completion_percentiles": "probe string, month string, pct long, days long, over_cap boolean, lag_resolution string",
    "month_volumes": "probe string, month string, volume long, state string, expected_low double, expected_high double, nowcast double, deficit boolean",
    "month_lag_cells": "probe string, event_month string, lag_day long, row_count long",
    "epoch_cells": "probe string, load_epoch_day string, row_count long",
    "freshness": "probe string, epoch_count long, last_epoch string, cadence_median_days double, cadence_sigma_days double, days_since_last double",
    "batch_runs": "probe string, batch_id string, rows long",
    "batch_months": "probe string, month string, runs long, null_batch_rows long, days_to_p50 long, days_to_p90 long, days_to_p95 long, days_to_p99 long",
    "dual_summary": "probe string, n_null_source_only long, n_delta_rows long, negative_lag_excess_fraction double",
    "dual_lag_cells": "probe string, event_month string, lag_day long, row_count long",
    "dual_percentiles": "probe string, month string, pct long, days long, over_cap boolean, lag_resolution string",
    "dual_delta": "probe string, delta_day long, row_count long",
    "compare_mismatch": "probe string, month string, mismatches long",
    "parity_months": "probe string, partner string, month string, left_count long, right_count long, diff long, verdict string",
}


class StoreError(RuntimeError):
    pass


@dataclass(frozen=True)
class Run:
    """Identity of a run; its fields are the stamps."""

    run_id: str
    as_of: str
    window_start: str | None
    window_end: str | None
    config_digest: str
    started_at: str
    engine_version: str = "1"
    host_label: str = ""
    snapshot_schema_version: str = SNAPSHOT_VERSION

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,99}", self.run_id):
            raise StoreError(f"{self.run_id!r} is no run id")


class Files:
    """Small files and folders below a root on any filesystem that Spark can open."""

    def __init__(self, spark: SparkSession, root: str | Path):
        text = str(root)
        self.root = text.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else f"file://{Path(text).absolute()}"
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._at(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self._at(path), True)

    def move(self, old: str, new: str) -> bool:
        """Whether old became new; where new is there already, nothing moves."""
        return not self.exists(new) and self.fs.rename(self._at(old), self._at(new))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self._at(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


class ParquetStore:
    """Folders <root>/registered, staging, runs and stages; a run is there whole or not at all.

    The root may be on any filesystem whose rename is atomic.
    """

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.files = spark, Files(spark, root)
        for name in ("registered", "staging", "runs", "stages"):
            self.files.make(name)

    def register(self, run: Run) -> None:
        """Keep the identity, so that a resumed run has the same clock and window; another identity is an error."""
        path, new = f"registered/{run.run_id}.json", f"registered/.{run.run_id}.{uuid.uuid4().hex}"
        if not self.files.exists(path):
            self.files.write(new, json.dumps(asdict(run)))
            if self.files.move(new, path):
                return
            self.files.remove(new)  # another process was first
        old = json.loads(self.files.read(path))
        if {k: v for k, v in old.items() if k != "started_at"} != {k: v for k, v in asdict(run).items() if k != "started_at"}:
            raise StoreError(f"run {run.run_id} is registered with another identity")

    def registered(self, run_id: str) -> Run | None:
        path = f"registered/{run_id}.json"
        return Run(**json.loads(self.files.read(path))) if self.files.exists(path) else None

    def begin(self, run: Run) -> str:
        """Claim the staging folder; the token must be shown to commit."""
        if self.committed(run.run_id):
            raise StoreError(f"run {run.run_id} is committed")
        folder, token = f"staging/{run.run_id}", uuid.uuid4().hex
        self.files.remove(folder)
        self.files.make(folder)
        self.files.write(f"{folder}/claim", token)
        return token

    def _claimed(self, run: Run, token: str) -> str:
        folder = f"staging/{run.run_id}"
        if not self.files.exists(f"{folder}/claim") or self.files.read(f"{folder}/claim") != token:
            raise StoreError(f"run {run.run_id} is claimed by another process")
        return folder

    def write_table(self, run: Run, token: str, name: str, rows: list[dict]) -> None:
        """Stamp and write rows with the table's own types, which are never inferred."""
        folder, kind = self._claimed(run, token), TABLES[name]
        names = [x.split()[0].strip("`") for x in kind.split(", ")]
        df = self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], kind)
        for stamp, value in asdict(run).items():
            df = df.withColumn(stamp, F.lit(value).cast("string"))
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.files.root}/{folder}/{name}")

    def commit(self, run: Run, token: str, manifest: dict) -> None:
        folder = self._claimed(run, token)
        self.files.write(f"{folder}/manifest.json", json.dumps(manifest | {"run": asdict(run), "tables": sorted(TABLES)}, indent=1, default=str))
        self.files.remove(f"{folder}/claim")
        if not self.files.move(folder, f"runs/{run.run_id}"):
            raise StoreError(f"run {run.run_id} is committed")

    def abort(self, run_id: str) -> None:
        self.files.remove(f"staging/{run_id}")

    def committed(self, run_id: str) -> bool:
        return self.files.exists(f"runs/{run_id}/manifest.json")

    def list_runs(self) -> list[str]:
        """Committed runs, oldest start first."""
        return sorted((r for r in self.files.names("runs") if self.committed(r)), key=lambda r: (self.manifest(r)["run"]["started_at"], r))

    def manifest(self, run_id: str) -> dict:
        return json.loads(self.files.read(f"runs/{run_id}/manifest.json"))

    def record_stage(self, run_id: str, stage: str, facts: dict) -> None:
        """Note that a stage after analysis is done; a resumed run leaves it out."""
        self.files.write(f"stages/{run_id}/{stage}.json", json.dumps(facts))

    def stages(self, run_id: str) -> list[str]:
        """Stages of a run that are done."""
        return ["analysis"] * self.committed(run_id) + [n.removesuffix(".json") for n in self.files.names(f"stages/{run_id}")]

    def read_table(self, run_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.files.root}/runs/{run_id}/{name}")

    def prune(self, keep: int, protect: tuple[str, ...] = ()) -> list[str]:
        """Delete all but the newest runs and the protected ones."""
        gone = [r for r in self.list_runs()[: -keep or None] if r not in protect] if keep else []
        for run_id in gone:
            self.files.remove(f"runs/{run_id}")
            self.files.remove(f"stages/{run_id}")
        return gone
