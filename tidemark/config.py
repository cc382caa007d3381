"""Typed configuration of probes, its checks, campaigns, digest and redaction."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

SCHEMA_VERSION = 4
DAYS_A_MONTH = 30.4375
PERCENTS = (50, 90, 95, 99)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Analysis:
    """Parameters of all metrics; the defaults are fixed values of the method."""

    training_cutoff_days: int = 365
    lag_cap_days: int = 365
    extraction_months: int | None = None
    clock_skew_tolerance_days: float = 1.0
    negative_lag_red_fraction: float = 0.001
    min_mature_months: int = 6
    evaluation_window_months: int = 3
    freshness_bucket: str = "day"
    freshness_min_epochs: int = 5
    freshness_zero_mad_tolerance_days: float = 1.0
    freshness_amber_mads: float = 2.0
    freshness_red_mads: float = 3.0
    volume_amber_mads: float = 2.0
    volume_red_mads: float = 3.0
    expected_fill_band_mads: float = 2.0
    parity_tolerance: int = 0
    result_cell_cap: int = 100_000

    def __post_init__(self) -> None:
        if self.training_cutoff_days < self.lag_cap_days:
            raise ConfigError("training_cutoff_days must reach lag_cap_days")
        for kind in ("freshness", "volume"):
            if getattr(self, f"{kind}_red_mads") < getattr(self, f"{kind}_amber_mads"):
                raise ConfigError(f"{kind}_red_mads must reach {kind}_amber_mads")
        if self.freshness_bucket not in ("day", "hour"):
            raise ConfigError("freshness_bucket is day or hour")
        if min(self.lag_cap_days, self.min_mature_months, self.result_cell_cap) < 1 or self.clock_skew_tolerance_days < 0:
            raise ConfigError("caps and minima must be positive")
        least = int(self.training_cutoff_days / DAYS_A_MONTH) + self.min_mature_months + self.evaluation_window_months + 1
        if self.extraction_months is not None and self.extraction_months < least:
            raise ConfigError(f"extraction_months must be {least} at least")


@dataclass(frozen=True)
class Via:
    """Event time borrowed from a lookup table, unique by the joined columns."""

    table: str
    on: tuple[tuple[str, str], ...]
    column: str

    def __post_init__(self) -> None:
        if not self.on:
            raise ConfigError("event_time_via needs columns to join on")


@dataclass(frozen=True)
class Probe:
    """One table with the roles of its columns."""

    name: str
    table: str
    load_time: str
    event_time: str | None = None
    event_time_via: Via | None = None
    source_insert_time: str | None = None
    compare_event_time: str | None = None
    key_cols: tuple[str, ...] = ()
    batch_col: str | None = None
    alt_col: str | None = None
    parity_with: str | None = None
    event_resolution: str = "datetime"
    load_resolution: str = "datetime"
    optional: bool = False
    proxy: bool = False
    expect_batchy: bool = False
    suppress_small_counts: bool = False
    read_uncommitted: bool = False
    analysis: Analysis = field(default_factory=Analysis)

    def __post_init__(self) -> None:
        if (self.event_time is None) == (self.event_time_via is None):
            raise ConfigError(f"{self.name}: give event_time or event_time_via, not both")
        if {self.event_resolution, self.load_resolution} - {"date", "datetime"}:
            raise ConfigError(f"{self.name}: a resolution is date or datetime")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", self.name):
            raise ConfigError(f"{self.name!r} is no probe name")

    @property
    def lag_resolution(self) -> str:
        return "date" if "date" in (self.event_resolution, self.load_resolution) else "datetime"

    @property
    def columns(self) -> list[str]:
        """The columns of the base table that a scan reads."""
        via = [a for a, _ in self.event_time_via.on] if self.event_time_via else []
        found = [self.event_time, self.load_time, self.source_insert_time, self.compare_event_time, self.batch_col, self.alt_col, *self.key_cols, *via]
        return list(dict.fromkeys(c for c in found if c))


@dataclass(frozen=True)
class Campaign:
    cron: str | None = None
    timezone: str = "UTC"
    grace_hours: float = 6.0
    manual_run_behavior: str = "publish"


@dataclass(frozen=True)
class Config:
    probes: tuple[Probe, ...]
    source: dict[str, Any]
    store_path: str
    store_options: tuple[tuple[str, str], ...] = ()
    retention: int | None = None
    campaign: Campaign = field(default_factory=Campaign)
    remotes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = [p.name for p in self.probes]
        if len(set(names)) != len(names):
            raise ConfigError("probe names must be unique")
        for p in self.probes:
            if p.parity_with is not None and (p.parity_with not in names or p.parity_with == p.name):
                raise ConfigError(f"{p.name}: parity_with names no other probe")
        for remote in self.remotes:
            if re.search(r"://[^/@]*:[^/@]+@", remote):
                raise ConfigError("a remote may not hold a secret")


def expand_env(value: Any, env: dict[str, str] | None = None) -> Any:
    """Replace ${NAME} in strings; an unset name is an error."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] not in env:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", one, value)


def _only(kind: type, raw: dict, where: str) -> dict:
    known = {f.name for f in dataclasses.fields(kind)}
    if wrong := sorted(set(raw) - known):
        raise ConfigError(f"{where}: unknown keys {', '.join(wrong)}")
    return raw


def parse_config(raw: dict) -> Config:
    if raw.get("schema_version") != SCHEMA_VERSION:
        raise ConfigError(f"schema_version must be {SCHEMA_VERSION}")
    shared = raw.get("analysis", {})
    probes = []
    for item in raw.get("probes", []):
        item = dict(item)
        via = item.pop("event_time_via", None)
        analysis = Analysis(**_only(Analysis, shared | item.pop("analysis", {}), str(item.get("name"))))
        if via is not None:
            via = Via(via["join_table"], tuple((x["base_col"], x["lookup_col"]) for x in via["on"]), via["column"])
        item["key_cols"] = tuple(item.get("key_cols", ()))
        probes.append(Probe(**_only(Probe, item, str(item.get("name"))), event_time_via=via, analysis=analysis))
    if not probes:
        raise ConfigError("no probes")
    store = raw.get("store", {})
    backend, options = store.get("backend", "parquet"), store.get("options", {})
    if backend not in ("parquet", "jdbc"):
        raise ConfigError("the store's backend is parquet or jdbc")
    if backend == "jdbc" and not {"url", "driver"} <= set(options):
        raise ConfigError("a jdbc store needs the options url and driver")
    return Config(tuple(probes), raw.get("source", {}), store.get("path", "runs"), tuple(sorted(options.items())) if backend == "jdbc" else (), store.get("retention"), Campaign(**_only(Campaign, raw.get("campaign", {}), "campaign")), tuple(raw.get("delivery", {}).get("remotes", ())))


def load_config(path: str | Path, env: dict[str, str] | None = None) -> Config:
    """A YAML or JSON file; YAML needs the yaml package."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return parse_config(expand_env(json.loads(text), env))
    import yaml

    return parse_config(expand_env(yaml.safe_load(text), env))


def compose(configs: list[Config]) -> Config:
    """One campaign of several files, which must share store, schedule and delivery."""
    first = configs[0]
    if any((c.store_path, c.store_options, c.campaign, c.remotes) != (first.store_path, first.store_options, first.campaign, first.remotes) for c in configs):
        raise ConfigError("configs of one campaign share store, schedule and delivery")
    return dataclasses.replace(first, probes=tuple(p for c in configs for p in c.probes))


SECRET_KEY = re.compile(r"password|secret|token|pwd|api_?key|connection", re.I)


def redact(value: Any, key: str = "") -> Any:
    """The same structure with secrets masked: values of secret-like keys and passwords in URLs."""
    if isinstance(value, dict):
        return {k: redact(v, k) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact(v, key) for v in value]
    if isinstance(value, str):
        return "***" if SECRET_KEY.search(key) else re.sub(r"(://[^/@:]*):[^/@]+@", r"\1:***@", value)
    return value


def digest(config: Config) -> str:
    """SHA-256 of the canonical JSON of the redacted configuration."""
    text = json.dumps(redact(dataclasses.asdict(config)), sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()
