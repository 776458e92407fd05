"""Knobs of the tick pipeline as dataclasses, with YAML in and out and a hash of the processing knobs."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from typing import Any

import yaml


@dataclass(frozen=True)
class CleaningConfig:
    ffill_cap_seconds: int = 2
    input_timezone: str = "America/New_York"
    at_bid_ask_tolerance: float = 1e-4
    compute_microstructure_flags: bool = True
    min_nbbo_coverage_pct: float = 99.0
    max_crossed_quotes_pct: float = 0.5
    strict_null_cond: bool = False
    compression: str = "zstd"


@dataclass(frozen=True)
class FeatureConfig:
    vwap_zscore_window: int = 20
    bollinger_window: int = 20
    bollinger_std: float = 2.0
    momentum_windows: tuple[int, ...] = (3, 5)
    relative_volume_window: int = 20
    context_window_minutes: int = 5
    market_open_seconds: int = 9 * 3600 + 35 * 60
    session_hours: float = 6.0
    timezone: str = "America/New_York"


@dataclass(frozen=True)
class LabelConfig:
    k: float = 1.0
    k_grid: tuple[float, ...] = (0.75, 1.0, 1.25)
    ewm_halflife: int = 50
    time_barrier_minutes: int = 20


@dataclass(frozen=True)
class ProcessingConfig:
    target_bars_per_day: int = 600
    min_threshold: int = 2000
    max_threshold: int = 100_000
    thresholds: dict[str, int] = field(default_factory=dict)
    features: FeatureConfig = FeatureConfig()
    labels: LabelConfig = LabelConfig()
    embargo_minutes: int = 20
    n_folds: int = 5
    compression: str = "zstd"


def plain(config: Any) -> Any:
    """A dataclass as nested dicts and lists that YAML writes plainly."""
    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list | tuple) else x

    return walk(asdict(config))


def config_hash(config: Any) -> str:
    """md5 of the knobs as sorted YAML, taken before the hash itself is stored with them."""
    return hashlib.md5(yaml.dump(config if isinstance(config, dict) else plain(config), sort_keys=True).encode()).hexdigest()


def dump_config(config: ProcessingConfig, path: str) -> dict:
    out = plain(config)
    out["config_hash"] = config_hash(config)
    with open(path, "w") as f:
        yaml.dump(out, f, default_flow_style=False, sort_keys=False)
    return out


def load_config(path: str) -> ProcessingConfig:
    with open(path) as f:
        got = yaml.safe_load(f)
    got.pop("config_hash", None)
    features, labels = got.pop("features"), got.pop("labels")
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    return ProcessingConfig(features=FeatureConfig(**tuples(features)), labels=LabelConfig(**tuples(labels)), **got)
