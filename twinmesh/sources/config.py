"""The configuration of an engine: a JSON file (or YAML, where a parser is installed), checked against its rules."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

from twinmesh.errors import ConfigError


@dataclass(frozen=True)
class Config:
    """default_hamming_threshold serves projects without one of their own; the pool size is kept for services that have
    a database beside the engine."""

    core_base_url: str
    default_hamming_threshold: float
    core_timeout_ms: int = 10_000
    default_rate_limit_per_minute: int = 300
    pool_size: int = 10


def _positive(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ConfigError(f"{name} must be a positive integer")
    return value


def load(path: str | None = None) -> Config:
    """The configuration at a path, by default that of the environment variable CONFIG_PATH."""
    path = path or os.environ.get("CONFIG_PATH")
    if not path:
        raise ConfigError("CONFIG_PATH isn't set")
    try:
        raw = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"can't read {path}") from e
    return parse(raw)


def parse(raw: str) -> Config:
    try:
        value = json.loads(raw)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("not JSON, and no YAML parser is installed") from e
        try:
            value = yaml.safe_load(raw)
        except yaml.YAMLError as e:
            raise ConfigError("neither JSON nor YAML") from e
    if not isinstance(value, dict):
        raise ConfigError("the configuration must be a mapping")
    url, t = value.get("core_base_url"), value.get("default_hamming_threshold")
    if not isinstance(url, str) or not urlparse(url).scheme or not urlparse(url).netloc:
        raise ConfigError("core_base_url must be a URL")
    if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t) or not 0 <= t <= 100:
        raise ConfigError("default_hamming_threshold must be between 0 and 100")
    database = value.get("database") or {}
    if not isinstance(database, dict):
        raise ConfigError("database must be a mapping")
    return Config(
        url, float(t), _positive(value.get("core_timeout_ms", 10_000), "core_timeout_ms"), _positive(value.get("default_rate_limit_per_minute", 300), "default_rate_limit_per_minute"), _positive(database.get("pool_size", 10), "database.pool_size")
    )
