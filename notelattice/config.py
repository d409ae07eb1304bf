"""Configuration from a mapping such as os.environ: vaults, embedder, storage. Bad values are errors."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Mapping
from dataclasses import dataclass, field

from notelattice.errors import VaultError

EXIT_CODE = 78
PROVIDERS, LEVELS = ("hash", "http", "table"), ("trace", "debug", "info", "warn", "error")


class ConfigError(VaultError):
    code = "config"


def slugify(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.strip().lower()).strip("-")


@dataclass(frozen=True)
class VaultConfig:
    name: str
    slug: str


#: Defaults of the watchdog and of health, and the most that a number may be.
STALL_SECONDS, POLL_SECONDS, FAILURES = 300, 30, 3
MOST_SECONDS, MOST_COUNT = 86_400, 10_000


@dataclass(frozen=True)
class Watch:
    """When a log counts as silent (0: never), how often it is looked at, and whether its lines go on."""

    stall_seconds: int = STALL_SECONDS
    poll_seconds: int = POLL_SECONDS
    forward: bool = True


@dataclass(frozen=True)
class Health:
    """Crashes and stalls that end a vault (0: none does), and failures in a row that make it unhealthy."""

    max_crashes: int = 0
    max_stalls: int = 0
    failures: int = FAILURES


@dataclass(frozen=True)
class Config:
    vaults: tuple[VaultConfig, ...]
    root: str = "/vaults"
    tables: str = "/index"
    provider: str = "hash"
    dim: int = 384
    level: str = "info"
    watch: Watch = Watch()
    health: Health = Health()
    extra: dict = field(default_factory=dict)


def parse_vaults(raw: str) -> tuple[VaultConfig, ...]:
    """Vaults of a JSON array of {name, slug?}; slugs are made safe and must differ."""
    try:
        rows = json.loads(raw)
    except ValueError as e:
        raise ConfigError(f"vaults are no JSON: {e}") from e
    if not isinstance(rows, list) or not rows:
        raise ConfigError("vaults are a JSON array with at least one object")
    out: dict[str, VaultConfig] = {}
    for i, row in enumerate(rows):
        name = row.get("name") if isinstance(row, dict) else None
        if not isinstance(name, str) or not name.strip():
            raise ConfigError(f"vault {i} has no name")
        wanted = row.get("slug", name)
        slug = slugify(wanted) if isinstance(wanted, str) else ""
        if not slug:
            raise ConfigError(f"vault {i} has no usable slug")
        if slug in out:
            raise ConfigError(f"{out[slug].name!r} and {name!r} have one slug, {slug!r}")
        out[slug] = VaultConfig(name, slug)
    return tuple(out.values())


def number(env: Mapping[str, str], name: str, default: int, most: int) -> int:
    """A whole number from 0 to `most`."""
    raw = env.get(name)
    if raw is None:
        return default
    if not re.fullmatch(r"[0-9]+", raw) or int(raw[:20]) > most or len(raw) > 20:
        raise ConfigError(f"{name} is a whole number up to {most}, not {raw[:40]!r}")
    return int(raw)


def load_watch(env: Mapping[str, str]) -> Watch:
    stall, poll = number(env, "STALL_SECONDS", STALL_SECONDS, MOST_SECONDS), number(env, "POLL_SECONDS", POLL_SECONDS, MOST_SECONDS)
    if poll < 1 or 0 < stall < poll:
        raise ConfigError(f"POLL_SECONDS ({poll}) lies from 1 to STALL_SECONDS ({stall})")
    if env.get("LOG_FORWARD", "true") not in ("true", "false"):
        raise ConfigError("LOG_FORWARD is true or false")
    return Watch(stall, poll, env.get("LOG_FORWARD") != "false")


def load_health(env: Mapping[str, str]) -> Health:
    return Health(number(env, "MAX_CRASHES", 0, MOST_COUNT), number(env, "MAX_STALLS", 0, MOST_COUNT), number(env, "FAILURES", FAILURES, MOST_COUNT))


def load(env: Mapping[str, str]) -> Config:
    """Config of VAULTS_JSON, VAULT_ROOT, TABLE_ROOT, EMBEDDER, EMBEDDER_DIM and LOG_LEVEL, of the watchdog
    (STALL_SECONDS, POLL_SECONDS, LOG_FORWARD) and of health (MAX_CRASHES, MAX_STALLS, FAILURES)."""
    if not env.get("VAULTS_JSON"):
        raise ConfigError("VAULTS_JSON is missing")
    base = Config(parse_vaults(env["VAULTS_JSON"]))
    provider, level = env.get("EMBEDDER", base.provider), env.get("LOG_LEVEL", base.level)
    if provider not in PROVIDERS or level not in LEVELS:
        raise ConfigError("EMBEDDER or LOG_LEVEL is unknown")
    dim = env.get("EMBEDDER_DIM", str(base.dim))
    if not dim.isdigit() or int(dim) < 1:
        raise ConfigError("EMBEDDER_DIM is a positive number")
    return Config(base.vaults, env.get("VAULT_ROOT", base.root), env.get("TABLE_ROOT", base.tables), provider, int(dim), level, load_watch(env), load_health(env))


def load_or_exit(env: Mapping[str, str]) -> Config:
    """load(), as a program starts: a bad value is said on standard error and ends it with EXIT_CODE."""
    try:
        return load(env)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        raise SystemExit(EXIT_CODE) from e
