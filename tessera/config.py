"""Settings: defaults, then a TOML file, then arguments."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    local_zone: str | None = None
    log_level: str = "INFO"
    log_file: str | None = None
    archive_depth: int | None = None
    root_prefix_depth: int = 1
    source_columns: bool = True
    source_column_prefix: str = "orig_"
    split: bool = False
    rank_resolution_us: int = 1_000_000
    staging: str = "always"


_TABLES = {
    "timezone": {"local_zone": "local_zone"},
    "logging": {"level": "log_level", "file": "log_file"},
    "discovery": {"archive_depth": "archive_depth", "root_prefix_depth": "root_prefix_depth", "staging": "staging"},
    "output": {"source_columns": "source_columns", "source_column_prefix": "source_column_prefix", "split": "split", "rank_resolution_us": "rank_resolution_us"},
}


def check_zone(name: str | None) -> str | None:
    """An IANA zone that exists."""
    if name is not None:
        from zoneinfo import ZoneInfo

        try:
            ZoneInfo(name)
        except (KeyError, ValueError, OSError) as wrong:
            raise ValueError(f"unknown time zone {name!r}") from wrong
    return name


def load_settings(path: str | Path | None = None, **given) -> Settings:
    """Settings of a file, with given values (other than None) on top; unknown keys and zones are errors."""
    out = Settings()
    if path is not None:
        values = {}
        for table, body in tomllib.loads(Path(path).read_text(encoding="utf-8")).items():
            if table not in _TABLES or not isinstance(body, dict):
                raise ValueError(f"{path}: unknown setting {table!r}")
            for key, value in body.items():
                if key not in _TABLES[table]:
                    raise ValueError(f"{path}: unknown setting {table}.{key}")
                values[_TABLES[table][key]] = value
        out = replace(out, **values)
    known = {f.name for f in fields(Settings)}
    if unknown := given.keys() - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = replace(out, **{k: v for k, v in given.items() if v is not None})
    check_zone(out.local_zone)
    if out.staging not in ("always", "never", "tier"):
        raise ValueError(f"staging {out.staging!r}: expected always, never or tier")
    return out
