"""Preset linting: what parses but is likely wrong."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from .match import UUID
from .preset import Preset, PresetError, load_preset

#: Names of record counters that are no stable ids.
COUNTERS = {"rowid", "_rowid_", "oid", "id", "z_pk", "_id", "pk"}
ERROR, WARNING, ADVICE = "error", "warning", "advice"


@dataclass(frozen=True)
class Finding:
    severity: str
    code: str
    message: str
    preset: str
    where: str = ""


def _names(p: Preset) -> set[str]:
    return {str(r.arg) for r, _ in p.refs() if r.kind == "column" and not r.is_glob and "TODO" not in str(r.arg)}


def _written(p: Preset) -> Iterator[tuple[str, str]]:
    for s in p.selectors:
        for key in ("name", "path", "table", "sql", "sheet", "model"):
            if getattr(s, key):
                yield str(getattr(s, key)), f"input_selector.{key}"
    for f in p.fields():
        yield str(f.ref.arg), f.column
    for i, a in enumerate(p.assertions):
        yield from ((str(x), f"assertions[{i}].time") for x in (a.time.lower.arg, a.time.upper.arg, a.time.format or ""))


def _header(p: Preset) -> Iterator[tuple[str, str, str, str]]:
    if not re.fullmatch(r"[a-z0-9]+(\.[a-z0-9_]+)+", p.id):
        yield ADVICE, "id-naming", f"{p.id!r} is no dotted lower-case name", "preset.id"
    if p.tier == "primary" and p.tool:
        yield ADVICE, "tier-tool", "a primary source has no tool", "preset.tool"
    if p.tier == "secondary" and not p.tool:
        yield ADVICE, "tier-tool", "a secondary source names its tool", "preset.tool"
    if not p.os_version:
        yield ADVICE, "no-os-version", "no range of system versions", "preset.os_version"
    if not any(f.column == "raw_source_path" for f in p.common):
        yield WARNING, "no-raw-source-path", "rows will not say where they came from", "common"
    if p.uid and p.uid.ref.kind == "column" and (str(p.uid.ref.arg).lower() in COUNTERS or str(p.uid.ref.arg).lower().endswith("_pk")):
        yield WARNING, "rowid-as-uid", f"{p.uid.ref.arg} counts rows and is no stable id", "source_record_uid"


def _columns(p: Preset) -> Iterator[tuple[str, str, str, str]]:
    if not p.expected:
        yield ADVICE, "no-expected-columns", "declare the source's columns, so that drift shows", "expected_columns"
        return
    for name in sorted(_names(p)):
        if not any(fnmatch.fnmatch(name, e) for e in p.expected):
            yield WARNING, "mapped-not-declared", f"column {name!r} is read but not expected", "expected_columns"


def _mapping(p: Preset) -> Iterator[tuple[str, str, str, str]]:
    for f in p.fields():
        for step in f.pipe:
            if step.name == "arithmetic" and any(n in " ".join(map(str, step.args)) for n in ("978307200", "1000000000")):
                yield ADVICE, "raw-epoch-arithmetic", f"{f.column}: use an epoch's name", f.column
    for i, a in enumerate(p.assertions):
        columns = {f.column for f in a.fields}
        if ("latitude_wgs84" in columns) != ("longitude_wgs84" in columns):
            yield WARNING, "half-coordinate", "a point needs both coordinates", f"assertions[{i}].position"
        for link in ("entity_position_link", "entity_time_link", "spatial_temporal_link"):
            if link not in columns:
                yield WARNING, "missing-link", f"{link} is not declared", f"assertions[{i}].links"
        if a.time.format and a.time.zone is None and "%z" not in a.time.format:
            yield ADVICE, "naive-timezone", "text without a zone is read as UTC", f"assertions[{i}].time"


def _selection(p: Preset) -> Iterator[tuple[str, str, str, str]]:
    for value, where in dict.fromkeys(x for x in _written(p) if "TODO" in x[0]):
        yield WARNING, "unfilled-placeholder", f"{value!r} is a placeholder", where
    for s in p.selectors:
        if s.path and any(re.fullmatch(UUID, part) for part in s.path.replace("\\", "/").split("/")):
            yield WARNING, "literal-uuid-in-path", "the path fits one acquisition only; use {uuid}", "input_selector.path"
    if len({s.role for s in p.selectors}) > 1:
        yield WARNING, "multi-role-unsupported", "sources of several roles cannot be joined", "input_selector"


def lint(preset: Preset, label: str | None = None) -> list[Finding]:
    return [Finding(s, c, m, label or preset.id, w) for check in (_header, _columns, _mapping, _selection) for s, c, m, w in check(preset)]


def lint_paths(paths: list[str | Path]) -> list[Finding]:
    """Findings for presets in files and folders; one that does not load is an error."""
    out = []
    for root in map(Path, paths):
        for path in sorted(root.rglob("*.yaml")) if root.is_dir() else [root]:
            try:
                out += lint(load_preset(path), str(path))
            except PresetError as wrong:
                out.append(Finding(ERROR, "yaml-error" if "not YAML" in str(wrong) else "parse-error", str(wrong), str(path)))
    return out


def exit_code(findings: list[Finding], strict: bool = False) -> int:
    """1 for errors, with `strict` for warnings too."""
    return int(any(f.severity == ERROR or strict and f.severity == WARNING for f in findings))
