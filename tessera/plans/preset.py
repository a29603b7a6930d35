"""Presets: YAML documents that say how one kind of source becomes assertion rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.clock import EPOCHS
from ..schema import ASSIGNABLE, VOCABULARIES
from .grammar import Ref, Step, parse_pipe, parse_ref

FORMATS = ["csv", "excel", "sqlite", "xml"]
READ_OPTIONS = ["delimiter", "encoding", "skip_rows", "header_row"]
LINKS = {"entity_position": "entity_position_link", "entity_time": "entity_time_link", "spatial_temporal": "spatial_temporal_link"}


class PresetError(ValueError):
    """A preset that cannot be used, and where it says so."""


@dataclass(frozen=True)
class Field:
    column: str
    ref: Ref
    type: str | None = None
    unit: str | None = None
    extract: tuple[str, str] | None = None
    pipe: tuple[Step, ...] = ()
    optional: bool = False


@dataclass(frozen=True)
class Time:
    lower: Ref
    upper: Ref
    epoch: str | None = None
    format: str | None = None
    zone: Field | None = None
    overrides: tuple[Field, ...] = ()


@dataclass(frozen=True)
class Assertion:
    fields: tuple[Field, ...]
    time: Time


@dataclass(frozen=True)
class Selector:
    format: str
    name: str | None = None
    path: str | None = None
    table: str | None = None
    sql: str | None = None
    sheet: str | None = None
    namespace: str | None = None
    model: str | None = None
    role: str = "source"
    read: dict = field(default_factory=dict)

    @property
    def unit(self) -> str:
        """The part of a file that it takes: a table, a query, a sheet, a model, or the whole."""
        return self.table or self.sheet or self.model or (f"sql:{self.sql}" if self.sql else "")


@dataclass(frozen=True)
class Preset:
    id: str
    name: str
    version: str
    selectors: tuple[Selector, ...]
    assertions: tuple[Assertion, ...]
    common: tuple[Field, ...] = ()
    uid: Field | None = None
    os: str | None = None
    tool: str | None = None
    os_version: str | None = None
    tier: str | None = None
    patterns: dict = field(default_factory=dict)
    lookups: dict = field(default_factory=dict)
    expected: tuple[str, ...] = ()
    source: str = ""

    @property
    def title(self) -> str:
        """The name, after the system and the tool that it is for."""
        prefix = " ".join(p for p in (self.os, self.tool) if p)
        return f"{prefix} \N{EM DASH} {self.name}" if prefix else self.name

    def fields(self) -> list[Field]:
        """Every field of the mapping, times' zones and overrides included."""
        out = [*([self.uid] if self.uid else []), *self.common]
        for a in self.assertions:
            out += [*a.fields, *([a.time.zone] if a.time.zone else []), *a.time.overrides]
        return out

    def refs(self) -> list[tuple[Ref, bool]]:
        """Every reference and whether it may be missing."""
        return [(f.ref, f.optional) for f in self.fields()] + [(r, False) for a in self.assertions for r in (a.time.lower, a.time.upper)]


def _vocabulary(column: str, value: object) -> None:
    if column in VOCABULARIES and value is not None and value not in VOCABULARIES[column]:
        raise PresetError(f"{column}: {value!r} is not one of {', '.join(VOCABULARIES[column])}")


def _field(column: str, raw: object, patterns: dict, assignable: bool = True) -> Field:
    if assignable and column not in ASSIGNABLE:
        raise PresetError(f"{column} cannot be assigned")
    body = raw if isinstance(raw, dict) else {"from": raw}
    if "from" not in body:
        raise PresetError(f"{column}: a mapping needs 'from'")
    extract = None
    if "extract" in body:
        name, dot, group = str(body["extract"]).partition(".")
        if not dot or name not in patterns or group not in re.compile(patterns[name]).groupindex:
            raise PresetError(f"{column}: extract {body['extract']!r} names no group of a pattern")
        extract = (name, group)
    try:
        out = Field(column, parse_ref(body["from"]), body.get("type"), body.get("unit"), extract, parse_pipe(body.get("pipe")), bool(body.get("optional", False)))
    except ValueError as wrong:
        raise PresetError(f"{column}: {wrong}") from wrong
    if out.ref.kind == "const":
        _vocabulary(column, out.ref.arg)
    return out


def _time(raw: object, patterns: dict) -> Time:
    if not isinstance(raw, dict):
        raise PresetError("time must be a mapping")
    if ("instant" in raw) == ("interval" in raw):
        raise PresetError("time needs either 'instant' or 'interval'")
    if raw.get("epoch") is not None and raw.get("format") is not None:
        raise PresetError("time has both 'epoch' and 'format'")
    if raw.get("epoch") is not None and raw["epoch"] not in EPOCHS:
        raise PresetError(f"unknown epoch {raw['epoch']!r}")
    if "interval" in raw:
        bounds = raw["interval"]
        if not isinstance(bounds, dict) or not {"lower", "upper"} <= bounds.keys():
            raise PresetError("interval needs 'lower' and 'upper'")
    else:
        bounds = {"lower": raw["instant"], "upper": raw["instant"]}
    try:
        lower, upper = parse_ref(bounds["lower"]), parse_ref(bounds["upper"])
    except ValueError as wrong:
        raise PresetError(f"time: {wrong}") from wrong
    own = {"instant", "interval", "epoch", "format", "zone"}
    zone = _field("utc_offset_hours", raw["zone"], patterns) if "zone" in raw else None
    return Time(lower, upper, raw.get("epoch"), raw.get("format"), zone, tuple(_field(k, v, patterns) for k, v in raw.items() if k not in own))


def _assertion(raw: object, patterns: dict) -> Assertion:
    if not isinstance(raw, dict) or "time" not in raw:
        raise PresetError("an assertion is a mapping with 'time'")
    position, links = raw.get("position") or {}, raw.get("links") or {}
    if not isinstance(position, dict) or not isinstance(links, dict):
        raise PresetError("position and links must be mappings")
    if unknown := links.keys() - LINKS:
        raise PresetError(f"unknown links: {', '.join(sorted(unknown))}")
    fields = [_field(k, v, patterns) for k, v in position.items()]
    for key, value in links.items():
        _vocabulary(LINKS[key], value)
        if value is not None:
            fields.append(Field(LINKS[key], Ref("const", value)))
    return Assertion(tuple(fields), _time(raw["time"], patterns))


def _selector(raw: object) -> Selector:
    from .match import check_path

    if not isinstance(raw, dict) or raw.get("format") not in FORMATS:
        raise PresetError(f"an input_selector needs a format of {', '.join(FORMATS)}")
    if (raw.get("path") is None) == (raw.get("name") is None):
        raise PresetError("an input_selector needs either 'path' or 'name'")
    if raw.get("path") is not None:
        check_path(str(raw["path"]))
    if raw["format"] == "sqlite" and bool(raw.get("table")) == bool(raw.get("sql")):
        raise PresetError("a sqlite input_selector needs either 'table' or 'sql'")
    for kind, key in (("excel", "sheet"), ("xml", "model")):
        if raw["format"] == kind and not raw.get(key):
            raise PresetError(f"an input_selector of format {kind} needs '{key}'")
    keys = ["format", "name", "path", "table", "sql", "sheet", "namespace", "model"]
    return Selector(**{k: raw.get(k) for k in keys}, role=str(raw.get("role") or "source"), read={k: raw[k] for k in READ_OPTIONS if k in raw})


def preset_from(raw: object, source: str = "") -> Preset:
    """A preset from its parsed YAML; errors name the file."""
    try:
        return _preset(raw, source)
    except (PresetError, re.error) as wrong:
        raise PresetError(f"{source or 'preset'}: {wrong}") from wrong


def _preset(raw: object, source: str) -> Preset:
    if not isinstance(raw, dict) or not isinstance(raw.get("preset"), dict):
        raise PresetError("a preset is a mapping with a 'preset' header")
    head = raw["preset"]
    for key in ("id", "name"):
        if not isinstance(head.get(key), str) or not head[key].strip():
            raise PresetError(f"the header needs a non-empty {key}")
    _vocabulary("source_tier", head.get("tier"))
    patterns, lookups, expected = raw.get("patterns") or {}, raw.get("lookup_tables") or {}, raw.get("expected_columns") or []
    if not isinstance(patterns, dict):
        raise PresetError("patterns must be a mapping")
    patterns = {str(k): str(v) for k, v in patterns.items()}
    for pattern in patterns.values():
        re.compile(pattern)
    if not isinstance(lookups, dict) or not all(isinstance(v, dict) for v in lookups.values()):
        raise PresetError("lookup_tables must be a mapping of tables")
    if not isinstance(expected, list) or not all(isinstance(c, str) for c in expected):
        raise PresetError("expected_columns must be a list of names")
    selectors = raw.get("input_selector")
    selectors = selectors if isinstance(selectors, list) else [selectors] if selectors is not None else []
    if not selectors:
        raise PresetError("input_selector is required")
    common, assertions = raw.get("common") or {}, raw.get("assertions")
    if not isinstance(common, dict):
        raise PresetError("common must be a mapping")
    if not isinstance(assertions, list) or not assertions:
        raise PresetError("assertions must be a non-empty list")
    uid = raw.get("source_record_uid")
    return Preset(
        id=head["id"].strip(), name=head["name"].strip(), version=str(head.get("version", "0") if head.get("version") is not None else "0"),
        os=head.get("os") or None, tool=head.get("tool") or None, os_version=head.get("os_version") or None, tier=head.get("tier"),
        selectors=tuple(_selector(s) for s in selectors), patterns=patterns, lookups={str(k): dict(v) for k, v in lookups.items()},
        expected=tuple(expected), uid=_field("source_record_uid", uid, patterns, assignable=False) if uid is not None else None,
        common=tuple(_field(k, v, patterns) for k, v in common.items()), assertions=tuple(_assertion(a, patterns) for a in assertions), source=source,
    )


def load_preset(path: str | Path) -> Preset:
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except yaml.YAMLError as wrong:
        raise PresetError(f"{path}: not YAML: {wrong}") from wrong
    return preset_from(raw, str(path))


def load_presets(root: str | Path) -> list[Preset]:
    """Presets of a file or a folder, in order of path; drafts (with TODO or __template__) are left out, none at all is an error."""
    root = Path(root)
    files = [root] if root.is_file() else sorted(root.rglob("*.yaml"))
    ready = [p for p in files if root.is_file() or not any(mark in p.read_text(encoding="utf-8") for mark in ("TODO", "__template__"))]
    if not ready:
        raise PresetError(f"{root}: no preset that is ready for use")
    return [load_preset(p) for p in ready]
