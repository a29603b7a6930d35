"""Matching of presets to files: where a file lies, what it is, which columns it has."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .grammar import Ref
from .preset import Preset, PresetError, Selector

UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"


def _segments(path: str) -> list[str]:
    return [s for s in path.replace("\\", "/").split("/") if s]


def check_path(path: str) -> None:
    """A selector's path: whole segments, of which `*` is any one and `{uuid}` one that is a UUID."""
    if not _segments(path):
        raise PresetError("an empty path selects nothing")
    for segment in _segments(path):
        if "**" in segment:
            raise PresetError(f"{path}: ** is not allowed, * stands for one segment")
        if segment != "{uuid}" and set("{}") & set(segment):
            raise PresetError(f"{path}: {segment} is no placeholder, the only one is {{uuid}}")


def path_pattern(path: str, root_prefix_depth: int = 1) -> str:
    """The pattern of a selector's path, with up to so many leading segments before it."""
    check_path(path)
    parts = [{"*": "[^/]+", "{uuid}": UUID}.get(s, re.escape(s)) for s in _segments(path)]
    return rf"^/?(?:[^/]+/){{0,{root_prefix_depth}}}{'/'.join(parts)}$"


def located(selector: Selector, logical_path: str, root_prefix_depth: int = 1) -> bool:
    """Whether a file lies where the selector says: by exact name, or by anchored path."""
    clean = "/".join(_segments(logical_path))
    if selector.name is not None:
        return clean.rpartition("/")[2] == selector.name
    return re.match(path_pattern(selector.path, root_prefix_depth), clean) is not None


def _covered(ref: Ref, columns: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(c, str(ref.arg)) for c in columns) if ref.is_glob else str(ref.arg) in columns


def missing_columns(preset: Preset, columns: list[str]) -> list[str]:
    """Columns that the mapping needs and the source lacks; optional ones do not count."""
    return list(dict.fromkeys(str(r.arg) for r, optional in preset.refs() if r.kind in ("column", "header") and not optional and not _covered(r, columns)))


def structural_score(expected: list[str], columns: list[str]) -> int:
    """One for each expected column that is there, minus two for each that is not."""
    present = sum(any(fnmatch.fnmatchcase(c, e) for c in columns) for e in expected)
    return present - 2 * (len(expected) - present)


def score(preset: Preset, columns: list[str]) -> int:
    expected = list(preset.expected) or list(dict.fromkeys(str(r.arg) for r, _ in preset.refs() if r.kind == "column"))
    return structural_score(expected, columns)


@dataclass
class Matched:
    """Winners of a file's units, and presets that lie right but lack columns."""

    chosen: list[tuple[Preset, Selector]] = field(default_factory=list)
    unsatisfied: list[tuple[Preset, Selector, list[str]]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def match_file(
    presets: list[Preset], logical_path: str, kind: str | None, peek: Callable[[Selector], list[str] | None], namespace: str | None = None, root_prefix_depth: int = 1
) -> Matched:
    """The best preset for each unit of a file: located, of the right format, with its columns; then by score and order.

    `peek` gives a unit's columns, or None where they cannot be told, which disqualifies
    nobody.
    """
    out, units = Matched(), {}
    for order, preset in enumerate(presets):
        for selector in preset.selectors:
            if not located(selector, logical_path, root_prefix_depth):
                continue
            if kind != selector.format:
                out.notes.append(f"{logical_path}: {preset.id} expects {selector.format}, the file is {kind or 'unknown'}")
                continue
            if selector.format == "xml" and selector.namespace and selector.namespace != namespace:
                continue
            units.setdefault(selector.unit, []).append((order, preset, selector))
            break
    for unit in units.values():
        fit = []
        for order, preset, selector in unit:
            columns = peek(selector)
            lacking = missing_columns(preset, columns) if columns is not None else []
            if lacking:
                out.unsatisfied.append((preset, selector, lacking))
            else:
                fit.append((-score(preset, columns or []), order, preset, selector))
        if fit:
            _, _, preset, selector = min(fit, key=lambda x: x[:2])
            out.chosen.append((preset, selector))
            won = {id(p) for p, _ in out.chosen}
            out.unsatisfied = [u for u in out.unsatisfied if id(u[0]) not in won]
    return out


def single_role(preset: Preset) -> None:
    """A preset that joins sources of several roles is not supported."""
    if len({s.role for s in preset.selectors}) > 1:
        raise NotImplementedError(f"{preset.id}: sources of several roles cannot be joined")
