"""Starter presets from attribute tables of artifact descriptions, and what changed between two sets of them."""

from __future__ import annotations

import re
from pathlib import Path

from .catalog import discover, read_bytes
from .html import attribute_table


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_") or "untitled"


def read_templates(path: str | Path) -> dict[str, list[tuple[str, str]]]:
    """Attribute tables of the .htm pages in a folder, archive or file, by title."""
    out = {}
    for entry in discover(path, 1):
        if entry.name.lower().endswith((".htm", ".html")):
            title, rows = attribute_table(read_bytes(entry).decode("utf-8", "replace"))
            if rows:
                out[title or entry.name] = rows
    return out


def template_yaml(title: str, rows: list[tuple[str, str]], tool: str) -> str:
    """A draft preset: header, columns and places to fill in (it is left out of runs until they are)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lines = ["# __template__", "preset:", f"  id: {slug(tool)}.{slug(title)}", f"  name: {quote(title)}", f"  tool: {quote(tool)}", "  version: 1", "  tier: secondary", ""]
    lines += ["input_selector:", "  format: csv", "  name: TODO.csv", "", "expected_columns:"]
    lines += [f"  - {quote(name)}  # {' '.join(text.split())}" for name, text in rows]
    lines += ["", "common:", "  entity: param(entity)", "  raw_source_path: column(TODO)", "", "assertions:", "  - position:", "      latitude_wgs84: column(TODO)", "      longitude_wgs84: column(TODO)"]
    lines += ["    time:", "      instant: column(TODO)", "    links:", "      entity_position: unknown", "      entity_time: unknown", "      spatial_temporal: instant", ""]
    return "\n".join(lines)


def write_templates(path: str | Path, output: str | Path, tool: str) -> list[Path]:
    out = []
    Path(output).mkdir(parents=True, exist_ok=True)
    for title, rows in sorted(read_templates(path).items()):
        target = Path(output) / f"{slug(title)}.yaml"
        target.write_text(template_yaml(title, rows, tool), encoding="utf-8")
        out.append(target)
    return out


def difference(now: dict[str, list[tuple[str, str]]], known: dict[str, list[str]]) -> dict[str, list[str]]:
    """Titles that are missing from the known ones, have other attributes, or are unchanged."""
    names = {t: [a for a, _ in rows] for t, rows in now.items()}
    return {
        "missing": sorted(t for t in names if t not in known),
        "modified": sorted(t for t in names if t in known and sorted(known[t]) != sorted(names[t])),
        "unchanged": sorted(t for t in names if t in known and sorted(known[t]) == sorted(names[t])),
    }
