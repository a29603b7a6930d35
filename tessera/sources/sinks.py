"""Outputs: CSV files of one table or one per preset, Parquet, and JSON next to them."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import cols
from ..operators.assemble import WARNINGS
from ..schema import OFFSET_STATE, OUTPUT_COLUMNS

INTERNAL = ("_line", "_ordinal", "_source", "_recovery", WARNINGS, OFFSET_STATE)


def rendered(rows: DataFrame) -> DataFrame:
    """The table as it is written: output columns, then source columns; an assumed zone's offset is N/A."""
    rest = [c for c in rows.columns if c not in OUTPUT_COLUMNS and c not in INTERNAL]
    offset = F.when(F.col(OFFSET_STATE) == "unknown", "N/A").otherwise(F.col("utc_offset_hours").cast("string"))
    return rows.select(*[offset.alias(c) if c == "utc_offset_hours" else F.col(c) for c in OUTPUT_COLUMNS], *cols(rest))


def write_csv(rows: DataFrame, path: str | Path, bom: bool = False, header: list[str] | None = None) -> int:
    """One CSV file, in the rows' order; nothing is written for no rows. Returns the number of rows.
    `header` gives names that differ from the columns'.

    Executors write the parts, which are joined in order under one header.
    """
    path = Path(path)
    draft = path.parent / f".{path.name}-{uuid.uuid4().hex}"
    rows.write.option("header", "false").option("escape", '"').option("emptyValue", "").csv(str(draft))
    parts = sorted(p for p in draft.iterdir() if p.name.startswith("part-") and p.stat().st_size)
    total = 0
    if parts:
        import csv

        with path.open("w", encoding="utf-8-sig" if bom else "utf-8", newline="") as out:
            csv.writer(out, lineterminator="\n").writerow(header or rows.columns)
            for p in parts:
                with p.open(encoding="utf-8", newline="") as part:
                    for piece in iter(lambda: part.read(1 << 20), ""):
                        out.write(piece)
        total = rows.count()
    for p in sorted(draft.iterdir()):
        p.unlink()
    draft.rmdir()
    return total


def write_parquet(rows: DataFrame, path: str, by_preset: bool = False) -> None:
    """The table as Parquet, in a folder per preset if wanted: the form to use at scale."""
    writer = rows.drop(*[c for c in (WARNINGS,) if c in rows.columns]).write.mode("errorifexists")
    (writer.partitionBy("preset_id") if by_preset else writer).parquet(path)


def safe_file_name(title: str, taken: set[str]) -> str:
    """A title as a file name that no other title has."""
    base = re.sub(r"[^A-Za-z0-9._-]+", "_", title).strip("_") or "untitled"
    name, n = base, 1
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    taken.add(name.lower())
    return name


def write_json(content: object, path: str | Path) -> Path:
    path = Path(path)
    path.write_text(json.dumps(content, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    return path


def save_profile(path: str | Path, presets: list[str | Path]) -> None:
    """A list of presets, relative to the profile where they lie below it."""
    path = Path(path)
    base = path.resolve().parent
    kept = [str(Path(p).resolve().relative_to(base)) if Path(p).resolve().is_relative_to(base) else str(Path(p).resolve()) for p in presets]
    write_json({"version": 1, "preset_paths": kept}, path)


def load_profile(path: str | Path) -> list[Path]:
    path = Path(path)
    body = json.loads(path.read_text(encoding="utf-8"))
    if body.get("version") != 1 or not isinstance(body.get("preset_paths"), list):
        raise ValueError(f"{path} is not a profile")
    return [path.resolve().parent / p for p in body["preset_paths"]]
