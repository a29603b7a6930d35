"""A run: sources are matched to presets, assembled, united, ranked and written."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, load_settings
from .operators import frontier
from .operators.assemble import WARNINGS, Run, assemble, check_unique
from .operators.merge import union_all
from .operators.untangle import untangle
from .plans.match import match_file, missing_columns, score, single_role
from .plans.preset import Preset, PresetError, Selector, load_preset, load_presets
from .sources import readers, sinks
from .sources.catalog import Catalog, Entry, Integrity, detect, discover

log = logging.getLogger("tessera")


@dataclass
class Source:
    """A file's unit that a preset reads."""

    entry: Entry
    preset: Preset
    selector: Selector
    columns: list[str]


@dataclass
class Plan:
    sources: list[Source]
    unmatched: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Result:
    rows: DataFrame
    sources: list[Source]
    outputs: list[Path] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    warnings: list[dict] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)


def _namespace(entry: Entry, kind: str | None) -> str | None:
    return readers.namespace_of(entry) if kind == "xml" else None


def plan_sources(catalog: Catalog, presets: list[Preset], settings: Settings) -> Plan:
    """Match every file of a catalog; metadata only, on the driver."""
    plan = Plan([], warnings=list(catalog.warnings))
    for entry in catalog:
        kind = detect(entry)
        peeked: dict[Selector, list[str] | None] = {}

        def peek(selector: Selector, entry=entry, peeked=peeked):
            key = (selector.format, selector.unit, tuple(sorted(selector.read.items())))
            if key not in peeked:
                peeked[key] = readers.peek_columns(entry, selector)
            return peeked[key]

        found = match_file(presets, entry.logical_path, kind, peek, _namespace(entry, kind), settings.root_prefix_depth)
        plan.warnings += found.notes
        for preset, selector, lacking in found.unsatisfied:
            plan.warnings.append(f"{entry.logical_path}: {preset.id} lies right but lacks {', '.join(lacking)}")
        if not found.chosen:
            plan.unmatched.append(entry.logical_path)
        for preset, selector in found.chosen:
            single_role(preset)
            plan.sources.append(Source(entry, preset, selector, readers.unique_names(peek(selector) or readers.table_of(entry, selector, True)[0])))
    return plan


def plan_forced(entry: Entry, preset: Preset) -> Plan:
    """One file and one preset: where it lies does not matter, its format must be right.

    Where the preset's sheet or table is not there, the one whose columns fit best is
    taken.
    """
    single_role(preset)
    selector = preset.selectors[0]
    readers.check_kind(entry, selector)
    columns = readers.peek_columns(entry, selector)
    if columns is None and not selector.sql and selector.format in ("excel", "sqlite"):
        names = list(readers.sheet_names(entry)) if selector.format == "excel" else readers.sqlite_tables(entry)
        from dataclasses import replace

        options = []
        for order, name in enumerate(names):
            other = replace(selector, **{"sheet" if selector.format == "excel" else "table": name})
            there = readers.peek_columns(entry, other)
            if there is not None and not missing_columns(preset, there):
                options.append((-score(preset, there), order, other, there))
        if not options:
            raise PresetError(f"{entry.logical_path} has nothing that {preset.id} can read")
        _, _, selector, columns = min(options, key=lambda o: o[:2])
    columns = columns if columns is not None else readers.table_of(entry, selector, True)[0]
    lacking = missing_columns(preset, columns)
    return Plan([Source(entry, preset, selector, readers.unique_names(columns))], warnings=[f"{entry.logical_path}: {preset.id} lacks {', '.join(lacking)}"] if lacking else [])


def assemble_source(spark: SparkSession, source: Source, settings: Settings, entity: str | None, linked: str | None, fingerprint: str) -> DataFrame:
    table = readers.read_table(spark, source.entry, source.selector, settings.staging, source.preset.tier)
    run = Run(
        entity=entity, linked_entity=linked, local_zone=settings.local_zone, input_file_path=source.entry.disk_path, logical_path=source.entry.logical_path,
        fingerprint=fingerprint, passthrough=settings.source_columns, prefix=settings.source_column_prefix,
    )
    rows = assemble(table, source.preset, run, source.selector, hidden=("_recovery",))
    if source.preset.uid is not None:
        twice = check_unique(rows).limit(1).collect()
        if twice:
            raise ValueError(f"{source.entry.logical_path}: record id {twice[0][0]!r} stands {twice[0][1]} times")
    return rows


def process(
    spark: SparkSession, source: str | Path, presets: str | Path | list, output: str | Path | None = None, *, entity: str | None = None,
    linked_entity: str | None = None, settings: Settings | None = None, verify: bool = True, **given,
) -> Result:
    """Run presets over a file, archive or folder; write CSV and JSON if `output` (a folder) is given.

    Everything up to the rows is planning. The rows are one lazy plan: a scan and a
    projection per source, a union, and one window shuffle.
    """
    settings = settings or load_settings(**given)
    paths = presets if isinstance(presets, list) else [presets]
    loaded = [q for p in paths for q in ([p] if isinstance(p, Preset) else load_presets(p))]
    depth = settings.archive_depth
    catalog = discover(source, depth)
    forced = Path(source).is_file() and len(loaded) == 1 and len(catalog.entries) == 1 and not catalog.entries[0].chain
    plan = plan_forced(catalog.entries[0], loaded[0]) if forced else plan_sources(catalog, loaded, settings)
    started = datetime.now(timezone.utc)
    for w in plan.warnings:
        log.warning(w)
    needs = any(r.kind == "param" and r.arg == "entity" for s in plan.sources for r, _ in s.preset.refs())
    if needs and not entity:
        raise ValueError("a preset asks for the run's entity, and none is given")
    integrity = Integrity([s.entry for s in plan.sources])
    order = ["_source", "_line", "_ordinal"]
    frames = []
    for number, s in enumerate(plan.sources):
        rows = assemble_source(spark, s, settings, entity, linked_entity, integrity.before[s.entry.logical_path])
        frames.append(rows.withColumn("_source", F.lit(number)))
    if not frames:
        return Result(spark.createDataFrame([], "preset_id string"), [], warnings=[{"message": w} for w in plan.warnings], unmatched=plan.unmatched)
    united = union_all(frames)
    ranked = untangle(united, settings.rank_resolution_us, order, ["preset_id"] if settings.split else None)
    result = Result(ranked, plan.sources, warnings=[{"message": w} for w in plan.warnings], unmatched=plan.unmatched)
    if output is not None:
        _write(ranked, plan, Path(output), settings, order, result, integrity if verify else None, started)
    return result


def _write(ranked: DataFrame, plan: Plan, folder: Path, settings: Settings, order: list[str], result: Result, integrity: Integrity | None, started) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    kept = ranked.persist()
    try:
        sizes = {(r["_source"], r["preset_id"]): (r["records"], r["rows"], r["ranked"]) for r in kept.groupBy("_source", "preset_id").agg(F.countDistinct("_line").alias("records"), F.count("*").alias("rows"), F.count("record_rank").alias("ranked")).collect()}
        notes = kept.select("_source", F.explode(WARNINGS).alias("w")).groupBy("_source", "w.field", "w.step").agg(F.count("*").alias("rows"), F.min("w.value").alias("example")).collect()
        result.warnings += [{"source": plan.sources[n["_source"]].entry.logical_path, "preset": plan.sources[n["_source"]].preset.id, "field": n["field"], "step": n["step"], "rows": n["rows"], "example": n["example"]} for n in notes]
        hashes = integrity.verify() if integrity else {}
        lineage = []
        for number, s in enumerate(plan.sources):
            records, rows, ranked_rows = sizes.get((number, s.preset.id), (0, 0, 0))
            states = frontier.frontier(s.columns, list(s.preset.expected), [str(r.arg) for r, _ in s.preset.refs() if r.kind == "column"])
            lineage.append({
                "source": s.entry.logical_path, "input_file_path": s.entry.disk_path, "format": s.selector.format, "unit": s.selector.unit, "integrity": hashes.get(s.entry.logical_path),
                "preset": {"id": s.preset.id, "name": s.preset.title, "version": s.preset.version}, "record_count": records, "assertion_count": rows, "ranked": ranked_rows, "columns": states,
            })
            for state in ("new", "drift_missing", "mapped_absent"):
                if states[state] and s.preset.expected:
                    result.warnings.append({"source": s.entry.logical_path, "preset": s.preset.id, "frontier": state, "columns": states[state]})
        groups = {"assertions": None}
        if settings.split:
            taken: set[str] = set()
            groups = {sinks.safe_file_name(next(s.preset.title for s in plan.sources if s.preset.id == i), taken): i for i in dict.fromkeys(s.preset.id for s in plan.sources)}
        for name, preset_id in groups.items():
            part = kept if preset_id is None else kept.where(F.col("preset_id") == preset_id)
            path = folder / f"{name}.csv"
            written = sinks.write_csv(sinks.rendered(part.orderBy(*order)), path)
            own = [x for x in lineage if preset_id is None or x["preset"]["id"] == preset_id]
            warned = [w for w in result.warnings if preset_id is None or w.get("preset") in (None, preset_id)]
            trace = {"version": 1, "started": started.isoformat(), "sources": own, "unmatched": plan.unmatched, "prov": provenance(own, path.name, started)}
            result.outputs += [*([path] if written else []), sinks.write_json(trace, folder / f"{name}.traceability.json"), sinks.write_json({"warnings": warned, "unmatched": plan.unmatched}, folder / f"{name}.warnings.json")]
        result.counts = {"sources": len(plan.sources) + len(plan.unmatched), "matched": len(plan.sources), "rows": sum(v[1] for v in sizes.values()), "ranked": sum(v[2] for v in sizes.values())}
    finally:
        kept.unpersist()


def provenance(lineage: list[dict], output: str, started: datetime) -> dict:
    """The run as W3C PROV-JSON: sources and presets used by an activity that generated the output."""
    entities = {f"out:{output}": {"prov:type": "output"}}
    used = {}
    for i, x in enumerate(lineage):
        digest = (x.get("integrity") or {}).get("before")
        entities[f"src:{x['source']}"] = {"prov:type": "source", "sha256": digest}
        entities[f"preset:{x['preset']['id']}"] = {"prov:type": "preset", "version": x["preset"]["version"]}
        used[f"u{2 * i}"] = {"prov:activity": "run", "prov:entity": f"src:{x['source']}"}
        used[f"u{2 * i + 1}"] = {"prov:activity": "run", "prov:entity": f"preset:{x['preset']['id']}"}
    return {
        "prefix": {"src": "urn:source:", "preset": "urn:preset:", "out": "urn:output:"}, "entity": entities,
        "activity": {"run": {"prov:startTime": started.isoformat()}}, "used": used,
        "wasGeneratedBy": {"g0": {"prov:entity": f"out:{output}", "prov:activity": "run"}},
        "wasDerivedFrom": {f"d{i}": {"prov:generatedEntity": f"out:{output}", "prov:usedEntity": f"src:{x['source']}"} for i, x in enumerate(lineage)},
    }


__all__ = ["Result", "Settings", "load_preset", "process"]
