"""Assertion assembly: the projection and fan-out that a preset compiles to.

One scan of the source, one row of values, and one generator that turns each record
into as many rows as the preset has assertions. What several columns need (a time's text,
wall clock and instant) is computed once, in projections below the generator, whose
structs hold references only. References are resolved against the schema when the plan
is made; nothing is looked up per row. Problems that a preset
lets pass are collected per row in `_warnings`.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, identity, scalars
from ..functions.arithmetic import compile_arithmetic
from ..functions.names import col, cols
from ..plans.grammar import Ref, Step
from ..plans.preset import Assertion, Field, Preset, PresetError, Selector, Time
from ..schema import IDENTITY_COLUMNS, OFFSET_STATE, OUTPUT_COLUMNS, column_type, unit_factor

WARNINGS = "_warnings"
_WARNING = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("step", T.StringType()), T.StructField("value", T.StringType())]))


@dataclass(frozen=True)
class Run:
    """What a run knows about a source besides its rows."""

    entity: str | None = None
    linked_entity: str | None = None
    local_zone: str | None = None
    input_file_path: str | None = None
    logical_path: str | None = None
    fingerprint: str = ""
    passthrough: bool = True
    prefix: str = "orig_"
    exact_row_uid: bool = True


def resolve(name: str, columns: list[str]) -> str | None:
    """The source column that a name or glob means; none is null, several are an error."""
    if not any(c in name for c in "*?["):
        return name if name in columns else None
    found = [c for c in columns if fnmatch.fnmatchcase(c, name)]
    if len(found) > 1:
        raise PresetError(f"column({name}) is ambiguous: {', '.join(found)}")
    return found[0] if found else None


class Compiler:
    """Compiles a preset against a source's schema."""

    def __init__(self, preset: Preset, selector: Selector, run: Run, source: DataFrame, hidden: set[str]):
        self.preset, self.selector, self.run = preset, selector, run
        self.types = {f.name: f.dataType for f in source.schema if f.name not in hidden}
        self.columns = list(self.types)
        self.warnings: list[Column] = []
        self.layers: list[list[Column]] = []
        self._bounds: dict = {}

    def let(self, level: int, value: Column) -> Column:
        """The value by a name, computed once in the projection of its level; it may refer to those of lower levels."""
        while len(self.layers) <= level:
            self.layers.append([])
        name = f"_let_{level}_{len(self.layers[level])}"
        while name in self.columns:
            name += "_"
        self.layers[level].append(value.alias(name))
        return F.col(name)

    def laid(self, source: DataFrame) -> DataFrame:
        for layer in self.layers:
            source = source.select("*", *layer)
        return source

    def _source(self, name: str) -> Column:
        kind = self.types[name]
        return scalars.no_nan(col(name), kind)

    def ref(self, ref: Ref) -> tuple[Column, T.DataType, str | None]:
        """(value, type, name of the source column)."""
        text = T.StringType()
        if ref.kind in ("column", "header"):
            name = resolve(str(ref.arg), self.columns)
            if ref.kind == "header" or name is None:
                return F.lit(name).cast("string"), text, name
            return self._source(name), self.types[name], name
        if ref.kind == "const":
            value = ref.arg
            kind = T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else text
            return F.lit(value).cast(kind), kind, None
        if ref.kind == "filename":
            path = (self.run.logical_path or self.run.input_file_path or "").replace("\\", "/")
            base = path.rpartition("/")[2]
            value = {"path": path, "name": base, "stem": base.rpartition(".")[0] or base}[str(ref.arg)]
        elif ref.kind == "param":
            value = getattr(self.run, str(ref.arg))
        else:
            p, s = self.preset, self.selector
            value = {
                "id": p.id, "name": s.name or p.title, "tier": p.tier, "os": p.os, "tool": p.tool, "version": p.version, "os_version": p.os_version,
                "path": s.path, "format": s.format, "table": s.table, "sheet": s.sheet, "sql": s.sql,
            }[str(ref.arg)]
        return F.lit(value).cast("string"), text, None

    def _step(self, step: Step, value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
        args, options = list(step.args), dict(step.options)
        if step.name == "cast":
            to = str(args[0])
            return scalars.cast_soft(value, to), {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}.get(to, T.StringType())
        if step.name == "scale":
            return scalars.scale(value, float(args[0])), T.DoubleType()
        if step.name == "arithmetic":
            return compile_arithmetic(str(args[0]))(value), T.DoubleType()
        if step.name == "lookup":
            if args[0] not in self.preset.lookups:
                raise PresetError(f"lookup({args[0]}): no such table")
            return scalars.lookup(value, self.preset.lookups[args[0]], str(options.get("on_unknown", "raw") or "null"), kind), T.StringType()
        if step.name == "regex":
            pattern = self.preset.patterns.get(str(args[0]), str(args[0]))
            return scalars.regex_group(value, pattern, str(options["group"])), T.StringType()
        if step.name == "split":
            index = options.get("index")
            return scalars.split_part(value, str(args[0]), index), T.StringType() if index is not None else T.ArrayType(T.StringType())
        from ..plans.registry import transform

        return transform(step.name)(value, args, options)

    def value(self, f: Field, cast: bool = True) -> tuple[Column, T.DataType, str | None]:
        """Reference, extract, pipe, unit, cast, in this order."""
        value, kind, name = self.ref(f.ref)
        if f.extract:
            value, kind = scalars.regex_group(value, self.preset.patterns[f.extract[0]], f.extract[1]), T.StringType()
        for step in f.pipe:
            policy = str(step.options.get("on_error") or "null")
            done, done_kind = self._step(Step(step.name, step.args, {k: v for k, v in step.options.items() if k != "on_error"}), value, kind)
            failed = value.isNotNull() & done.isNull()
            if step.name != "lookup":
                note = F.struct(F.lit(f.column).alias("field"), F.lit(step.name).alias("step"), value.cast("string").alias("value"))
                self.warnings.append(F.when(failed, note))
            if policy == "raw":
                value, kind = F.coalesce(done.cast("string"), value.cast("string")), T.StringType()
            elif policy == "error":
                value, kind = F.when(failed, F.raise_error(F.concat(F.lit(f"{f.column}: {step.name} failed on "), value.cast("string"))).cast(done_kind)).otherwise(done), done_kind
            elif policy == "null":
                value, kind = done, done_kind
            else:
                raise PresetError(f"on_error={policy!r}: expected null, raw or error")
        if f.unit:
            value, kind = value.cast("double") * F.lit(unit_factor(f.column, f.unit)), T.DoubleType()
        if cast:
            target = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType()}.get(f.type or "", column_type(f.column))
            value = value.cast(target).cast(column_type(f.column))
            kind = column_type(f.column)
        return value, kind, name

    def _bound(self, ref: Ref, time: Time) -> tuple[Column, Column, Column, str | None]:
        """(raw text, instant, source offset or null, source column); the offset is NaN where a zone was assumed."""
        key = (ref, time.epoch, time.format, time.zone)
        if key not in self._bounds:
            self._bounds[key] = self._make_bound(ref, time)
        return self._bounds[key]

    def _make_bound(self, ref: Ref, time: Time) -> tuple[Column, Column, Column, str | None]:
        value, _, name = self.ref(ref)
        value = self.let(0, value)
        nothing = F.lit(None).cast("double")
        if time.epoch:
            us, offset = self.let(1, clock.epoch_us(value, time.epoch)), nothing
        elif time.format:
            wall, found = (self.let(1, c) for c in (clock.iso_us(value) if time.format == "iso8601" else clock.strptime_us(value, time.format)))
            zone = self.let(0, self.value(time.zone, cast=False)[0].cast("string")) if time.zone else F.lit(None).cast("string")
            base = self.let(1, clock.zone_offset(zone)) if time.zone else F.lit(None).cast("double")
            fixed = wall - (F.coalesce(base, F.lit(0.0)) * clock.HOUR_US).cast("long")
            assumed = F.coalesce(base, F.lit(float("nan")))
            if self.run.local_zone:
                local = clock.zone_is_local(zone)
                naive = F.when(local, clock.local_to_utc_us(wall, self.run.local_zone)).otherwise(fixed)
                anomaly = clock.wall_clock_anomaly(wall, F.lit(self.run.local_zone))
                note = F.struct(F.lit("time").alias("field"), F.concat(F.lit("clock "), anomaly).alias("step"), value.cast("string").alias("value"))
                self.warnings.append(F.when(found.isNull() & local & anomaly.isNotNull(), note))
                standard = F.lit(clock.standard_offset(self.run.local_zone))
                note = F.struct(F.lit("time").alias("field"), F.lit("base offset is not the local zone's").alias("step"), zone.alias("value"))
                self.warnings.append(F.when(found.isNull() & local & base.isNotNull() & (F.abs(base - standard) > 1e-9), note))
            else:
                naive = fixed
                note = F.struct(F.lit("time").alias("field"), F.lit("local zone not set").alias("step"), value.cast("string").alias("value"))
                self.warnings.append(F.when(found.isNull() & clock.zone_is_local(zone) & wall.isNotNull(), note))
            us = self.let(2, F.when(found.isNotNull(), wall - (found * clock.HOUR_US).cast("long")).otherwise(naive))
            offset = F.when(us.isNotNull(), F.coalesce(found, assumed))
        else:
            us, offset = self.let(1, clock.whole_us(value)), nothing
        raw = value.cast("string")
        return F.when(value.isNotNull(), raw), us, offset, name

    def time(self, time: Time) -> dict[str, Column]:
        out = {f.column: self.value(f)[0] for f in time.overrides}
        low_raw, low, low_offset, low_name = self._bound(time.lower, time)
        high_raw, high, _, high_name = self._bound(time.upper, time) if time.upper != time.lower else (low_raw, low, None, low_name)
        low_offset = self.let(3, low_offset)
        unknown = F.isnan(low_offset)
        known = low_offset
        if self.run.local_zone:
            known = clock.offset_at(low, F.lit(self.run.local_zone))
        known = F.when(F.coalesce(unknown, F.lit(False)), F.lit(None).cast("double")).otherwise(known)
        before = out.get("utc_offset_hours", F.lit(None).cast("double"))
        out |= {
            "time_lower_raw": low_raw, "time_lower_source_field": F.lit(low_name).cast("string"), "time_lower_unix_utc_us": low,
            "time_upper_raw": high_raw, "time_upper_source_field": F.lit(high_name).cast("string"), "time_upper_unix_utc_us": high,
            "utc_offset_hours": F.when(low.isNotNull() & F.coalesce(unknown, F.lit(False)), F.lit(None).cast("double")).when(low.isNotNull(), F.coalesce(known, before)).otherwise(before),
        }
        out[OFFSET_STATE] = F.when(low.isNotNull() & F.coalesce(unknown, F.lit(False)), "unknown").when(out["utc_offset_hours"].isNotNull(), "known")
        return out

    def assertion(self, a: Assertion) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in a.fields:
            value, _, name = self.value(f)
            out[f.column] = value
            for axis in ("latitude", "longitude"):
                if f.column == f"{axis}_wgs84":
                    out[f"{axis}_source_field"] = F.lit(name).cast("string")
        return out | self.time(a.time)


def _passthrough(columns: list[str], prefix: str) -> dict[str, str]:
    """Names under which source columns are kept, free of clashes."""
    out: dict[str, str] = {}
    for c in columns:
        name = f"{prefix}{c}"
        while name in out.values() or name in OUTPUT_COLUMNS:
            name += "_"
        out[c] = name
    return out


def assemble(source: DataFrame, preset: Preset, run: Run | None = None, selector: Selector | None = None, line: str = "_line", hidden: tuple[str, ...] = ()) -> DataFrame:
    """Assertion rows of a source: output columns, the offset's state, `_line`, `_ordinal`, `_warnings`, and source columns.

    `line` is the source's column of 1-based positions. A mapped record id must be there
    and unique: a null or repeated one fails the query (see `check_unique`). Columns
    named in `hidden` are not part of the source.
    """
    run, selector = run or Run(), selector or preset.selectors[0]
    c = Compiler(preset, selector, run, source, {line, *hidden})
    base: dict[str, Column] = {f.column: c.value(f)[0] for f in preset.common}
    for name in ("entity", "linked_entity"):
        if getattr(run, name):
            base[name] = F.lit(getattr(run, name))
    base |= {"input_file_path": F.lit(run.input_file_path).cast("string"), "preset_id": F.lit(preset.id), "preset_name": F.lit(preset.title)}
    tier, path = F.lit(preset.tier).cast("string"), F.lit(run.logical_path or run.input_file_path).cast("string")
    base["source_tier"] = F.coalesce(base["source_tier"], tier) if "source_tier" in base else tier
    base["raw_source_path"] = F.coalesce(base["raw_source_path"], path) if "raw_source_path" in base else path
    container = selector.table or selector.sheet or ("query" if selector.sql else "")
    place = F.concat(F.lit(f"{container}#"), F.col(line).cast("string"))
    base["input_record_id"] = F.coalesce(base["input_record_id"], place) if "input_record_id" in base else place
    mapped = c.value(preset.uid, cast=False)[0].cast("string") if preset.uid else None
    fingerprint = F.lit(run.fingerprint)
    base["source_record_uid"] = (
        identity.record_uid(fingerprint, base["raw_source_path"], F.col(line))
        if mapped is None
        else F.when(mapped.isNull(), F.raise_error(F.concat(F.lit("no record id at line "), F.col(line).cast("string"))).cast("string")).otherwise(mapped)
    )
    kind = lambda n: column_type(n) if n != OFFSET_STATE else T.StringType()
    own = [c.assertion(a) for a in preset.assertions]
    named = {f"_all_{n}": v.cast(kind(n)) for n, v in base.items() if not all(n in o for o in own)}
    named |= {f"_own_{i}_{n}": v.cast(kind(n)) for i, o in enumerate(own) for n, v in o.items()}
    nothing = {n: f"CAST(NULL AS {kind(n).simpleString()})" for n in (*OUTPUT_COLUMNS, OFFSET_STATE)}
    part = lambda i, o, n: f"_own_{i}_{n}" if n in o else f"_all_{n}" if n in base else nothing[n]
    rows = ", ".join(f"named_struct('_ordinal', {i}, {', '.join(f"'{n}', {part(i, o, n)}" for n in nothing)})" for i, o in enumerate(own))
    kept = _passthrough(c.columns, run.prefix) if run.passthrough else {}
    notes = F.filter(F.array(*c.warnings), lambda w: w.isNotNull()) if c.warnings else F.array().cast(_WARNING)
    below = c.laid(source).select(F.col(line).alias("_line"), *[col(s).alias(t) for s, t in kept.items()], notes.alias(WARNINGS), *[v.alias(n) for n, v in named.items()])
    wide = below.select("_line", *cols(list(kept.values())), WARNINGS, F.expr(f"inline(array({rows}))"))
    if run.exact_row_uid:
        uid = _row_uid(fingerprint)
    else:
        body = F.to_json(F.struct(*[F.col(n) for n in IDENTITY_COLUMNS]))
        uid = identity.uuid5(identity.ROW_SPACE, F.concat_ws("|", fingerprint, F.coalesce("raw_source_path", F.lit("None")), F.col("_line").cast("string"), F.col("_ordinal").cast("string"), body))
    wide = wide.withColumn("row_uid", uid)
    return wide.select(*OUTPUT_COLUMNS, OFFSET_STATE, "_line", "_ordinal", WARNINGS, *cols(list(kept.values())))


def _row_uid(fingerprint: Column) -> Column:
    """The exact row id; the offset is spelled N/A where it is unknown."""
    content = [(n, F.col(n)) for n in IDENTITY_COLUMNS]
    return identity.row_uid(fingerprint, F.col("raw_source_path"), F.col("_line"), F.col("_ordinal"), content, F.col(OFFSET_STATE) == "unknown")


def check_unique(rows: DataFrame, uid: str = "source_record_uid") -> DataFrame:
    """Record ids that more than one record has, with their number; a run with any must not go on."""
    records = rows.where(F.col("_ordinal") == 0) if "_ordinal" in rows.columns else rows
    return records.groupBy(uid).agg(F.count("*").alias("records")).where("records > 1")
