"""Scalar functions of presets as Column builders. A value that cannot be converted becomes null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of truth.
TRUE, FALSE = ["1", "true", "yes", "y", "t"], ["0", "false", "no", "n", "f", ""]


def cast_soft(value: Column, kind: str) -> Column:
    """cast(int|float|str|bool): ints take only integral text and truncate floats; unknown truth words are null."""
    if kind == "str":
        return value.cast("string")
    if kind == "float":
        return value.try_cast("double")
    if kind == "int":
        text = F.trim(value.cast("string"))
        return F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text.try_cast("long")).when(
            F.typeof(value).isin("double", "float"), _truncate(value.try_cast("double")).try_cast("long")
        )
    if kind == "bool":
        word = F.lower(F.trim(value.cast("string")))
        return F.when(word.isin(TRUE), F.lit(True)).when(word.isin(FALSE), F.lit(False))
    raise ValueError(f"cast to {kind!r}: expected int, float, str or bool")


def _truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def cast_hard(value: Column, kind: T.DataType | str) -> Column:
    """The cast to a column's type; a value that has no such form fails the query."""
    return value.cast({"int": "long", "float": "double", "str": "string", "bool": "boolean"}.get(kind, kind) if isinstance(kind, str) else kind)


def scale(value: Column, factor: float) -> Column:
    return value.try_cast("double") * F.lit(float(factor))


def lookup_key(value: Column, kind: T.DataType | None = None) -> Column:
    """Key under which 1, 1.0 and "1" are the same, and truth values are True and False."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = value == F.floor(value)
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def plain_key(key: object) -> str:
    if isinstance(key, float) and key.is_integer():
        return str(int(key))
    return str(key)


def lookup(value: Column, table: dict, on_unknown: str = "raw", kind: T.DataType | None = None) -> Column:
    """The table's entry; for values it does not have, the value itself (raw), null, or an error."""
    if on_unknown not in ("raw", "null", "error"):
        raise ValueError(f"on_unknown={on_unknown!r}: expected raw, null or error")
    key = lookup_key(value, kind)
    if not table:
        found = F.lit(None).cast("string")
    else:
        pairs = [F.lit(x) for k, v in table.items() for x in (plain_key(k), None if v is None else str(v))]
        found = F.try_element_at(F.create_map(*pairs), key)
    known = key.isin([plain_key(k) for k in table])
    if on_unknown == "raw":
        return F.when(known, found).otherwise(value.cast("string"))
    if on_unknown == "null":
        return found
    return F.when(value.isNull() | known, found).otherwise(F.raise_error(F.concat(F.lit("no entry for "), key)))


def java_pattern(pattern: str, group: str) -> tuple[str, int]:
    """A pattern without group names, and the index of the named group."""
    compiled = re.compile(pattern)
    if group not in compiled.groupindex:
        raise ValueError(f"pattern {pattern!r} has no group named {group!r}")
    return re.sub(r"\(\?P<\w+>", "(", pattern), compiled.groupindex[group]


def regex_group(value: Column, pattern: str, group: str) -> Column:
    """The named group of the first match; null where nothing matches or the group took no part."""
    java, index = java_pattern(pattern, group)
    text = value.cast("string")
    took = F.regexp_extract_all(text, F.lit(java), F.lit(index))
    return F.when(F.rlike(text, F.lit(java)), F.get(took, F.lit(0)))


def split_part(value: Column, separator: str, index: int | None = None) -> Column:
    """One part of a split, counted from the end if negative; without an index, all parts."""
    parts = F.split(value.cast("string"), re.escape(separator).replace("/", "\\/") if separator != "/" else "/", -1)
    return parts if index is None else F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


def non_blank(value: Column, kind: T.DataType) -> Column:
    """Not null, not NaN, and not white space alone."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    if isinstance(kind, T.StringType):
        return value.isNotNull() & (F.trim(value) != "")
    return value.isNotNull()


def no_nan(value: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(value), value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def genesis(entity_time_link: Column, table: dict[str, str]) -> Column:
    """How a trace came to exist, by its entity-time link."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), entity_time_link)


def safe_name(text: Column) -> Column:
    """A name fit for files: everything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def xml_namespace(text: Column) -> Column:
    """The first default namespace declared in a text, or null."""
    found = F.regexp_extract(text, r"xmlns=[\"']([^\"']+)[\"']", 1)
    return F.when(found != "", found)
