"""Deterministic ids of records and rows (UUID version 5)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The name spaces of the two kinds of id.
RECORD_SPACE = uuid.UUID("6f9b1d2e-7c3a-5e41-9a2b-0c8d4e1f2a3b")
ROW_SPACE = uuid.UUID("b3a0c1d2-4e5f-5a6b-8c9d-0e1f2a3b4c5d")


def uuid5(space: uuid.UUID, name: Column) -> Column:
    """UUID version 5 of a name, within code generation: SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def record_uid(fingerprint: Column, raw_source_path: Column, line: Column) -> Column:
    """Id of a source record: its source's fingerprint, its path in there, and its position."""
    path = F.coalesce(raw_source_path, F.lit("None"))
    return uuid5(RECORD_SPACE, F.concat_ws("|", fingerprint, path, line.cast("string")))


def row_uid(fingerprint: Column, raw_source_path: Column, line: Column, ordinal: Column, content: list[tuple[str, Column]], no_offset: Column) -> Column:
    """Id of an output row: the record's parts, the assertion's ordinal, and every content column as Python writes it.

    Python's spelling of floats and strings is part of the id, so it is made by an
    Arrow-batched function over just these columns. Where `no_offset` holds, the offset
    is spelled N/A.
    """
    names = [name for name, _ in content]

    @F.pandas_udf(T.StringType())
    def make(prefix: pd.Series, unknown: pd.Series, body: pd.DataFrame) -> pd.Series:
        columns = [_plain(body[n]) for n in names]
        if "utc_offset_hours" in names:
            at = names.index("utc_offset_hours")
            columns[at] = ["N/A" if u is True else v for v, u in zip(columns[at], unknown.tolist())]
        rows = zip(prefix.tolist(), *columns)
        return pd.Series([str(uuid.uuid5(ROW_SPACE, f"{p}|" + "|".join(f"{n}={v!r}" for n, v in zip(names, values)))) for p, *values in rows])

    prefix = F.concat_ws("|", fingerprint, F.coalesce(raw_source_path, F.lit("None")), line.cast("string"), ordinal.cast("string"))
    # whole numbers travel as text: a batch with nulls would turn them into floats
    return make(prefix, F.coalesce(no_offset, F.lit(False)), F.struct(*[(c.cast("string") if n in WHOLE else c).alias(n) for n, c in content]))


#: Content columns of whole numbers.
WHOLE = {"time_lower_unix_utc_us", "time_upper_unix_utc_us", "time_accuracy_us"}


def _plain(column: pd.Series) -> list:
    values = column.astype(object).where(column.notna(), None).tolist()
    return [None if v is None else int(v) for v in values] if column.name in WHOLE else values
