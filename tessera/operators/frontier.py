"""Reports on columns and rows: what a source has, what its preset expects, what came out."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontier(present: list[str], expected: list[str], mapped: list[str]) -> dict[str, list[str]]:
    """Columns by state: known, new, drift_missing (expected but absent), mapped_absent (read but absent).

    Expected names may be globs; a glob is missing if nothing matches it.
    """
    covers = lambda pattern, name: fnmatch.fnmatchcase(name, pattern)
    known = [c for c in present if any(covers(e, c) for e in expected)]
    return {
        "known": known,
        "new": [c for c in present if c not in known],
        "drift_missing": [e for e in expected if not any(covers(e, c) for c in present)],
        "mapped_absent": [m for m in mapped if not any(covers(m, c) for c in present)],
    }


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and ranked rows, in all or per key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count("record_rank").alias("ranked"))


def completeness_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled): how many rows have a value in each column, in one pass."""
    filled = rows.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    return filled.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "filled"))
