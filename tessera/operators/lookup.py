"""Joins: a record's source by its model id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import cols


def first_wins(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One entry per key, the first in order; aggregated before the shuffle, so a key of many entries costs no more."""
    rest = [c for c in entries.columns if c != key]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return entries.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def with_source(records: DataFrame, entries: DataFrame, record_key: str, entry_key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Records with the columns of their first entry, null where there is none.

    Adaptive execution broadcasts the entries if they turn out small and splits skewed
    keys if not; nothing is forced.
    """
    build = first_wins(entries.select(entry_key, *dict.fromkeys([*order, *columns])), entry_key, order)
    build = build.select(F.col(entry_key).alias("_key"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = records.join(build, F.col(record_key) == F.col("_key"), "left")
    return joined.select(*cols(records.columns), *[F.col(f"_s_{c}").alias(c) for c in columns])


def numbered(rows: DataFrame, order: list[str], within: list[str], name: str = "_line") -> DataFrame:
    """1-based positions within groups, by an explicit order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
