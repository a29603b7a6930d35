"""Untangle: rank the rows that say the same thing about the same time.

One shuffle and one sort: both window functions share their partitioning. Rows that lie
alone in their group keep null ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import cols
from ..functions.scalars import non_blank
from ..schema import COMPLETENESS

RESOLUTION_US = 1_000_000


def completeness(df: DataFrame, columns: list[str] | None = None) -> Column:
    """How many of the columns hold something."""
    kinds = {f.name: f.dataType for f in df.schema}
    held = [F.when(non_blank(F.col(c), kinds[c]), 1).otherwise(0) for c in columns or COMPLETENESS if c in kinds]
    return reduce(lambda a, b: a + b, held, F.lit(0))


def untangle(rows: DataFrame, resolution_us: int = RESOLUTION_US, order: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """The rows with record_rank and record_type set.

    Rows are grouped by both bounds on a grid of `resolution_us`, the entity, and the
    bounds' source fields (nulls are alike), within `scope` if given. In a group of two
    or more, the best accuracy comes first (none last), then the most complete, then
    `order`; rank 1 is main. Rows without both bounds are not ranked.
    """
    if resolution_us <= 0:
        raise ValueError("the resolution must be positive")
    grid = [F.floor(F.col(f"time_{b}_unix_utc_us") / F.lit(resolution_us)) for b in ("lower", "upper")]
    eligible = F.col("time_lower_unix_utc_us").isNotNull() & F.col("time_upper_unix_utc_us").isNotNull()
    keys = [*grid, F.col("entity"), F.col("time_lower_source_field"), F.col("time_upper_source_field"), *[F.col(c) for c in scope or []]]
    # ineligible rows are spread by their own order, for they would all meet in one group
    alone = F.when(~eligible, F.xxhash64(*[F.col(c) for c in order or ["_line", "_ordinal"]]))
    group = Window.partitionBy(*keys, eligible, alone)
    best = group.orderBy(F.col("horizontal_accuracy_m").asc_nulls_last(), F.col("_complete").desc(), *[F.col(c) for c in order or ["_line", "_ordinal"]])
    ranked = rows.withColumn("_complete", completeness(rows))
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_r", F.row_number().over(best))
    rank = F.when(eligible & (F.col("_n") > 1), F.col("_r")).cast("int")
    ranked = ranked.withColumn("record_rank", rank).withColumn("record_type", F.when(F.col("record_rank") == 1, "main").when(F.col("record_rank") > 1, "additional"))
    return ranked.select(*cols(rows.columns))
