"""Set operators: views of a database merged, and outputs of many sources united."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import cols


def distinct_in_order(rows: DataFrame, columns: list[str], line: str = "_line") -> DataFrame:
    """Distinct rows over `columns` (nulls are alike), each at its first position."""
    return rows.groupBy(*cols(columns)).agg(F.min(line).alias(line))


def merge_views(database: DataFrame, with_sidecar: DataFrame, columns: list[str], sidecar: str = "wal", line: str = "_line") -> DataFrame:
    """One table from a database read without and with its sidecar files.

    Columns: `columns`, `recovery` (both, db_only_unique, or the sidecar's name) and a
    position by which the database's rows come first and those only in the sidecar
    view after them. Rows are distinct, nulls alike. Both views are tagged, united and
    grouped once, so there is one shuffle and no join.
    """
    tagged = database.select(*cols(columns), F.lit(0).alias("_view"), F.col(line).alias("_at")).unionByName(
        with_sidecar.select(*cols(columns), F.lit(1).alias("_view"), F.col(line).alias("_at"))
    )
    merged = tagged.groupBy(*cols(columns)).agg(F.min(F.when(F.col("_view") == 0, F.col("_at"))).alias("_db"), F.min(F.when(F.col("_view") == 1, F.col("_at"))).alias("_side"))
    label = F.when(F.col("_db").isNotNull() & F.col("_side").isNotNull(), "both").when(F.col("_db").isNotNull(), "db_only_unique").otherwise(sidecar)
    return merged.select(*cols(columns), label.alias("recovery"), F.struct(F.col("_db").isNull().alias("late"), F.coalesce("_db", "_side").alias("at")).alias("position"))


def recovery_state(merged: DataFrame, column: str = "recovery") -> DataFrame:
    """Rows of the database are live whether or not the sidecar view has them; others keep the sidecar's name."""
    return merged.withColumn(column, F.when(F.col(column).isin("both", "db_only_unique"), "live").otherwise(F.col(column)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames by column name, missing columns null, in order of first appearance."""
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of `columns` that only the left side has (nulls are alike)."""
    return left.select(*cols(columns)).subtract(right.select(*cols(columns)))
