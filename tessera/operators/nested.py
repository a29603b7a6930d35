"""Nested models: flattening of hierarchies, fields in order of first sight, maps to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 3


def flatten(models: DataFrame, children: str = "children") -> DataFrame:
    """(level, model_type, top_type, id, parent_id, fields): models and those below them, three levels deep.

    `models` has id, model_type, fields (a map) and, if there are any, an array of
    children of the same shape. Each level is one generator over the level above; there
    is no shuffle.
    """
    own = lambda p: [F.col(f"{p}id").alias("id"), F.col(f"{p}model_type").alias("model_type"), F.col(f"{p}fields").alias("fields")]
    level = models.withColumn("top_type", F.col("model_type")).withColumn("parent_id", F.lit(None).cast("string"))
    out = None
    for depth in range(LEVELS):
        rows = level.select(F.lit(depth).alias("level"), "model_type", "top_type", "id", "parent_id", "fields")
        out = rows if out is None else out.unionByName(rows)
        kind = level.schema[children].dataType if children in level.columns else None
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            break
        below = level.select(F.col("id").alias("parent_id"), "top_type", F.explode(children).alias("_c"))
        deeper = [F.col(f"_c.{children}").alias(children)] if children in kind.elementType.names else []
        level = below.select(*own("_c."), "parent_id", "top_type", *deeper)
    return out


def of_types(flat: DataFrame, types: list[str]) -> DataFrame:
    """Models of the given top-level types, with everything below them."""
    return flat.where(F.col("top_type").isin(types))


def first_seen(rows: DataFrame, keys: list[str], fields: str, order: str) -> DataFrame:
    """(keys, field, seq): each field and where it was first seen."""
    return rows.select(*keys, order, F.explode(F.map_keys(fields)).alias("field")).groupBy(*keys, "field").agg(F.min(order).alias("seq"))


def field_order(rows: DataFrame, keys: list[str], fields: str, order: str) -> DataFrame:
    """(keys, names): the fields of each kind in order of first sight, ties by name; as many rows as kinds."""
    seen = first_seen(rows, keys, fields, order)
    return seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "field"))), lambda x: x["field"]).alias("names"))


def pivot(rows: DataFrame, keys: list[str], fields: str, names: list[str]) -> DataFrame:
    """Map entries as columns, null where a row has none; no shuffle."""
    return rows.select(*keys, *[F.try_element_at(F.col(fields), F.lit(n)).alias(n) for n in names])
