"""Model drift: what a report's models have now against what was known before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "kind string, owner string, name string"


def observed(rows: DataFrame, type_col: str, fields_col: str, level: str = "event") -> DataFrame:
    """(kind, owner, name): the types and their fields in rows of JSON or map fields; distinct, combined before the shuffle."""
    fields = F.col(fields_col)
    if rows.schema[fields_col].dataType.simpleString() == "string":
        fields = F.from_json(fields, "map<string,string>")
    types = rows.select(F.lit("type").alias("kind"), F.lit(level).alias("owner"), F.col(type_col).alias("name"))
    names = rows.select(F.lit("field").alias("kind"), F.col(type_col).alias("owner"), F.explode(F.map_keys(fields)).alias("name"))
    return types.unionByName(names).distinct()


def relations(flat: DataFrame) -> DataFrame:
    """(kind, owner, name): which type holds which, from flattened models."""
    parents = flat.select(F.col("id").alias("parent_id"), F.col("model_type").alias("owner"))
    return flat.join(parents, "parent_id").select(F.lit("relation").alias("kind"), "owner", F.col("model_type").alias("name")).distinct()


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(kind, change, owner, name): new shapes, and fields that are gone from types that are still there.

    Types and relations that are gone are not reported: a report need not hold every type.
    """
    key = ["kind", "owner", "name"]
    new = now.join(before, key, "left_anti").select("kind", F.lit("new").alias("change"), "owner", "name")
    here = now.where("kind = 'type'").select(F.col("name").alias("owner")).distinct()
    gone = before.where("kind = 'field'").join(now, key, "left_anti").join(here, "owner", "left_semi")
    return new.unionByName(gone.select("kind", F.lit("removed").alias("change"), "owner", "name"))


def upsert_baseline(baseline: DataFrame, now: DataFrame, seen_at: str) -> DataFrame:
    """The known shapes with first and last sighting after a run; the first run makes the baseline."""
    fresh = now.select("kind", "owner", "name", F.lit(seen_at).alias("detected"), F.lit(seen_at).alias("last_seen"))
    return baseline.unionByName(fresh).groupBy("kind", "owner", "name").agg(F.min("detected").alias("detected"), F.max("last_seen").alias("last_seen"))
