"""Dump of nested XML reports: every model, with its source, as one table per level and type."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sources import readers, sinks
from ..sources.catalog import Entry, discover
from .drift import drift, upsert_baseline
from .lookup import with_source
from .nested import field_order, of_types

RECORD = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("model_type", T.StringType()), T.StructField("top_type", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("parent_type", T.StringType()),
    T.StructField("deleted_state", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
])
SOURCE_COLUMNS = ["path", "name", "table_name", "offset", "size"]
LEVELS = 3


def records(models):
    """Models depth first, three levels deep, with their own fields."""
    seq = 0

    def walk(model, level, top, parent, parent_type):
        nonlocal seq
        kind = model.get("type")
        yield (seq, level, kind, top, model.get("id"), parent, parent_type, model.get("deleted_state"), readers.model_fields(model))
        seq += 1
        if level + 1 < LEVELS:
            for f in model:
                if f.tag.rpartition("}")[2] in ("modelField", "multiModelField"):
                    for inner in f:
                        if inner.tag.rpartition("}")[2] == "model":
                            yield from walk(inner, level + 1, top, model.get("id"), kind)

    for model in models:
        yield from walk(model, 0, model.get("type"), None, None)


def model_types(entry: Entry) -> list[str]:
    """Types of top-level models, in order of first appearance, by the index of blocks."""
    return list(dict.fromkeys(kind for kind, _, _ in readers.block_index(entry)[1] if kind))


class _Block(InputPartition):
    def __init__(self, number: int, first: int, end: int | None):
        self.number, self.first, self.end = number, first, end


class ReportRecords(DataSource):
    """Format `tessera_report`: a report's models, a partition for each block of them; what lies between is not parsed."""

    @classmethod
    def name(cls):
        return "tessera_report"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _ReportReader(self.options)


class _ReportReader(DataSourceReader):
    def __init__(self, options):
        import base64
        import pickle

        self.entry, self.head, self.blocks = pickle.loads(base64.b64decode(options["plan"]))  # noqa: S301  made by read_report

    def partitions(self):
        return [_Block(i, first, end) for i, (_, first, end) in enumerate(self.blocks)]

    def read(self, partition):
        models = readers.block_models(self.entry, self.head, partition.first, partition.end) if self.head else readers.report_models(self.entry)
        for seq, *rest in records(models):
            yield (partition.number << 40 | seq, *rest)


def read_report(spark: SparkSession, entry: Entry, types: list[str] | None = None) -> DataFrame:
    """All models, or those of the given top-level types with everything below them; blocks are parsed side by side."""
    import base64
    import pickle

    spark.dataSource.register(ReportRecords)
    head, blocks, _ = readers.block_index(entry)
    plan = (entry, head, [b for b in blocks if types is None or b[0] is None or b[0] in types]) if blocks else (entry, b"", [(None, 0, None)])
    rows = spark.read.format("tessera_report").option("plan", base64.b64encode(pickle.dumps(plan)).decode()).load()
    return rows if types is None else of_types(rows, types)


read_sources = readers.read_sources


def open_report(path: str | Path) -> Entry:
    """A report, plain or as report.xml in an archive."""
    catalog = discover(path, 1)
    found = [e for e in catalog if e.name.lower() == "report.xml"] or [e for e in catalog if e.name.lower().endswith(".xml")] or catalog.entries
    return found[0]


def shape(rows: DataFrame) -> DataFrame:
    """(kind, owner, name): types per level, which holds which, fields per type."""
    level = F.concat(F.lit("level "), F.col("level").cast("string"))
    types = rows.select(F.lit("type").alias("kind"), level.alias("owner"), F.col("model_type").alias("name"))
    held = rows.where(F.col("parent_type").isNotNull()).select(F.lit("relation").alias("kind"), F.col("parent_type").alias("owner"), F.col("model_type").alias("name"))
    fields = rows.select(F.lit("field").alias("kind"), F.col("model_type").alias("owner"), F.explode(F.map_keys("fields")).alias("name"))
    return types.unionByName(held).unionByName(fields).distinct()


def dump(spark: SparkSession, path: str | Path, output: str | Path, types: list[str] | None = None) -> dict[str, int]:
    """Write a CSV (with byte-order mark) per level and type: ids, fields in order of first sight, and the source; row counts by file."""
    entry = open_report(path)
    rows = with_source(read_report(spark, entry, types), read_sources(spark, entry), "id", "id", ["seq"], SOURCE_COLUMNS).persist()
    out: dict[str, int] = {}
    Path(output).mkdir(parents=True, exist_ok=True)
    try:
        for kind in sorted(field_order(rows, ["level", "model_type"], "fields", "seq").unionByName(rows.select("level", "model_type").distinct().withColumn("names", F.lit(None).cast("array<string>"))).groupBy("level", "model_type").agg(F.max("names").alias("names")).collect(), key=lambda r: (r["level"], r["model_type"])):
            own = rows.where((F.col("level") == kind["level"]) & (F.col("model_type") == kind["model_type"]))
            ids = [F.col("id").alias("uuid")] if kind["level"] == 0 else [F.col("id").alias("sub-uuid"), F.col("parent_id").alias("main-uuid")]
            names = kind["names"] or []
            table = own.orderBy("seq").select(*ids, *[F.try_element_at("fields", F.lit(n)).alias(f"_{i}") for i, n in enumerate(names)], *[F.col(c).alias(f"source_{c}") for c in SOURCE_COLUMNS])
            header = [*table.columns[: len(ids)], *names, *table.columns[len(ids) + len(names) :]]  # names may differ in case alone
            name = f"{kind['level']}_{sinks.safe_file_name(kind['model_type'], set())}.csv"
            out[name] = sinks.write_csv(table, Path(output) / name, True, header)
    finally:
        rows.unpersist()
    return out


def check_drift(now: DataFrame, baseline: DataFrame | None, seen_at: str) -> tuple[DataFrame | None, DataFrame]:
    """(changes, the new baseline); the first run makes a baseline and reports nothing."""
    if baseline is None:
        return None, upsert_baseline(now.sparkSession.createDataFrame([], "kind string, owner string, name string, detected string, last_seen string"), now, seen_at)
    return drift(now, baseline.select("kind", "owner", "name")), upsert_baseline(baseline, now, seen_at)
