"""Shared plumbing: tables, the cluster's shared folder, hash keys."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder of the cluster.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests
    on one machine) a temporary folder takes its place for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    for made in _made[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables stored within go at the end, but for the last: what is needed after must not read any other."""
    _made.append([])
    try:
        yield
    finally:
        made = _made.pop()
        for path in made[:-1]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs within passes at most `rows` rows at once to Python, however many the session allows; only memory depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never a local one)."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        shared_dir(df.sparkSession, "unused")
        if not df.sparkSession.sparkContext.getCheckpointDir():
            df.sparkSession.sparkContext.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{base}{i or ''}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def kept_rows(df: DataFrame, run) -> DataFrame:
    """Those rows that `run` leaves of Arrow batches; columns come in order and may have any names."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def text_of(col: str | Column = "text") -> Column:
    """A text with null read as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit identity of a whole text."""
    return F.unhex(F.md5(text.cast("binary")))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
