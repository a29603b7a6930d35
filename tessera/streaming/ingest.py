"""Incremental ingest: new Parquet files of a source become ranked assertion rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import Run, assemble
from ..operators.untangle import untangle
from ..plans.preset import Preset


def ingest(spark: SparkSession, folder: str, schema, preset: Preset, output: str, checkpoint: str, run: Run | None = None, line: str = "_line", resolution_us: int = 1_000_000) -> StreamingQuery:
    """Process the files that are there and not yet processed, then stop.

    Each batch is assembled and ranked on its own and lands in a folder of its number,
    which is overwritten if the batch is run again.
    """
    source = spark.readStream.schema(schema).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        ranked = untangle(assemble(rows, preset, run, line=line), resolution_us)
        ranked.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
