"""Token counts of documents in flat token files that have no index.

A flat file holds the ids of document after document, each closed by an
end-of-document id, and nothing else. It is cut into blocks that are searched for
separators independently, each with one vectorised comparison; a prefix scan over the
blocks' summaries (separators so far, position of the last one) then stitches the
documents that cross blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import shared_dir, stored, text_of
from .tokens import encoder

#: Bytes of a block, and blocks that one task searches where there are many.
BLOCK, BLOCKS_A_TASK = 4 << 20, 16


def write_flat(docs: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write one flat file of little-endian 16-bit ids per input split to a new shared folder.

    Returns the folder and (file, ordinal, id): which document stands where. A task that
    is run again writes another file; only files of committed tasks are named. The
    separator is the first id after the vocabulary.
    """
    folder = shared_dir(docs.sparkSession, "flat-tokens")
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))

    def run(batches):
        encode = encoder(*tokenizer)
        if encode.size >= 1 << 16:
            raise ValueError("16-bit ids hold vocabularies below 65536")
        task = TaskContext.get()
        name, sink, ordinal = f"tokens-{task.partitionId()}-{task.taskAttemptId()}.bin", None, 0
        end = np.uint16(encode.size)
        for batch in batches:
            if not len(batch):
                continue
            sink = sink or files.create(folder, name)
            for text in batch.column(1).to_pylist():
                sink.write(np.append(encode.encode(text).astype("<u2"), end).astype("<u2").tobytes())
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], names=["file", "ordinal", id_col])
            ordinal += n
        if sink:
            sink.close()

    schema = f"file string, ordinal long, `{id_col}` {rows.schema[id_col].dataType.simpleString()}"
    return folder, stored(rows.mapInArrow(run, schema), "token-files")


def scan_flat(names: DataFrame, folder: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat files named in column `file`.

    n_tokens leaves the separator out. Tokens after a file's last separator are a
    document too; an empty file has none.
    """

    def split(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                total = files.size(folder, name)
                at = np.arange(0, total, block)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(at), pa.array(np.minimum(at + block, total))], names=["file", "block", "lo", "hi"])

    def search(batches):
        for batch in batches:
            out = []
            for name, number, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                with files.reader(folder, name) as source:
                    ids = np.frombuffer(source.read_at(hi - lo, lo), "<u2")
                ends = np.flatnonzero(ids == end_id) + lo // 2
                out.append((name, number, len(ends), int(ends[-1]) if len(ends) else None, hi // 2, ends.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["file", "block", "n", "last", "hi", "ends"])

    if block % 2:
        raise ValueError("blocks hold whole ids")
    blocks = stored(names.select("file").distinct().mapInArrow(split, "file string, block long, lo long, hi long"), "blocks")
    n = blocks.count()
    tasks = max(1, min(n, max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCKS_A_TASK))))  # a number of its own, as adaptive execution would merge these few rows
    found = stored(blocks.repartitionByRange(tasks, "file", "block").mapInArrow(search, "file string, block long, n long, last long, hi long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    stitched = found.join(carried, ["file", "block"])
    ends = F.col("ends")
    lengths = F.transform(ends, lambda e, i: e - F.when(i == 0, F.col("previous")).otherwise(F.get(ends, i - 1)) - 1)
    closed = stitched.select("file", "ordinal", F.posexplode(lengths).alias("_i", "n_tokens")).select("file", (F.col("ordinal") + F.col("_i")).alias("ordinal"), "n_tokens")
    rest = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.max("hi") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_tokens) per row, by writing flat files and scanning them.

    Null and empty texts have 0 tokens; repeated ids and rows are documents of their
    own; an empty table gives no rows.
    """
    folder, where = write_flat(docs, tokenizer, id_col, text_col)
    counts = scan_flat(where, folder, encoder(*tokenizer).size, block)
    return where.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")
