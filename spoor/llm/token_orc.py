"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on doc_id.

Documents are range-partitioned and sorted by doc_id before they are encoded, so file and stripe
statistics of doc_id are narrow and a read of some ids skips most stripes; stripes are
read in parallel. Each row also holds its place within its file's part, so that the global position of
a document is its part's base (a running sum over parts, one row each) plus that.

A document is its ids and an end id. Null and empty texts are their end id. Repeated doc_ids stay as
rows of their own, in order of their texts' hashes; null doc_ids come first. Other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, stripe_bytes: int = 16 << 20, index_stride: int = 1000, codec: str = "zstd") -> None:
    """Encode docs(doc_id, text) and write them in ascending doc_id order to path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                own = batch.slice(lo, 1000)
                ids = [encode(t.as_py()) + end for t in own.column(1)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(before + ends[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_stride), "orc.create.index": "true", "compression": codec}
    rows.mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with doc_ids only those documents, by stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, all from the files."""
    rows = read(spark, path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per part
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            cuts = np.asarray(ids.offsets)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cuts[1:].astype(np.int64) - cuts[:-1]), pa.array(sums, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    each = rows.select("doc_id", "part", "before", "ids").mapInArrow(crc, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return each.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
