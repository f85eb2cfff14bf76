"""Exact deduplication of a stream of files with disk-backed state that never expires.

Each micro-batch of the file stream goes through three steps, all restartable:

1. Its rows' identifier, digest and content locator (file and row within it) are written to seen/; texts are not.
2. A stateful query over seen/, with RocksDB state and no watermark, keeps for each digest the number of its rows, the stable identifier (the largest so
   far, with its locator) and the locator of the content that came first. Rows of one digest are combined before they are shuffled, so a text that
   a third of all rows repeat is one row a task. The digests that a batch changed go to classes/.
3. Digests with a hit, more than one row, are checked by their full bytes: the batch's texts of such digests and the content at
   the locators of earlier batches are grouped by (digest, text), once more combined before the shuffle. Digests with
   unlike texts go to unlike/, and their rows are told apart by their whole texts.

A null text is empty. Rows that repeat an identifier are rows of their own; of those that share the largest the one with the last locator stays. A null
identifier is less than all others. Other columns are not read. A folder that is deduplicated again after files were added goes on from its state.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, scope, small

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a run ends after its batch: executors need not hold a database for each partition, of at least 4 MB
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
_SEEN = "id long, digest string, file string, row long, batch long"
_CLASSES = "digest string, n long, keep struct<id:bigint,file:string,row:bigint>, first struct<batch:bigint,file:string,row:bigint>"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _complete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _located(df: DataFrame, identifier: str, content: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, text, digest, file, row) of a table read from Parquet files."""
    where = df.metadataColumn("_metadata")
    text = F.coalesce(df[content], F.lit(""))
    return df.select(df[identifier].cast("long").alias("id"), text.alias("text"), digest(text).alias("digest"), where["file_path"].alias("file"), where["row_index"].alias("row"))


class Deduplicator:
    """The state of one stream under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, *, identifier: str = "doc_id", content: str = "text", digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder, digest
        self.identifier, self.content = identifier, content

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def run(self, path: str, *, most_bytes: int = 64 << 30) -> None:
        """Take in the Parquet files of path (a folder, or a glob) that have not been taken in, so many bytes a micro-batch."""
        schema = self.spark.read.parquet(path).select(self.identifier, self.content).schema
        stream = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", str(most_bytes)).parquet(path)
        rows = _located(stream, self.identifier, self.content, self.digest)
        rows.writeStream.option("checkpointLocation", f"{self.folder}/intake").foreachBatch(self._take).trigger(availableNow=True).start().awaitTermination()

    def _take(self, batch: DataFrame, k: int) -> None:
        seen = f"{self.folder}/seen/b{k}"
        if not _complete(self.spark, seen):  # a batch that is repeated after its rows were written must not count them twice
            batch.select("id", "digest", "file", "row", F.lit(k).cast("long").alias("batch")).write.mode("overwrite").parquet(seen)
        self._absorb(k)
        hits = self.spark.read.schema(_CLASSES).parquet(f"{self.folder}/classes/b{k}").where("n > 1")
        self._check(batch, hits, k)

    def _absorb(self, k: int) -> None:
        """Bring the state up to date with seen/; classes/ gets the digests that changed."""
        before = {name: self.spark.conf.get(name, None) for name in _ROCKSDB}
        try:
            for name, value in _ROCKSDB.items():
                self.spark.conf.set(name, value)
            rows = self.spark.readStream.schema(_SEEN).parquet(f"{self.folder}/seen/*")
            state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"), F.min(F.struct("batch", "file", "row")).alias("first"))
            put = lambda changed, _: changed.write.mode("overwrite").parquet(f"{self.folder}/classes/b{k}")
            state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def _content(self, locators: DataFrame) -> DataFrame:
        """(digest, text, id, file, row) of locators(digest, file, row): only the files named are read."""
        files = [unquote(r.file) for r in locators.select("file").distinct().toLocalIterator()]
        if not files:
            return self.spark.createDataFrame([], "digest string, text string, id long, file string, row long")
        rows = _located(self.spark.read.parquet(*files), self.identifier, self.content, self.digest).drop("digest")
        return rows.join(small(locators), ["file", "row"]).select("digest", "text", "id", "file", "row")

    def _check(self, batch: DataFrame, hits: DataFrame, k: int) -> None:
        """The digests of hits whose texts differ, by full bytes."""
        earlier = hits.where(F.col("first.batch") < k).select("digest", "first.file", "first.row")
        new = batch.select("digest", "text").join(small(hits.select("digest")), "digest", "left_semi")
        texts = new.unionByName(self._content(earlier).select("digest", "text"))
        unlike = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
        unlike.select("digest").write.mode("overwrite").parquet(f"{self.folder}/unlike/b{k}")

    def classes(self) -> DataFrame:
        """(id, digest, keep_id, group_size, kept, file, row): a row for each row taken in."""
        rows = self._read("seen", _SEEN)
        with scope(self.spark):
            copies = self._read("classes", _CLASSES).where("n > 1").groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("c"))
            copies = materialize(copies.select("digest", F.col("c.n").alias("group_size"), F.col("c.keep").alias("keep")), "copies", keep=True)
            unlike = materialize(self._read("unlike", "digest string").distinct(), "unlike", keep=True)
        split = None
        if unlike.limit(1).count():
            apart = materialize(rows.join(small(unlike), "digest", "left_semi").select("digest", "file", "row"), "unlike-rows", keep=True)
            texts = self._content(apart)
            each = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "file", "row")).alias("keep"))
            split = texts.join(each, ["digest", "text"]).select("id", "digest", "file", "row", "group_size", "keep")
            rows = rows.join(small(unlike), "digest", "left_anti")
        alone = F.struct("id", "file", "row")
        found = rows.join(small(copies), "digest", "left").select("id", "digest", "file", "row", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("keep", alone).alias("keep"))
        found = found if split is None else found.unionByName(split)
        kept = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
        return found.select("id", "digest", F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), "file", "row")
