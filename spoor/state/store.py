"""Versioned tables that batches change as a whole or not at all.

A store is a folder that all executors share. A transaction writes the rows that a batch adds, replaces or deletes to new folders, by bucket; nothing
refers to them until commit() puts one small file with the next version's number beside the earlier ones, by a rename that fails if that version exists. So a
batch that is lost midway leaves only folders that nobody reads, and is simply run again; one that was committed is known by its
number and changes nothing when it is run again. Readers take the last version and are not disturbed by later ones.

Tables are read by merging: the last version of a key counts. After MOST_DELTAS commits compact() writes one folder again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_DELTAS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a local session (tests) gets a new one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: what is used several times is computed once, and lost executors compute nothing of it again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Table(NamedTuple):
    schema: str
    key: tuple[str, ...]
    #: Key columns whose hash chooses the bucket: a batch reads only the buckets of the values that it has.
    spread: tuple[str, ...]
    #: Rows are only added, never under a key that is there.
    grows: bool = False


class Store:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.folder, self.tables, self.buckets = spark, folder.rstrip("/"), tables, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> dict:
        path, files = self._path("commits")
        names = sorted(f.getPath().getName() for f in files.listStatus(path) if not f.getPath().getName().startswith((".", "_"))) if files.exists(path) else []
        if not names:
            return {"version": 0, "tables": {name: [] for name in self.tables}, "batches": {}}
        stream = files.open(self._path(f"commits/{names[-1]}")[0])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        return self._last()["version"]

    def bucket_of(self, name: str):
        return F.pmod(F.xxhash64(*self.tables[name].spread), F.lit(self.buckets)).cast("int")

    def buckets_in(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of the rows' spread columns, at most all of them."""
        return [r[0] for r in rows.select(self.bucket_of(name)).distinct().collect()]

    def _folders(self, name: str, folders: list[str], buckets: list[int] | None) -> DataFrame:
        table = self.tables[name]
        schema = StructType.fromDDL(f"{table.schema}, deleted boolean, version long, bucket int")
        found = None
        for folder in folders:
            one = self.spark.read.schema(schema).parquet(f"{self.folder}/{folder}")
            one = one if buckets is None else one.where(F.col("bucket").isin(buckets))
            found = one if found is None else found.unionByName(one)
        return self.spark.createDataFrame([], schema) if found is None else found

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version, or of some of its buckets."""
        return self._merged(name, self._last()["tables"][name], buckets)

    def _merged(self, name: str, folders: list[str], buckets: list[int] | None = None) -> DataFrame:
        table, rows = self.tables[name], self._folders(name, folders, buckets)
        columns = StructType.fromDDL(table.schema).names
        if not table.grows and len(folders) > 1:
            rows = rows.groupBy(*table.key).agg(F.max_by(F.struct(*(c for c in columns if c not in table.key), "deleted"), "version").alias("v")).select(*table.key, "v.*")
        return rows.where("not deleted").select(*columns)

    def begin(self, batch: int, source: str = "main") -> Transaction | None:
        """A transaction for a source's batch, or None if that batch (or a later one) is in the store."""
        last = self._last()
        return None if last["batches"].get(source, -1) >= batch else Transaction(self, last, source, batch)

    def compact(self) -> None:
        """One folder a table again; what transactions in progress read stays in place."""
        last = self._last()
        change = Transaction(self, last, None, 0)
        for name, folders in last["tables"].items():
            if len(folders) > 1:
                change.replaced[name] = [change._write(name, self._merged(name, folders).withColumn("deleted", F.lit(False)))]
        change.commit()

    def vacuum(self) -> int:
        """Delete the folders and commits that the last version does not use. Only where no transaction or older reader is at work."""
        last, gone = self._last(), 0
        used = {f for folders in last["tables"].values() for f in folders}
        for name in (*self.tables, "scratch"):
            path, files = self._path(name)
            for f in files.listStatus(path) if files.exists(path) else []:
                if f"{name}/{f.getPath().getName()}" not in used:
                    gone += files.delete(f.getPath(), True)
        path, files = self._path("commits")
        for f in files.listStatus(path) if files.exists(path) else []:
            if f.getPath().getName() != f"{last['version']:020d}":
                files.delete(f.getPath(), True)
        return gone


class Transaction:
    """Changes of one batch; put() and scratch() write at once, commit() makes them count."""

    def __init__(self, store: Store, last: dict, source: str | None, batch: int):
        self.store, self.last, self.source, self.batch = store, last, source, batch
        self.added: dict[str, list[str]] = {}
        self.replaced: dict[str, list[str]] = {}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows before this transaction."""
        return self.store._merged(name, self.last["tables"][name], buckets)

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        placed = rows.withColumn("version", F.lit(self.last["version"] + 1).cast("long")).withColumn("bucket", self.store.bucket_of(name))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.store.folder}/{folder}")  # large buckets go to several tasks
        return folder

    def put(self, name: str, rows: DataFrame, *, deleted: bool = False) -> DataFrame:
        """Add or replace rows by their key, or delete those of such keys (other columns may be missing then); what was written, read back."""
        schema = StructType.fromDDL(self.store.tables[name].schema)
        columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        folder = self._write(name, rows.select(*columns, F.lit(deleted).alias("deleted")))
        self.added.setdefault(name, []).append(folder)
        return self.store._folders(name, [folder], None).select(*schema.names)

    def scratch(self, rows: DataFrame) -> DataFrame:
        """Rows that only this transaction needs, written once."""
        folder = f"{self.store.folder}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.store.spark.read.schema(rows.schema).parquet(folder)

    def commit(self) -> int:
        version = self.last["version"] + 1
        tables = {name: self.replaced.get(name, self.last["tables"].get(name, [])) + self.added.get(name, []) for name in self.store.tables}
        batches = self.last["batches"] | ({self.source: self.batch} if self.source is not None else {})
        jvm = self.store.spark._jvm
        temp, files = self.store._path(f"commits/.{uuid.uuid4().hex}")
        out = files.create(temp, False)
        out.write(bytearray(json.dumps({"version": version, "tables": tables, "batches": batches}), "utf-8"))
        out.close()
        target = self.store._path(f"commits/{version:020d}")[0]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.store.spark._jsc.hadoopConfiguration())
        none = self.store.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(temp, target, none)  # fails if another transaction took this version
        return version
