"""Reading and writing evidence: plugin output files, normalisation, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.attributes import first_key, normalize_pid, with_attributes

from .split_json import read_arrays


def read_plugin_output(spark: SparkSession, path: str, plugin: str) -> DataFrame:
    """(plugin, row): the objects of JSON-array files of any size as text. A file that is no JSON array gives nothing; elements that are no objects are dropped."""
    rows, _ = read_arrays(spark, [path])
    return rows.select(F.lit(plugin).alias("plugin"), "row")


def normalize_evidence(df: DataFrame) -> DataFrame:
    """artifact_type: the plugin's name after its last dot. attributes: the row's keys, lower-cased (the later of clashing keys wins), with their values as text; null for a row without
    any. Classification and retrieval read those instead of parsing the row again."""
    return with_attributes(df.withColumn("artifact_type", F.element_at(F.split("plugin", r"\."), -1)).withColumnRenamed("row", "artifact_value"))


def write_evidence(df: DataFrame, path: str, truncate_at: int | None = None) -> None:
    value = F.col("artifact_value") if truncate_at is None else F.left("artifact_value", F.lit(truncate_at))
    df.withColumn("artifact_value", value).withColumn("confidence_score", F.lit(100)).write.mode("append").partitionBy("artifact_type").parquet(path)


def dedup_evidence(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["execution_id", "artifact_value"])


def load_indicator_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(file, name, source, cidr), a row for each address or range of the folder's *.json sets; cidr as networks.match_networks takes it.
    Files that are no JSON objects, sets without ranges and empty entries give nothing; a set's name is its file's stem and its source the file's name where it gives none."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "name string, source string, networks array<string>").alias("set"))
    given = lambda c, other: F.when(F.coalesce(F.col(f"set.{c}"), F.lit("")) == "", other).otherwise(F.col(f"set.{c}")).alias(c)
    rows = files.select("file", given("name", F.regexp_replace("file", r"\.json$", "")), given("source", F.col("file")), F.explode("set.networks").alias("cidr"))
    return rows.select("file", "name", "source", F.trim("cidr").alias("cidr")).where("cidr <> ''")


def write_clustered(df: DataFrame, path: str, row_group_bytes: int = 16 << 20) -> None:
    """Evidence in the order of (investigation_id, id), with pid, the row's process id (P3), and Parquet Bloom filters on it: lookups by investigation and id skip files and row groups
    by their ranges, lookups by process id by the filters. Rows without attributes or pid have a null pid."""
    rows = df if "attributes" in df.columns else with_attributes(df)
    rows = rows.withColumn("pid", normalize_pid(first_key(F.col("attributes"), "pid", "processid")))
    ranged = rows.repartitionByRange(F.col("investigation_id"), F.col("id")).sortWithinPartitions("investigation_id", "id")
    ranged.write.option("parquet.bloom.filter.enabled#pid", "true").option("parquet.bloom.filter.expected.ndv#pid", "100000").option("parquet.block.size", str(row_group_bytes)).parquet(path)


def lookup_pid(clustered: DataFrame, pid: str) -> DataFrame:
    """The rows of that process id in evidence that write_clustered wrote; the comparison reaches the Bloom filters."""
    return clustered.where(F.col("pid") == pid)


def lookup_ids(clustered: DataFrame, investigation: str, ids: list[int]) -> DataFrame:
    return clustered.where((F.col("investigation_id") == investigation) & F.col("id").isin(ids))


def page_of(clustered: DataFrame, investigation: str, after: int, size: int) -> DataFrame:
    """The investigation's next rows by id."""
    return clustered.where((F.col("investigation_id") == investigation) & (F.col("id") > after)).orderBy("id").limit(size)
