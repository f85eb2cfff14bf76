"""Registered queries for documents, timelines, ceilings, indexed vectors and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.operators import answers, dashboards, reports, retrieval
from spoor.sources import evidence as files
from spoor.state.store import new_folder, written
from spoor.state.vector_index import VectorIndex

from .case_queries import _FLAGS, parsed
from .fixtures import evidence, executions, view
from .queries import _AT, _EX, query
from .state_queries import _THREADS


@query("WITH q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, v.vec_id, list_distance(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS distance FROM embeddings v JOIN q ON q.label = v.label WHERE v.vec_id % 3 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(1 / (1 + distance), 4) AS score FROM r WHERE rank <= 10")
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of the query's own label that a filter leaves, and their scores."""
    vectors = view(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, new_folder(spark, "vectors"))
    index.build(vectors, cells=32)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return index.search(queries, 10, where=F.col("vec_id") % 3 > 0, match="label").select("query_id", "rank", "vec_id", "score")


@query(f"WITH {_AT} SELECT id, investigation_id FROM att WHERE pid = '7' UNION ALL SELECT id, investigation_id FROM att WHERE investigation_id = 'INV-3' AND id IN (3, 10, 17, 24, 31) UNION ALL (SELECT id, investigation_id FROM att WHERE investigation_id = 'INV-2' AND id > 50 ORDER BY id LIMIT 20)")
def clustered_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By process id, by ids, and a page, from evidence that is written in their order."""
    folder = new_folder(spark, "clustered")
    files.write_clustered(evidence(spark, sf_dir), folder)
    rows = spark.read.parquet(folder)
    found = files.lookup_pid(rows, "7").select("id", "investigation_id").unionByName(files.lookup_ids(rows, "INV-3", [3, 10, 17, 24, 31]).select("id", "investigation_id"))
    return found.unionByName(files.page_of(rows, "INV-2", 50, 20).select("id", "investigation_id"))


_PAIRS = ", ".join(f"'{name}: ' || {column}" for name, column in (("pid", "pid"), ("process", "process"), ("protection", "prot"), ("privatememory", "priv"), ("name", "name"), ("path", "path"), ("cmd", "cmd"), ("remote_ip", "rip"), ("remote_port", "rport"), ("local_port", "lport"), ("state", "st"), ("granted_access", "ga"), ("key", "key")))


@query(f"WITH {_AT}, d AS (SELECT *, {_FLAGS} AS f FROM att) SELECT id, concat_ws(chr(10), 'plugin: ' || plugin, 'type: ' || artifact_type, 'risk: ' || risk_level, CASE WHEN f <> '' THEN 'flags: ' || replace(f, ',', ', ') END, {_PAIRS}, CASE WHEN artifact_type = 'malfind' THEN CASE priv WHEN '1' THEN 'region: PRIVATE-COMMITTED' ELSE 'region: MAPPED' END END) AS document FROM d")
def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.to_match(parsed(spark, sf_dir), F.col("attributes")).select("id", "document")


@query(f"WITH {_AT}, n AS (SELECT investigation_id, id, row_number() OVER (PARTITION BY investigation_id ORDER BY id) AS rank FROM att WHERE artifact_type = 'handles' AND id % 7 = 5) SELECT investigation_id, id, CAST(rank AS INT) AS rank FROM n WHERE rank <= 12")
def fetch_tid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(evidence(spark, sf_dir).withColumn("artifact_value", F.expr(_THREADS)), "threads")
    return retrieval.fetch_tid(rows, "5", 12).select("investigation_id", "id", "rank")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey % 5 = 2")
def reports_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("INV-"), (F.col("o_custkey") % 5).cast("string")).alias("investigation_id"))
    return retrieval.reports(made, "INV-2").select("id", "created_at")


_DONE_EVENTS = f"WITH {_AT}, {_EX}, t AS (SELECT a.investigation_id, created_at AS ts, CASE artifact_type WHEN 'pslist' THEN 'process started: ' || name || ' (PID ' || pid || ', PPID None)' ELSE 'connection TCP None:' || lport || ' -> ' || rip || ':' || rport || ' [' || st || '] (PID ' || pid || ')' END AS description, plugin, a.id FROM att a JOIN ex ON ex.id = a.execution_id WHERE artifact_type IN ('pslist', 'netscan') AND execution_status = 'completed')"


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated process starts and connections of completed executions, whose attributes carry their times and peers as those plugins name them."""
    rows = written(parsed(spark, sf_dir).where("artifact_type in ('pslist', 'netscan')"), "events")
    a = F.col("attributes")
    time = F.col("created_at").cast("string")
    more = F.when(F.col("artifact_type") == "pslist", F.create_map(F.lit("createtime"), time, F.lit("imagefilename"), A.first_key(a, "name"))).otherwise(
        F.create_map(F.lit("created"), time, F.lit("proto"), F.lit("TCP"), F.lit("localport"), A.first_key(a, "local_port"), F.lit("foreignaddr"), A.first_key(a, "remote_ip"), F.lit("foreignport"), A.first_key(a, "remote_port"))
    )
    return dashboards.timeline_events(reports.scope(rows.withColumn("attributes", F.map_concat(a, more)), executions(spark, sf_dir)), F.col("attributes"))


@query(f"{_DONE_EVENTS} SELECT * FROM t")
def timeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query(f"{_DONE_EVENTS} SELECT * FROM ((SELECT * FROM t ORDER BY ts, description, id LIMIT 20) UNION (SELECT * FROM t ORDER BY ts DESC, description DESC, id DESC LIMIT 20)) u")
def timeline_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last events of all."""
    return reports.timeline_ends(_timeline(spark, sf_dir), 40)


@query(f"WITH {_AT}, c AS (SELECT investigation_id || '-' || process AS question_id, count(*) AS n, CASE WHEN count(*) FILTER (priv = '0') > 0 AND count(*) FILTER (priv = '1') = 0 THEN 40 END AS region, CASE WHEN bool_and(CAST(pid AS INT) % 2 = 0) THEN 25 WHEN bool_or(CAST(pid AS INT) % 2 = 0) THEN 50 END AS signatures FROM att WHERE artifact_type = 'malfind' GROUP BY 1) SELECT question_id, CAST(least(n % 100, coalesce(region, 100), coalesce(signatures, 100)) AS INT) AS confidence FROM c")
def final_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence under the ceilings of injected regions and of signatures together."""
    a = F.col("attributes")
    rows = parsed(spark, sf_dir).where("artifact_type = 'malfind'").withColumn("question_id", F.concat_ws("-", "investigation_id", A.first_key(a, "process")))
    region = answers.malfind_ceiling(rows, A.region_kind(F.col("artifact_type"), a))
    alone = A.first_key(a, "pid").cast("int") % 2 == 0
    other = rows.groupBy("question_id").agg((F.count(F.lit(1)) % 100).cast("int").alias("said"), F.when(F.bool_and(alone), 25).when(F.bool_or(alone), 50).alias("signatures"))
    return other.join(region, "question_id").select("question_id", answers.apply_ceilings(F.col("said"), F.col("ceiling"), F.col("signatures")).alias("confidence"))
