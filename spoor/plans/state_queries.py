"""Registered queries over kept state: batch classification, text and document indexes, streaming progress, routed retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.operators import classify, dashboards, dispatch, lookup
from spoor.operators.fixed_catalogues import PRODUCTS, ROUTES
from spoor.sources.evidence import normalize_evidence
from spoor.sources.split_json import read_arrays
from spoor.state.document_index import DocumentIndex
from spoor.state.entity_index import EntityIndex
from spoor.state.store import new_folder
from spoor.state.text_index import TextIndex
from spoor.streaming.ingest import stream_progress

from .case_queries import _ASKERS, _GENERAL, parsed
from .fixtures import evidence, executions, view
from .queries import _AT, _CLASSIFY, _EV, _EX, query

#: Three batches of evidence: most rows, then two smaller ones that meet what is there.
BATCHES = ("id % 10 < 7", "id % 10 in (7, 8)", "id % 10 = 9")


def _classified(spark: SparkSession, sf_dir: str, batches: tuple[str, ...]) -> tuple[EntityIndex, list[DataFrame]]:
    index, rows = EntityIndex(spark, new_folder(spark, "entities"), buckets=16), evidence(spark, sf_dir)
    return index, [index.classify(rows.where(b), i) for i, b in enumerate(batches)]


@query(_CLASSIFY)
def classify_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _classified(spark, sf_dir, BATCHES)
    return index.classified().select("id", "severity", "score", F.array_join("indicators", ",").alias("indicators"), "corroborated", F.array_join("families", ",").alias("families"))


def _up_to(condition: str) -> str:
    return _CLASSIFY.replace("FROM events)", f"FROM events WHERE {condition.replace('id %', 'event_id %')})")


@query(f"SELECT now.id, now.severity, now.score, now.families, was.id IS NULL AS new FROM ({_up_to('id % 10 < 9')}) now LEFT JOIN ({_up_to(BATCHES[0])}) was ON was.id = now.id WHERE was.id IS NULL OR was.families <> now.families")
def changed_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second batch changes: its own rows, and earlier ones whose entities it gives a new family."""
    _, changed = _classified(spark, sf_dir, BATCHES[:2])
    return changed[1].select("id", "severity", "score", F.array_join("families", ",").alias("families"), F.expr(BATCHES[1]).alias("new"))


_CLASHING = "'{\"PID\": ' || CAST(event_id AS STRING) || ', \"Name\": \"A' || CAST(user_id AS STRING) || '\", \"pid\": ' || CASE event_id % 3 WHEN 0 THEN 'null' ELSE CAST(user_id AS STRING) END || CASE event_id % 2 WHEN 0 THEN ', \"NAME\": {\"x\": [1, \"B\"]}}' ELSE '}' END"


@query("SELECT event_id AS id, 'pslist' AS artifact_type, CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS STRING) END AS pid, CASE event_id % 2 WHEN 0 THEN '{\"x\":[1,\"B\"]}' ELSE 'A' || CAST(user_id AS STRING) END AS name FROM events")
def normalized_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that clash but for case: the later counts, even if it is null."""
    rows = view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("windows.pslist").alias("plugin"), F.expr(_CLASHING).alias("row"))
    found = normalize_evidence(rows)
    return found.select("id", "artifact_type", A.first_key(F.col("attributes"), "pid").alias("pid"), A.first_key(F.col("attributes"), "name").alias("name"))


_TOKENS = "SELECT DISTINCT lower(substr(artifact_value, CAST(id % 7 AS INT) + 3, CAST(id % 5 AS INT) * 3 + 2)) AS token FROM ev WHERE id % 40 = 0"


@query(f"WITH {_EV}, t AS ({_TOKENS}) SELECT ev.id, t.token FROM ev JOIN t ON contains(lower(artifact_value), t.token)")
def find_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold one of many substrings, of two characters up."""
    rows = evidence(spark, sf_dir).select("investigation_id", "id", F.col("artifact_value").alias("text"))
    tokens = spark.sql(_TOKENS.replace("FROM ev", "FROM {ev}"), ev=evidence(spark, sf_dir))
    index = TextIndex(spark, new_folder(spark, "grams"), buckets=16)
    for i, part in enumerate(("id % 2 = 0", "id IS NULL OR id % 2 <> 0")):
        index.add(rows.where(part), i)
    return index.find(tokens, rows).select("id", "token")


@query("SELECT 'ev-' || CAST(doc_id AS STRING) AS document_id, 'INV-' || CAST(doc_id % 5 AS STRING) AS investigation_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 5 <> 4 AND doc_id % 5 <> 3 OR doc_id % 5 = 3 AND doc_id % 11 <> 0")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed with old texts, brought up to date (in one investigation rows have gone), repeated, and one investigation removed."""
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("INV-"), (F.col("doc_id") % 5).cast("string")).alias("investigation_id"), F.col("text").alias("document"))
    index = DocumentIndex(spark, new_folder(spark, "documents"), buckets=16)
    index.sync(docs.withColumn("document", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("document"))).where("id % 3 > 0 or id % 5 = 3"), 0)
    for _ in range(2):
        index.sync(docs.where("id % 5 <> 3 or id % 11 <> 0"), 1)
    index.remove(spark.createDataFrame([("INV-4",)], "investigation_id string"), 0)
    held = index.store.read("state").select("investigation_id", F.concat(F.lit("ev-"), F.col("evidence_id").cast("string")).alias("document_id"), "content_hash")
    return index.store.read("documents").join(held, ["investigation_id", "document_id"]).where(F.sha2("document", 256) == F.col("content_hash")).select("document_id", "investigation_id", "content_hash")


@query(f"WITH {_EX}, t AS (SELECT investigation_id, count(*) AS total FROM ex GROUP BY 1), f AS (SELECT investigation_id, count(*) AS finished FROM ex WHERE execution_status <> 'running' GROUP BY 1) SELECT t.investigation_id, coalesce(finished, 0) AS finished, total, finished * 100 // total AS percent, finished = total AS complete FROM t JOIN f ON t.investigation_id = f.investigation_id")
def execution_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last progress of each investigation that a stream of its executions' rows shows; a row says that its execution ended, unless it is still running."""
    runs = executions(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet")
    ended = events.select(F.expr("user_id % 7 * 9 + event_id % 9").alias("execution_id"), F.col("ts").alias("finished_at"))
    ended = ended.join(runs.where("execution_status <> 'running'").select(F.col("id").alias("execution_id"), "investigation_id"), "execution_id")
    folder, kind = new_folder(spark, "progress"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind, None)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = stream_progress(ended, runs.groupBy("investigation_id").agg(F.count(F.lit(1)).alias("total")))
        put = lambda rows, i: rows.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/b{i}")
        found.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/mark").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(kind) if before is None else spark.conf.set(kind, before)
    shown = spark.read.schema("investigation_id string, finished long, total long, percent long, complete boolean, batch int").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return shown.groupBy("investigation_id").agg(F.max_by(F.struct("finished", "total", "percent", "complete"), "batch").alias("p")).select("investigation_id", "p.*")


#: Handles of threads, as the given tables have none.
_THREADS = "CASE WHEN artifact_type = 'handles' THEN replace(artifact_value, '\"granted_access\"', '\"type\": \"Thread\", \"handlevalue\": \"' || CAST(id % 7 AS STRING) || '\", \"granted_access\"') ELSE artifact_value END"
_PLUGINS = "CASE (length(question) + length(question_id)) % 3 WHEN 0 THEN 'windows.netscan,windows.cmdline' WHEN 1 THEN 'windows.nothing' ELSE '' END"
_RANK = "row_number() OVER (PARTITION BY {0} ORDER BY {1})"
_RISKS = "CASE risk_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_ROUTED = f"""WITH {_AT}, q AS (SELECT *, {_PLUGINS} AS plugins FROM ({_ASKERS}) a WHERE question IN ('what of pid 7?', 'thread 5?', 'hello')),
rows AS (SELECT id, investigation_id, plugin, artifact_type, risk_level, pid, artifact_value AS av FROM att),
ask AS (SELECT DISTINCT investigation_id FROM q WHERE plugins LIKE 'windows.netscan%'),
turns AS (SELECT r.investigation_id, id, CASE plugin WHEN 'windows.netscan' THEN 0 ELSE 1 END AS place, {_RANK.format("r.investigation_id, plugin", f"CASE WHEN contains(lower(av), 'proc1') THEN 0 ELSE 1 END, {_RISKS}, id")} AS turn
  FROM rows r JOIN ask ON ask.investigation_id = r.investigation_id WHERE plugin IN ('windows.netscan', 'windows.cmdline')),
scoped AS (SELECT q.question_id, q.investigation_id, t.id, 1 AS s, {_RANK.format("q.question_id", "turn, place")} AS r FROM q JOIN turns t ON t.investigation_id = q.investigation_id WHERE plugins LIKE 'windows.netscan%' AND turn <= 6),
pins AS (SELECT q.question_id, q.investigation_id, r.id, 0 AS s, CASE r.id WHEN 90 THEN 0 WHEN 17 THEN 1 ELSE 2 END AS r FROM q JOIN rows r ON r.investigation_id = q.investigation_id AND r.id IN (17, 33, 90) WHERE plugins <> ''),
best AS (SELECT question_id, investigation_id, id, min((s, r)) AS b FROM (SELECT * FROM scoped WHERE r <= 6 UNION ALL SELECT * FROM pins) u GROUP BY ALL),
first AS (SELECT question_id, investigation_id, 'plugins' AS route, id, {_RANK.format("question_id", "b")} AS rank FROM best),
rest AS (SELECT * FROM q WHERE question_id NOT IN (SELECT question_id FROM first)),
tids AS (SELECT investigation_id, id, {_RANK.format("investigation_id", "id")} AS rank FROM rows WHERE artifact_type = 'handles' AND id % 7 = 5),
pids AS (SELECT investigation_id, id, {_RANK.format("investigation_id", "id")} AS rank FROM rows WHERE pid = '7'),
general AS (SELECT investigation_id, id, {_RANK.format("investigation_id", _GENERAL)} AS rank FROM rows)
SELECT question_id, investigation_id, route, id, CAST(rank AS INT) AS rank FROM first WHERE rank <= 6
UNION ALL SELECT question_id, rest.investigation_id, 'tid', id, CAST(rank AS INT) FROM rest JOIN tids ON tids.investigation_id = rest.investigation_id WHERE question = 'thread 5?' AND rank <= 6
UNION ALL SELECT question_id, rest.investigation_id, 'pid', id, CAST(rank AS INT) FROM rest JOIN pids ON pids.investigation_id = rest.investigation_id WHERE question = 'what of pid 7?' AND rank <= 6
UNION ALL SELECT question_id, rest.investigation_id, 'general', id, CAST(rank AS INT) FROM rest JOIN general ON general.investigation_id = rest.investigation_id WHERE question = 'hello' AND rank <= 6"""


@query(_ROUTED)
def retrieve_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with routed plugins, entities and pinned rows, without them, and of threads."""
    asked = spark.sql(_ASKERS.replace("FROM conversations", f"FROM parquet.`{sf_dir}/conversations.parquet`"))
    plugins = F.filter(F.split(F.expr(_PLUGINS), ","), lambda p: p != "")
    asked = asked.where("question in ('what of pid 7?', 'thread 5?', 'hello')").withColumns({"plugins": plugins, "entities": F.array(F.lit("PROC1")), "pinned": F.array(*(F.lit(i).cast("long") for i in (90, 17, 33)))})
    rows = A.with_attributes(evidence(spark, sf_dir).withColumn("artifact_value", F.expr(_THREADS)))
    return dispatch.retrieve(asked, rows, F.col("attributes"), 6)


_REASONS = (
    "concat_ws('|', CASE WHEN p1 THEN 'process executable in user-writable path: ' || path END, CASE WHEN p2 THEN 'process name does not match its on-disk path: ' || path || ' vs ' || name END, CASE WHEN c1 THEN 'command line embeds a remote endpoint: ' || cmd END, CASE WHEN c2 THEN 'command line contains a recon/administration command: ' || cmd END, "
    "CASE WHEN c3 THEN 'command line uses obfuscation/encoding: ' || cmd END, CASE WHEN c4 THEN 'command line references an executable in a user-writable path: ' || cmd END, CASE WHEN f1 THEN 'file is an executable in a user-writable path: ' || name END, CASE WHEN f2 THEN 'file name suggests disguise: ' || name END, "
    "CASE WHEN n1 THEN 'outbound network connection to non-loopback address: ' || rip || ':' || rport END, CASE WHEN n2 THEN 'listening socket on non-default port: ' || lport END, CASE WHEN d1 THEN 'library loaded from a user-writable path: ' || name END, CASE WHEN h1 THEN 'process handle with elevated access to another process' END, "
    "CASE WHEN m1 THEN 'injected memory region detected by windows.malfind' END, CASE WHEN m2 THEN 'memory region with RWX/executable-write protection: ' || prot END, CASE WHEN k1 THEN 'registry key suggests persistence: ' || key END)"
)


@query(_CLASSIFY[: _CLASSIFY.index(", scored AS")] + f" SELECT id, {_REASONS} AS reasons FROM rules")
def classify_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.judged(evidence(spark, sf_dir))
    return rows.select("id", F.array_join(F.transform("hits", lambda h: h["reason"]), "|").alias("reasons"))


@query(f"WITH {_EV}, {_EX}, l AS (SELECT investigation_id, plugin_name, max(id) AS execution_id FROM ex WHERE execution_status = 'completed' GROUP BY 1, 2), s AS (SELECT l.investigation_id, plugin_name, grouping(l.investigation_id, plugin_name) AS g, count(*) AS rows, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium FROM ev JOIN l ON ev.execution_id = l.execution_id GROUP BY ROLLUP (l.investigation_id, plugin_name)) SELECT investigation_id, plugin_name, CASE g WHEN 0 THEN 'plugin' WHEN 1 THEN 'investigation' ELSE 'all' END AS level, rows, high, medium, CASE WHEN g = 0 THEN CAST(row_number() OVER (PARTITION BY investigation_id, g ORDER BY high DESC, medium DESC, plugin_name) AS INT) END AS rank FROM s")
def overview_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.overview_with_totals(evidence(spark, sf_dir), executions(spark, sf_dir))


_NORMAL_TEXT = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9.+_-]+'), ' ')"


def _route_sql() -> str:
    sums = ", ".join("CAST(" + " + ".join(f"CASE WHEN contains(h, '{k}') THEN {len(k.split()) * 10 + len(k)} ELSE 0 END" for k in words) + f" AS INT) AS {q}" for q, words in ROUTES)
    best = f"greatest({', '.join(q for q, _ in ROUTES)})"
    return f"WITH n AS (SELECT conv_id, turn, {_NORMAL_TEXT} AS h FROM conversations), s AS (SELECT *, {sums} FROM n) SELECT conv_id, turn, CASE WHEN {best} = 0 THEN NULL {' '.join(f'''WHEN {q} = {best} THEN '{q}' ''' for q, _ in ROUTES)} END AS qid FROM s"


@query(_route_sql())
def route_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations, by the fixed routes."""
    table = spark.createDataFrame([(i, q, k) for i, (q, words) in enumerate(ROUTES) for k in words], "place int, qid string, keyword string")
    return lookup.route_questions(view(spark, sf_dir, "conversations").withColumnRenamed("text", "question"), table).select("conv_id", "turn", "qid")


#: A catalogue made of the events: a few hundred tools that share names, paths, tokens and ports.
_CATALOGUE = """SELECT DISTINCT 'T' || CAST(user_id % 300 AS STRING) AS tool, CASE event_id % 4 WHEN 0 THEN 'process' WHEN 1 THEN 'path' WHEN 2 THEN 'token' ELSE 'port' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'Proc' || CAST(user_id % 10 AS STRING) || '.exe' WHEN 1 THEN '/file' || CAST(user_id % 10 AS STRING) || '.exe' WHEN 2 THEN ':444' || CAST(user_id % 8 AS STRING) ELSE CAST(440 + user_id % 7 AS STRING) END AS value,
  user_id % 300 % 5 = 0 AS builtin FROM events WHERE event_id % 9 = 0"""


@query(f"WITH {_AT}, c AS ({_CATALOGUE}), s AS (SELECT a.investigation_id, a.id, c.tool, 'executed' AS strength FROM att a JOIN c ON kind = 'process' AND lower(value) = lower(name) WHERE artifact_type = 'pslist' UNION SELECT a.investigation_id, a.id, c.tool, 'executed' FROM att a JOIN c ON kind = 'token' AND contains(lower(cmd), value) WHERE artifact_type = 'cmdline' UNION SELECT a.investigation_id, a.id, c.tool, 'on-disk' FROM att a JOIN c ON kind = 'path' AND NOT builtin AND contains(lower(name), value) WHERE artifact_type = 'filescan'), t AS (SELECT DISTINCT a.investigation_id, a.id, c.tool, 'network' AS strength FROM att a JOIN c ON kind = 'port' AND value = rport JOIN s ON s.investigation_id = a.investigation_id AND s.tool = c.tool WHERE artifact_type = 'netscan') SELECT * FROM s UNION ALL SELECT * FROM t")
def match_tools_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.sql(_CATALOGUE.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`"))
    found = lookup.match_tools(parsed(spark, sf_dir), F.col("attributes"), catalogue, image=("imagefilename", "name"), command=("args", "cmd"), peer="remote_ip", peer_port="remote_port")
    return found.drop("detail")


@query(f"WITH {_AT} SELECT id, CASE process WHEN 'proc1.exe' THEN 'Guard' WHEN 'proc3.exe' THEN 'Watch' END AS product FROM att WHERE artifact_type = 'malfind'")
def security_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = spark.createDataFrame([(0, "PROC1.exe", "Guard"), (1, "proc3.exe", "Watch"), (2, "proc1.exe", "later"), *((i + 3, *p) for i, p in enumerate(PRODUCTS))], "position int, name string, product string")
    rows = parsed(spark, sf_dir).where("artifact_type = 'malfind'").select("id", A.first_key(F.col("attributes"), "process").alias("process"))
    return lookup.with_security_product(rows, F.col("process"), products).select("id", "product")


@query("SELECT event_id AS id FROM events WHERE user_id % 6 <> 3")
def read_large_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as six JSON arrays and read back by ranges; one has lost its tail and is rejected."""
    rows = evidence(spark, sf_dir).select(F.to_json(F.struct("id", "artifact_value", F.array(F.struct("plugin")).alias("__children"))).alias("value"), "id")
    part = view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 6).alias("part"))
    lines = rows.join(part, "id").select("part", F.lit(1).alias("place"), F.concat("value", F.lit(",")).alias("value"))
    ends = part.select("part").distinct().select("part", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("[").alias("value")), F.struct(F.lit(2).alias("place"), F.when(F.col("part") == 3, "null").otherwise("null]").alias("value")))).alias("e")).select("part", "e.*")
    folder = new_folder(spark, "arrays")
    lines.unionByName(ends).repartition("part").sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(folder)
    found, _ = read_arrays(spark, [folder])
    return found.select(F.get_json_object("row", "$.id").cast("long").alias("id"))
