"""Registered queries for retrieval, catalogues, dashboards and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.operators import answers, catalogue, classify, dashboards, dispatch, networks, reports, retrieval

from .fixtures import EMPTY_EXECUTIONS_SQL, empty_executions, evidence, executions, view
from .queries import _AT, _EV, _EX, query

_FIRST = "row_number() OVER (PARTITION BY investigation_id ORDER BY {0})"
_RISK = "CASE WHEN risk_level = 'high' THEN 0 WHEN risk_level = 'medium' THEN 1 ELSE 2 END"
_CMD = "regexp_matches(lower(concat_ws(' ', pid, cmd)), '" + "|".join(t.replace(".", "\\.") for t in retrieval.SUSPICIOUS_COMMANDS) + "')"
#: The derived tables write paths with slashes only, so no path flag arises there; the unit tests cover those.
_FLAGS = f"concat_ws(',', CASE WHEN artifact_type = 'malfind' THEN 'injected-memory-region' END, CASE WHEN artifact_type = 'cmdline' AND {_CMD} THEN 'suspicious-command' END)"


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.parsed(evidence(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str, *, empty: bool = False) -> DataFrame:
    """Executions with an error text for failed ones and a time; empty: with those that have no rows."""
    error = F.when((F.col("execution_status") == "failed") & (F.col("id") % 2 == 0), F.concat(F.lit("trace\nstopped at "), F.col("id").cast("string")))
    found = executions(spark, sf_dir).unionByName(empty_executions(spark, sf_dir)) if empty else executions(spark, sf_dir)
    return found.withColumn("error", error).withColumn("executed_at", F.timestamp_seconds(F.col("id") * 60))


_RUNS = _EX + ", runs AS (SELECT *, CASE WHEN execution_status = 'failed' AND id % 2 = 0 THEN 'stopped at ' || CAST(id AS STRING) END AS error FROM ex)"


@query(f"WITH {_AT} SELECT investigation_id, id FROM att WHERE pid = '7'")
def fetch_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fetch_pid(evidence(spark, sf_dir), "7").select("investigation_id", "id")


@query(f"WITH {_AT}, r AS (SELECT *, coalesce(name IN ('proc1.exe', 'lib2.dll'), false) OR coalesce(process IN ('proc1.exe', 'lib2.dll'), false) AS e FROM att WHERE artifact_type IN ('pslist', 'pstree', 'cmdline', 'malfind', 'netscan', 'handles', 'dlllist') AND (contains(lower(artifact_value), 'proc1.exe') OR contains(lower(artifact_value), 'lib2.dll'))), n AS (SELECT *, {_FIRST.format('e DESC, id')} AS rank FROM r) SELECT investigation_id, id, e AS exact_match, CAST(rank AS INT) AS rank FROM n WHERE rank <= 25")
def fetch_process_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fetch_process_names(evidence(spark, sf_dir), ["proc1.exe", "lib2.dll"], 25).select("investigation_id", "id", "exact_match", "rank")


@query(f"WITH {_EV} SELECT id, artifact_type FROM ev WHERE id IN (40, 7, 12)")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fetch_by_ids(evidence(spark, sf_dir), [40, 7, 12]).select("id", "artifact_type")


@query(f"WITH {_EV} SELECT id FROM ev WHERE execution_id = 12")
def by_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_execution(evidence(spark, sf_dir), 12).select("id")


@query(f"WITH {_EX} SELECT id, plugin_name FROM ex WHERE execution_status = 'completed' AND investigation_id = 'INV-1'")
def executions_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.executions_by(executions(spark, sf_dir), investigation="INV-1", status="completed").select("id", "plugin_name")


@query(f"WITH {_AT}, r AS (SELECT *, {_FLAGS} AS f FROM att WHERE artifact_type IN ('pslist', 'pstree', 'cmdline', 'malfind', 'netscan')), n AS (SELECT *, {_FIRST.format(f'''CASE WHEN artifact_type = 'netscan' THEN 1 ELSE 0 END, {_RISK}, id''')} AS rank FROM r WHERE risk_level IN ('high', 'medium') OR f <> '') SELECT investigation_id, id, CAST(rank AS INT) AS rank, f AS flags FROM n WHERE rank <= 40")
def fetch_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.fetch_suspicious(parsed(spark, sf_dir), F.col("attributes"), 40)
    return found.select("investigation_id", "id", "rank", F.array_join("suspicious_flags", ",").alias("flags"))


@query(f"WITH {_EV}, n AS (SELECT *, {_FIRST.format('id')} AS rank FROM ev WHERE artifact_type IN ('handles', 'dlllist')) SELECT investigation_id, id, CAST(rank AS INT) AS rank FROM n WHERE rank <= 10")
def fetch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fetch_types(evidence(spark, sf_dir), ["handles", "dlllist"], 10).select("investigation_id", "id", "rank")


_GENERAL = "CASE WHEN artifact_type IN ('pslist', 'pstree', 'cmdline', 'malfind', 'netscan') THEN 0 ELSE 1 END, id"


@query(f"WITH {_EV}, n AS (SELECT *, {_FIRST.format(_GENERAL)} AS rank FROM ev) SELECT investigation_id, id, CAST(rank AS INT) AS rank FROM n WHERE rank <= 20")
def fetch_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fetch_general(evidence(spark, sf_dir), 20).select("investigation_id", "id", "rank")


@query(f"WITH {_EV}, n AS (SELECT *, {_FIRST.format(_GENERAL)} AS rank FROM ev), p AS (SELECT *, {_FIRST.format('id')} AS rank FROM ev WHERE artifact_type = 'handles'), b AS (SELECT investigation_id, id, 0 AS s, rank FROM p WHERE rank <= 3 UNION ALL SELECT investigation_id, id, 1, rank FROM n WHERE rank <= 20), d AS (SELECT investigation_id, id, min(s) AS s, arg_min(rank, s) AS r FROM b GROUP BY 1, 2), m AS (SELECT *, {_FIRST.format('s, r, id')} AS rank FROM d) SELECT investigation_id, id, CAST(rank AS INT) AS rank, s = 0 AS pinned FROM m WHERE rank <= 12")
def merge_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evidence(spark, sf_dir)
    return retrieval.merge_pinned(retrieval.fetch_types(ev, ["handles"], 3), retrieval.fetch_general(ev, 20), 12)


@query(f"WITH {_AT} SELECT id, CASE WHEN j IS NOT NULL THEN pid END AS pid, coalesce(name, process) AS process_name, {_FLAGS} AS flags, 1.0 AS score FROM att".replace("1.0 AS score", "CAST(1 AS DOUBLE) AS score"))
def to_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.to_match(parsed(spark, sf_dir), F.col("attributes")).select("id", "pid", "process_name", F.array_join("suspicious_flags", ",").alias("flags"), "score")


@query("WITH v AS (SELECT conv_id AS q, CAST(turn AS DOUBLE) / 10 AS s, turn AS id FROM conversations), g AS (SELECT q FROM v GROUP BY 1 HAVING max(s) >= 0.5) SELECT q AS question_id, id, s AS score, 'semantic' AS source FROM v WHERE q IN (SELECT q FROM g) UNION ALL SELECT q, -id, 1 - s, 'authoritative' FROM v WHERE q NOT IN (SELECT q FROM g)")
def choose_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("id"), (F.col("turn").cast("double") / 10).alias("score"))
    return retrieval.choose_source(vector, vector.select("question_id", (-F.col("id")).alias("id"), (1 - F.col("score")).alias("score")))


@query("SELECT turn AS id, role FROM conversations WHERE conv_id = 3")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chat_history(view(spark, sf_dir, "conversations").withColumnRenamed("turn", "id"), 3, by="conv_id").select("id", "role")


@query("SELECT 'ev-' || CAST(doc_id AS STRING) AS document_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS document FROM documents")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = view(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ev-"), F.col("doc_id").cast("string")).alias("document_id"), F.col("lang").alias("document"))
    return retrieval.upsert_documents(stored, stored.where("doc_id % 3 = 0").withColumn("document", F.upper("document"))).drop("doc_id")


@query(f"WITH {_AT}, h AS (SELECT investigation_id, id, 'Runner' AS tool, 'executed' AS strength FROM att WHERE artifact_type = 'pslist' AND name = 'proc1.exe' UNION ALL SELECT investigation_id, id, 'Runner', 'executed' FROM att WHERE artifact_type = 'cmdline' AND (contains(cmd, 'whoami') OR regexp_matches(cmd, ':4444')) UNION ALL SELECT investigation_id, id, 'Loader', 'on-disk' FROM att WHERE artifact_type = 'filescan' AND contains(name, '/file2'))"
       ", p AS (SELECT DISTINCT investigation_id, tool FROM h), n AS (SELECT a.investigation_id, a.id, p.tool, 'network' AS strength FROM att a JOIN p ON a.investigation_id = p.investigation_id WHERE artifact_type = 'netscan' AND rport = '443' AND p.tool = 'Runner'), b AS (SELECT * FROM h UNION ALL SELECT * FROM n) SELECT investigation_id, tool, CASE min(CASE strength WHEN 'executed' THEN 1 WHEN 'on-disk' THEN 2 ELSE 3 END) WHEN 1 THEN 'executed' WHEN 2 THEN 'on-disk' ELSE 'network' END AS strength, count(DISTINCT id) AS n_rows, min(id) AS first_id FROM b GROUP BY 1, 2")
def match_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = [
        catalogue.Tool("Runner", processes=("proc1.exe",), tokens=("whoami",), pattern=r":4444\b", ports=(443,)),
        catalogue.Tool("Loader", paths=("/file2",)),
        catalogue.Tool("Shipped", paths=("/file",), ports=(443,), builtin=True),
    ]
    hits = catalogue.match_tools(parsed(spark, sf_dir), F.col("attributes"), tools, image=("imagefilename", "name"), command=("args", "cmd"), peer_port="remote_port")
    return catalogue.summarize_tools(hits).drop("n_details")


_SIGNATURES = f"WITH {_AT}, s AS (SELECT investigation_id, prot AS rule, process, CASE WHEN CAST(pid AS INT) % 2 = 0 THEN '00 00 00 00' ELSE '4d 5a 90' END AS data FROM att WHERE artifact_type = 'malfind'), k AS (SELECT *, process = 'proc1.exe' AS prod, data = '00 00 00 00' AS low FROM s), g AS (SELECT investigation_id, rule, count(*) AS total, count(*) FILTER (prod) AS in_product, count(*) FILTER (NOT prod AND low) AS low_information, count(*) FILTER (NOT prod AND NOT low) AS corroborating, coalesce(max(CASE WHEN prod THEN 'Guard' END), '') AS products, count(DISTINCT CASE WHEN NOT prod AND NOT low THEN process END) AS processes FROM k GROUP BY 1, 2) "


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, pid = F.col("attributes"), A.first_key(F.col("attributes"), "pid").cast("int")
    hits = parsed(spark, sf_dir).where("artifact_type = 'malfind'").select("investigation_id", A.first_key(a, "protection").alias("rule"), A.first_key(a, "process").alias("process"), F.when(pid % 2 == 0, "00 00 00 00").otherwise("4d 5a 90").alias("data"))
    return catalogue.assess_signatures(hits, [("proc1.exe", "Guard")])


@query(_SIGNATURES + "SELECT * FROM g")
def assess_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir)


@query(_SIGNATURES + "SELECT investigation_id, CASE WHEN bool_and(corroborating = 0) THEN 25 WHEN bool_or(corroborating = 0) THEN 50 END AS ceiling FROM g GROUP BY 1")
def signature_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.signature_ceiling(_signatures(spark, sf_dir))


@query("SELECT conv_id, turn, unnest([0, 1]) AS position, unnest(['10.' || CAST(turn AS STRING) || '.0.0/16', '192.168.0.' || CAST(turn AS STRING)]) AS cidr FROM conversations WHERE role = 'user'")
def networks_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "conversations").where("role = 'user'").withColumn("question", F.concat(F.lit("seen 192.168.0."), F.col("turn").cast("string"), F.lit(" or 10."), F.col("turn").cast("string"), F.lit(".0.0/16?")))
    return catalogue.networks_in_text(asked).select("conv_id", "turn", "position", "cidr")


@query(f"WITH {_AT} SELECT rip AS address, 'ten' AS name, count(DISTINCT id) AS n_rows, min(id) AS first_id, string_agg(DISTINCT st, ',' ORDER BY st) AS states FROM att WHERE starts_with(rip, '10.') GROUP BY 1")
def summarize_network_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    rows = parsed(spark, sf_dir).where("artifact_type = 'netscan'").select("id", A.first_key(a, "remote_ip").alias("address"), A.first_key(a, "state").alias("state"))
    nets = spark.createDataFrame([(0, "ten", "10.0.0.0/8")], "position int, name string, cidr string")
    return catalogue.summarize_network_scan(rows, networks.match_networks(rows, nets))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sockets of completed executions."""
    done = executions(spark, sf_dir).where("execution_status = 'completed'").select(F.col("id").alias("execution_id"))
    rows = classify.parsed(evidence(spark, sf_dir).where("artifact_type = 'netscan'").join(done, "execution_id", "left_semi"))
    return networks.endpoints(rows, F.col("attributes"), remote="remote_ip", local="local_ip", remote_port="remote_port", local_port="local_port")


_DONE = f"WITH {_AT}, {_EX}, net AS (SELECT a.* FROM att a JOIN ex ON ex.id = a.execution_id WHERE artifact_type = 'netscan' AND execution_status = 'completed')"


@query(f"{_DONE} SELECT investigation_id, id, rip AS address, CASE WHEN starts_with(rip, '10.0.') OR starts_with(rip, '10.1.') THEN '10.0.0.0/15' ELSE '10.0.0.0/8' END AS network, 'remote' AS role, 'remote address ' || rip || ' port ' || rport || ' state ' || st || ' via ' || plugin AS detail FROM net WHERE starts_with(rip, '10.')")
def scan_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = spark.createDataFrame([(0, "six", "2001:db8::/32"), (1, "low", "10.1.2.3/15"), (2, "ten", "10.0.0.0/8")], "position int, name string, cidr string")
    return networks.scan_networks(_ends(spark, sf_dir), nets).drop("name")


@query(f"{_DONE} SELECT investigation_id, rip AS address, 'ten' AS name, count(*) AS n_rows, min(id) AS first_id, 'remote' AS roles, count(DISTINCT st) AS n_details FROM net WHERE starts_with(rip, '10.') GROUP BY 1, 2")
def summarize_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = spark.createDataFrame([(0, "ten", "10.0.0.0/8")], "position int, name string, cidr string")
    return networks.summarize_scan(networks.scan_networks(_ends(spark, sf_dir), nets)).drop("network")


@query(f"{_DONE} SELECT investigation_id, count(*) AS rows_examined, count(DISTINCT rip) AS distinct_addresses, 'windows.netscan' AS plugins FROM net GROUP BY 1")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.scan_totals(_ends(spark, sf_dir))


_HEX = "lower(hex(user_id % 60000 + 1))"


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 4 ELSE 6 END AS version, CASE event_id % 3 WHEN 0 THEN '10.' || CAST(user_id % 250 AS STRING) || '.0.0/16' ELSE '2001:db8:0:' || lower(to_hex(user_id % 60000 + 1)) || '::/64' END AS network FROM events WHERE event_id % 3 < 2")
def parse_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    four, six = "'10.' || cast(user_id % 250 AS STRING) || '.7.9/16'", f"'2001:db8::' || {_HEX} || ':1:0:0:5/64'"
    given = view(spark, sf_dir, "events").select("event_id", F.expr(f"CASE event_id % 3 WHEN 0 THEN {four} WHEN 1 THEN {six} ELSE '999.1.1.1/8' END").alias("cidr"))
    return networks.parse_networks(given).select("event_id", "version", "network")


@query(f"WITH {_EV} SELECT execution_id, count(*) AS n FROM ev GROUP BY 1")
def count_by_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.count_by(evidence(spark, sf_dir), "execution_id")


@query(f"WITH {_EV}, d AS (SELECT 'INV-' || CAST(o_orderkey AS STRING) AS investigation_id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, investigation_id DESC LIMIT 5) SELECT d.investigation_id, count(ev.id) AS evidence_count FROM d LEFT JOIN ev ON ev.investigation_id = d.investigation_id GROUP BY 1")
def recent_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = view(spark, sf_dir, "orders").select(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("investigation_id"), F.col("o_orderdate").alias("created_at"))
    return dashboards.recent_investigations(dumps, evidence(spark, sf_dir)).drop("created_at")


@query(f"WITH {_EX} SELECT count(*) FILTER (execution_status IN ('completed', 'failed')) AS finished_executions, round(100.0 * count(*) FILTER (execution_status = 'completed') / count(*) FILTER (execution_status IN ('completed', 'failed')), 1) AS success_rate, count(DISTINCT investigation_id) AS investigations, (SELECT count(*) FROM events) AS evidence, (SELECT count(*) FROM orders) AS reports, (SELECT count(*) FROM conversations WHERE role = 'user') AS questions FROM ex")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = executions(spark, sf_dir)
    return dashboards.dashboard(ex, evidence(spark, sf_dir), ex, view(spark, sf_dir, "conversations"), view(spark, sf_dir, "orders"))


@query(f"WITH {_EV}, {_RUNS} SELECT DISTINCT investigation_id, plugin_name, coalesce(error, execution_status) AS reason FROM runs WHERE execution_status <> 'completed' AND id NOT IN (SELECT execution_id FROM ev WHERE id % 2 = 0 AND risk_level = 'high' AND id < 500)")
def unavailable_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.unavailable_plugins(runs(spark, sf_dir), evidence(spark, sf_dir).where("id % 2 = 0 and risk_level = 'high' and id < 500"))


@query(f"WITH {_EV}, {_EX}, runs AS (SELECT *, CASE WHEN execution_status = 'failed' AND id % 2 = 0 THEN 'stopped at ' || CAST(id AS STRING) END AS error FROM (SELECT * FROM ex UNION ALL ({EMPTY_EXECUTIONS_SQL})) u) SELECT DISTINCT investigation_id, plugin_name, coalesce(error, execution_status) AS reason FROM runs WHERE execution_status <> 'completed' AND id NOT IN (SELECT execution_id FROM ev)")
def unavailable_plugins_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.unavailable_plugins(runs(spark, sf_dir, empty=True), evidence(spark, sf_dir))


@query(f"WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY investigation_id, artifact_type ORDER BY id) AS k FROM ev) SELECT investigation_id, artifact_type, count(*) AS n, CAST(round(avg(confidence_score)) AS INT) AS confidence, string_agg(CAST(id AS STRING), ',' ORDER BY id) FILTER (k <= 30) AS ids, greatest(count(*) - 30, 0) AS more FROM n GROUP BY 1, 2")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.evidence_summary(evidence(spark, sf_dir))


_FOUND = " UNION ALL ".join([f"SELECT investigation_id, id, '{name}' AS finding FROM t WHERE regexp_matches(h, '{'|'.join(words)}')" for name, words in dashboards.FINDINGS.items()] + ["SELECT investigation_id, id, 'high_confidence' FROM t WHERE confidence_score >= 90"])


@query(f"WITH {_EV}, t AS (SELECT *, lower(plugin || ' ' || artifact_type || ' ' || artifact_value) AS h FROM ev), f AS ({_FOUND}), n AS (SELECT *, count(*) OVER (PARTITION BY investigation_id, finding) AS total, row_number() OVER (PARTITION BY investigation_id, finding ORDER BY id) AS place FROM f) SELECT investigation_id, finding, total, CAST(place AS INT) AS place, id FROM n WHERE place <= 20")
def high_priority_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.high_priority_findings(evidence(spark, sf_dir))


@query(f"WITH {_EV}, {_EX}, c AS (SELECT execution_id, count(*) AS n FROM ev GROUP BY 1) SELECT ex.investigation_id, count(*) AS plugins, count(*) FILTER (execution_status = 'completed') AS completed, count(*) FILTER (execution_status = 'failed') AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS evidence, CAST(60 * (max(id) - min(id)) AS BIGINT) AS seconds FROM ex LEFT JOIN c ON c.execution_id = ex.id GROUP BY 1")
def investigation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.investigation_stats(runs(spark, sf_dir), evidence(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT investigation_id, count(*) FILTER (execution_status = 'completed') AS completed, count(*) FILTER (execution_status = 'failed') AS failed, bool_and(execution_status IN ('completed', 'failed')) AS finished, 'trace' || chr(10) || arg_max(error, id) FILTER (error IS NOT NULL) AS error FROM runs GROUP BY 1")
def investigation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.investigation_status(runs(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, CAST(least(100, floor(l_linenumber * 100 / 7)) AS INT) AS percent, round(l_quantity / l_linenumber * (7 - l_linenumber), 1) AS eta_seconds FROM lineitem")
def with_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("done"), F.lit(7).alias("total"), F.col("l_quantity").alias("seconds"))
    return dashboards.with_progress(rows).select("l_orderkey", "l_linenumber", "percent", "eta_seconds")


@query(f"WITH {_AT} SELECT a.investigation_id, created_at AS ts, 'process started: ' || name || ' (PID ' || pid || ', PPID None)' AS description, plugin, a.id FROM att a JOIN ({_EX[7:-1]}) x ON x.id = a.execution_id WHERE artifact_type = 'pslist' AND execution_status = 'completed'")
def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir).where("artifact_type = 'pslist'")
    a = F.map_concat("attributes", F.create_map(F.lit("createtime"), F.col("created_at").cast("string"), F.lit("imagefilename"), A.first_key(F.col("attributes"), "name")))
    return dashboards.timeline_events(reports.scope(rows.withColumn("attributes", a), executions(spark, sf_dir)), F.col("attributes"))


#: A small table of routes; keywords are words of the conversations' texts or none of them.
ROUTES = [("Q1", ["data", "the data"]), ("Q2", ["model", "how"]), ("Q3", ["please", "what"])]
_NORMAL = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9.+_-]+'), ' ')"
_SCORES = ", ".join("" + " + ".join(f"CASE WHEN contains(h, '{k}') THEN {len(k.split()) * 10 + len(k)} ELSE 0 END" for k in words) + f" AS {qid}" for qid, words in ROUTES)


@query(f"WITH n AS (SELECT conv_id, turn, {_NORMAL} AS h FROM conversations), s AS (SELECT *, {_SCORES} FROM n) SELECT conv_id, turn, CASE WHEN greatest(Q1, Q2, Q3) = 0 THEN NULL WHEN Q1 >= greatest(Q2, Q3) THEN 'Q1' WHEN Q2 >= Q3 THEN 'Q2' ELSE 'Q3' END AS qid FROM s")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.route_questions(view(spark, sf_dir, "conversations").withColumnRenamed("text", "question"), ROUTES).select("conv_id", "turn", "qid")


def _has(words: tuple[str, ...]) -> str:
    return "regexp_matches(h, '\\b(" + "|".join(words) + ")\\b')"


_FAMILIES = ", ".join([f"CASE WHEN {_has(w)}{' OR ' + _has(answers.PROCESS_WORDS) if f in answers.PROCESS_FAMILIES else ''} THEN '{f}' END" for f, w in sorted({**answers.FAMILY_WORDS, "pslist": ("pslist",), "pstree": ("pstree",)}.items())])


@query(f"WITH n AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' pid ' || CAST(turn AS STRING)) AS h FROM conversations WHERE role = 'user') SELECT conv_id, turn, CAST(turn AS STRING) AS pid, {_has(answers.SUSPICIOUS_WORDS)} AS suspicious, concat_ws(',', {_FAMILIES}) AS families FROM n")
def detect_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "conversations").where("role = 'user'").withColumn("question", F.concat(F.coalesce("text", F.lit("")), F.lit(" pid "), F.col("turn").cast("string")))
    return answers.detect_intent(asked).select("conv_id", "turn", "pid", "suspicious", F.array_join("families", ",").alias("families"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of the assistant's texts: an assessment, citations and a confidence line."""
    n = F.col("turn").cast("string")
    raw = F.concat(F.lit("FINDING\nseen ["), (F.col("turn") + 1).cast("string"), F.lit(", 9] [1-3] [2]-[4] [77]\n## ASSESSMENT\n"), F.translate(F.coalesce("text", F.lit("")), "[]", "()"), F.lit("\nGAPS\nweak\nConfidence: 7"), n)
    made = view(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("question_id"), raw.alias("raw"), F.lit(10).alias("n_evidence"))
    return answers.parse_citations(made)


@query("SELECT conv_id, turn, least(100, CAST('7' || CAST(turn AS STRING) AS INT)) AS confidence, array_to_string(list_sort(list_distinct(list_filter([turn + 1, 9, 1, 2, 3, 4], lambda x: x <= 10))), ',') AS citations FROM conversations WHERE role = 'assistant'")
def parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("conv_id", "turn", "confidence", F.array_join(F.array_sort("citations"), ",").alias("citations"))


_BAND = "CASE " + " ".join(f"WHEN regexp_matches(h, '{'|'.join(terms)}') THEN {value}" for value, terms in answers.BANDS) + " ELSE 50 END"


@query(f"SELECT conv_id, turn, {_BAND} AS band FROM (SELECT *, lower(coalesce(text, '')) AS h FROM conversations WHERE role = 'assistant') t")
def assessment_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("conv_id", "turn", answers.assessment_band(answers.assessment(F.col("answer"))).alias("band"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten numbered references for each answer: every third of risk high where the turn is odd, else none."""
    ids = _cited(spark, sf_dir).select("question_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("id"))
    return answers.build_references(ids.withColumn("rank", F.col("id"))).withColumn("risk_level", F.when((F.col("turn") % 2 == 1) & (F.col("id") % 3 == 0), "high").otherwise("unknown")).drop("turn")


@query(f"SELECT conv_id, turn, least(greatest({_BAND} + CASE WHEN turn % 2 = 1 THEN 10 ELSE -10 END, 0), 95, CASE WHEN turn % 4 = 1 THEN 15 ELSE 95 END, CASE turn % 3 WHEN 0 THEN 95 WHEN 1 THEN 70 ELSE 30 END) AS confidence FROM (SELECT *, lower(coalesce(text, '')) AS h FROM conversations WHERE role = 'assistant') t")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _cited(spark, sf_dir)
    cited = answers.cited_references(said, _references(spark, sf_dir))
    asked = said.drop("confidence").withColumns({"insufficient": F.col("turn") % 4 == 1, "unavailable_sources": F.col("turn") % 3, "total_sources": F.lit(2), "prior": F.lit(None).cast("int")})
    return answers.calibrate(asked, cited).select("conv_id", "turn", "confidence")


@query("WITH r AS (SELECT conv_id AS q, CAST(turn AS DOUBLE) / 20 AS s, role = 'user' AS hi, turn % 2 = 0 AS f FROM conversations), g AS (SELECT q, CAST(least(100, greatest(0, round_even(max(s) * 100, 0))) AS INT) + CASE WHEN bool_or(hi) THEN 25 ELSE 0 END + CASE WHEN bool_or(f) THEN 10 ELSE 0 END + CASE WHEN count(*) >= 2 THEN 5 ELSE 0 END AS c FROM r GROUP BY 1) SELECT q AS question_id, least(c, 75) AS confidence FROM g")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("turn").cast("double") / 20).alias("score"), F.when(F.col("role") == "user", "high").alias("risk_level"), (F.col("turn") % 2 == 0).alias("has_flags"), F.lit(False).alias("exact_match"), F.lit("general").alias("quality"))
    return answers.evidence_confidence(rows)


@query(f"WITH {_AT} SELECT investigation_id || '-' || process AS question_id, CASE WHEN count(*) FILTER (priv = '0') > 0 AND count(*) FILTER (priv = '1') = 0 THEN 40 END AS ceiling FROM att WHERE artifact_type = 'malfind' GROUP BY 1")
def malfind_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    rows = parsed(spark, sf_dir).where("artifact_type = 'malfind'").withColumn("question_id", F.concat_ws("-", "investigation_id", A.first_key(a, "process")))
    return answers.malfind_ceiling(rows, A.region_kind(F.col("artifact_type"), a))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 5 = 0 THEN 'no confidence value' END, CASE WHEN turn % 2 = 0 THEN 'signature answer missing corroboration notice' END) AS failures FROM conversations WHERE role = 'assistant'")
def audit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _cited(spark, sf_dir).withColumns({"answer": F.lit("seen"), "confidence": F.when(F.col("turn") % 5 != 0, F.lit(60)), "qid": F.when(F.col("turn") % 2 == 0, "Q11").otherwise("Q1"), "plugins": F.array(F.lit("windows.netscan"))})
    return answers.audit_answers(said).select("conv_id", "turn", F.array_join("failures", ",").alias("failures"))


_ASKED = "CASE (turn + coalesce(length(text), 0)) % 6 WHEN 0 THEN 'what of pid 7?' WHEN 1 THEN 'anything suspicious in proc1.exe?' WHEN 2 THEN 'anything suspicious?' WHEN 3 THEN 'which modules and handles?' WHEN 4 THEN 'thread 5?' ELSE 'hello' END"
_ASKERS = f"SELECT conv_id || '-' || CAST(turn AS STRING) AS question_id, 'INV-' || CAST((turn + coalesce(length(text), 0)) % 8 AS STRING) AS investigation_id, {_ASKED} AS question FROM conversations WHERE role = 'user'"
_RANKED = "SELECT investigation_id, id, '{0}' AS route, {1} AS question, row_number() OVER (PARTITION BY investigation_id ORDER BY {2}) AS rank FROM {3} WHERE {4}"
_RETRIEVE = f"WITH {_AT}, q AS ({_ASKERS}), s AS (SELECT *, {_FLAGS} AS f FROM att WHERE artifact_type IN ('pslist', 'pstree', 'cmdline', 'malfind', 'netscan')), r AS (" + " UNION ALL ".join((
    _RANKED.format("pid", "'what of pid 7?'", "id", "att", "pid = '7'"),
    _RANKED.format("names", "'anything suspicious in proc1.exe?'", "CASE WHEN name = 'proc1.exe' OR process = 'proc1.exe' THEN 0 ELSE 1 END, id", "att", "artifact_type IN ('pslist', 'pstree', 'cmdline', 'malfind', 'netscan', 'handles', 'dlllist') AND contains(lower(artifact_value), 'proc1.exe')"),
    _RANKED.format("suspicious", "'anything suspicious?'", f"CASE WHEN artifact_type = 'netscan' THEN 1 ELSE 0 END, {_RISK}, id", "s", "risk_level IN ('high', 'medium') OR f <> ''"),
    _RANKED.format("types", "'which modules and handles?'", "id", "att", "artifact_type IN ('dlllist', 'handles')"),
    _RANKED.format("general", "'hello'", _GENERAL, "att", "true"),
)) + ") SELECT question_id, q.investigation_id, route, id, CAST(rank AS INT) AS rank FROM q JOIN r ON q.investigation_id = r.investigation_id AND q.question = r.question WHERE rank <= 8"


@query(_RETRIEVE)
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(_ASKERS.replace("FROM conversations", f"FROM parquet.`{sf_dir}/conversations.parquet`"))
    return dispatch.retrieve(asked, parsed(spark, sf_dir), F.col("attributes"), 8)
