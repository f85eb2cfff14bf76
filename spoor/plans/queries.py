"""Registered queries over the given tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.operators import classify, networks, reports, retrieval

from .fixtures import EVIDENCE_SQL, EXECUTIONS_SQL, evidence, executions, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_EV, _EX = f"ev AS ({EVIDENCE_SQL})", f"ex AS ({EXECUTIONS_SQL})"
#: Attributes as columns, null where the value is no JSON.
_AT = _EV + """, js AS (SELECT *, CASE WHEN json_valid(artifact_value) THEN artifact_value END AS j FROM ev),
att AS (SELECT *, j->>'$.pid' AS pid, j->>'$.name' AS name, j->>'$.path' AS path, j->>'$.cmd' AS cmd, j->>'$.remote_ip' AS rip, j->>'$.remote_port' AS rport, j->>'$.local_port' AS lport,
  j->>'$.state' AS st, j->>'$.granted_access' AS ga, j->>'$.protection' AS prot, j->>'$.key' AS key, j->>'$.process' AS process, j->>'$.privatememory' AS priv FROM js)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_WRITABLE = "(regexp_matches(lower({0}), '/temp/|/tmp/|/appdata/|/roaming/|/local/temp|/downloads/|/desktop/|/programdata/|/users/') AND NOT regexp_matches(lower({0}), 'c:/windows|c:/program files|/windows/system32|/windows/syswow64'))"
_EXE = "regexp_matches(lower({0}), '\\.(exe|dll|bat|ps1|scr|pif)$')"
_TOK = "regexp_extract(cmd, '\\S+', 0)"
_BASE = "lower(regexp_extract({0}, '[^/]*$', 0))"
_STEM = "regexp_replace({0}, '\\.[^.]*$', '')"
_CLASSIFY = (
    "WITH " + _AT + ", rules AS (SELECT *, "
    f"artifact_type = 'pslist' AND path IS NOT NULL AND {_EXE.format('name')} AND {_WRITABLE.format('path')} AS p1, "
    f"artifact_type = 'pslist' AND path IS NOT NULL AND contains({_BASE.format('path')}, '.') AND {_STEM.format(_BASE.format('path'))} <> {_STEM.format('lower(name)')} AND NOT contains(lower(name), {_BASE.format('path')}) AND NOT contains({_BASE.format('path')}, lower(name)) AS p2, "
    "artifact_type = 'cmdline' AND regexp_matches(cmd, '\\b\\d{1,3}(\\.\\d{1,3}){3}:\\d{1,5}\\b') AS c1, "
    "artifact_type = 'cmdline' AND regexp_matches(cmd, '(^| )(whoami|net user)') AS c2, artifact_type = 'cmdline' AND contains(cmd, '-enc') AS c3, "
    f"artifact_type = 'cmdline' AND {_EXE.format(_TOK)} AND {_WRITABLE.format(_TOK)} AS c4, "
    f"artifact_type = 'filescan' AND {_EXE.format('name')} AND {_WRITABLE.format('name')} AS f1, artifact_type = 'filescan' AND contains(name, '.exe.') AS f2, "
    "artifact_type = 'netscan' AND NOT starts_with(rip, '127.') AS n1, artifact_type = 'netscan' AND st = 'LISTENING' AND CAST(lport AS INT) >= 1024 AS n2, "
    f"artifact_type = 'dlllist' AND {_WRITABLE.format('name')} AS d1, artifact_type = 'handles' AND ga IN ('0x1fffff', '4') AS h1, "
    "artifact_type = 'malfind' AS m1, artifact_type = 'malfind' AND prot = 'PAGE_EXECUTE_READWRITE' AS m2, artifact_type = 'printkey' AND contains(key, chr(92) || 'run' || chr(92)) AS k1 FROM att), "
    "scored AS (SELECT *, CAST(coalesce(p1, false) AS INT) * 2 + CAST(coalesce(p2, false) AS INT) + CAST(coalesce(c1, false) AS INT) * 3 + CAST(coalesce(c2, false) AS INT) * 3 + CAST(coalesce(c3, false) AS INT) * 2 + CAST(coalesce(c4, false) AS INT) + CAST(coalesce(f1, false) AS INT) * 2 + CAST(coalesce(f2, false) AS INT) "
    "+ CAST(coalesce(n1, false) AS INT) * 3 + CAST(coalesce(n2, false) AS INT) * 2 + CAST(coalesce(d1, false) AS INT) * 2 + CAST(coalesce(h1, false) AS INT) * 2 + CAST(coalesce(m1, false) AS INT) * 3 + CAST(coalesce(m2, false) AS INT) * 2 + CAST(coalesce(k1, false) AS INT) * 2 AS base, "
    "coalesce(c1, false) OR coalesce(c2, false) OR coalesce(n1, false) OR coalesce(m1, false) AS strong, "
    "concat_ws(',', CASE WHEN p1 THEN 'PSL-01' END, CASE WHEN p2 THEN 'PSL-02' END, CASE WHEN c1 THEN 'CMD-01' END, CASE WHEN c2 THEN 'CMD-02' END, CASE WHEN c3 THEN 'CMD-03' END, CASE WHEN c4 THEN 'CMD-04' END, CASE WHEN f1 THEN 'FS-01' END, CASE WHEN f2 THEN 'FS-02' END, CASE WHEN n1 THEN 'NS-01' END, CASE WHEN n2 THEN 'NS-02' END, CASE WHEN d1 THEN 'DL-01' END, CASE WHEN h1 THEN 'HD-01' END, CASE WHEN m1 THEN 'MF-01' END, CASE WHEN m2 THEN 'MF-02' END, CASE WHEN k1 THEN 'PK-01' END) AS indicators FROM rules), "
    "paths AS (SELECT *, CASE WHEN artifact_type = 'cmdline' AND (contains(" + _TOK + ", '/') OR " + _EXE.format(_TOK) + ") THEN trim(lower(" + _TOK + "), '/') WHEN artifact_type IN ('pslist', 'filescan', 'dlllist') THEN trim(lower(coalesce(path, name)), '/') END AS np FROM att), "
    "ents AS (SELECT DISTINCT investigation_id, id, artifact_type AS fam, kind, value FROM ("
    "SELECT investigation_id, id, artifact_type, 'pid' AS kind, pid AS value FROM att UNION ALL SELECT investigation_id, id, artifact_type, 'name', lower(name) FROM att "
    "UNION ALL SELECT investigation_id, id, artifact_type, 'name', nullif(regexp_extract(trim(lower(" + _TOK + "), '/'), '[^/]*$', 0), '') FROM att WHERE artifact_type = 'cmdline' "
    "UNION ALL SELECT investigation_id, id, artifact_type, 'path', np FROM paths UNION ALL SELECT investigation_id, id, artifact_type, 'path_stem', " + _STEM.format(_BASE.format("np")) + " FROM paths "
    "UNION ALL SELECT investigation_id, id, artifact_type, 'conn', rip || chr(9) || rport FROM att WHERE artifact_type = 'netscan' UNION ALL SELECT investigation_id, id, artifact_type, 'reg', replace(lower(key), chr(92), '/') FROM att WHERE artifact_type = 'printkey') WHERE value IS NOT NULL), "
    "fams AS (SELECT DISTINCT investigation_id, kind, value, fam FROM ents), "
    "corr AS (SELECT e.id, count(DISTINCT f.fam) AS nf, string_agg(DISTINCT f.fam, ',' ORDER BY f.fam) AS families FROM ents e JOIN fams f ON e.investigation_id = f.investigation_id AND e.kind = f.kind AND e.value = f.value AND e.fam <> f.fam GROUP BY e.id), "
    "fin AS (SELECT s.*, coalesce(c.families, '') AS families, j IS NOT NULL AND s.artifact_type <> 'info' AND coalesce(nf, 0) >= CASE WHEN s.artifact_type = 'malfind' THEN 1 ELSE 2 END AS corroborated FROM scored s LEFT JOIN corr c ON c.id = s.id), "
    "pts AS (SELECT *, CASE WHEN j IS NULL OR artifact_type = 'info' THEN 0 ELSE base + CASE WHEN strong AND corroborated THEN 4 WHEN corroborated THEN 2 ELSE 0 END END AS score FROM fin) "
    "SELECT id, CASE WHEN j IS NULL THEN 'unknown' WHEN artifact_type = 'info' THEN 'insufficient-evidence' WHEN score >= 6 AND strong AND corroborated THEN 'high' WHEN strong OR score >= 3 THEN 'medium' ELSE 'low' END AS severity, CAST(score AS INT) AS score, indicators, corroborated, families FROM pts"
)


@query(_CLASSIFY)
def classify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify_evidence(evidence(spark, sf_dir))
    return found.select("id", "severity", "score", F.concat_ws(",", "indicators").alias("indicators"), "corroborated", F.concat_ws(",", "families").alias("families"))


@query(_CLASSIFY.replace("FROM pts", "FROM pts WHERE risk_level IS NULL").replace("SELECT id, CASE WHEN j IS NULL THEN 'unknown'", "SELECT id, '1.0' AS rule_version, CASE WHEN j IS NULL THEN 'unknown'").replace(", CAST(score AS INT) AS score, indicators, corroborated, families FROM", " FROM").replace(" END AS severity FROM pts", " END AS severity FROM pts"))
def classify_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_incremental(evidence(spark, sf_dir)).select("id", "rule_version", "severity")


@query(f"WITH {_EV}, {_EX} SELECT ev.id, ex.plugin_name, ex.execution_status FROM ev JOIN ex ON ev.execution_id = ex.id WHERE ex.investigation_id = 'INV-3'")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scope(evidence(spark, sf_dir), executions(spark, sf_dir), "INV-3").select("id", "plugin_name", "execution_status")


@query(f"WITH {_EV}, {_EX} SELECT ev.id FROM ev WHERE execution_id IN (SELECT id FROM ex WHERE investigation_id = 'INV-2')")
def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scope_semi(evidence(spark, sf_dir), executions(spark, sf_dir), "INV-2").select("id")


@query(f"WITH {_EV}, m AS (SELECT * FROM ev WHERE contains(lower(artifact_value), 'appdata') AND risk_level = 'high') SELECT id, artifact_type, (SELECT count(*) FROM m) AS total FROM m ORDER BY id DESC LIMIT 50")
def search_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search_evidence(evidence(spark, sf_dir), text="APPDATA", severity="high", descending=True).select("id", "artifact_type", "total")


@query(f"WITH {_EV} SELECT id FROM ev WHERE id > 100 ORDER BY id LIMIT 100")
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_after(evidence(spark, sf_dir), 100, 100).select("id")


@query(f"WITH {_EV} SELECT coalesce(risk_level, 'unclassified') AS risk_level, count(*) AS n FROM ev GROUP BY 1")
def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_distribution(evidence(spark, sf_dir))


@query(f"WITH {_EV} SELECT artifact_type, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, artifact_type LIMIT 8")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_distribution(evidence(spark, sf_dir))


@query(f"WITH {_EV}, {_EX}, d AS (SELECT DISTINCT 'INV-' || CAST(c_custkey % 9 AS STRING) AS investigation_id FROM customer) SELECT d.investigation_id, count(ev.id) AS evidence_count, count(DISTINCT CASE WHEN ev.id IS NOT NULL THEN ex.plugin_name END) AS plugin_count FROM d LEFT JOIN ex ON ex.investigation_id = d.investigation_id LEFT JOIN ev ON ev.execution_id = ex.id GROUP BY 1")
def list_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = view(spark, sf_dir, "customer").select(F.concat(F.lit("INV-"), (F.col("c_custkey") % 9).cast("string")).alias("investigation_id")).distinct()
    return reports.list_investigations(dumps, executions(spark, sf_dir), evidence(spark, sf_dir))


@query(f"WITH {_EX} SELECT execution_status, count(*) AS n FROM ex GROUP BY 1")
def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.execution_stats(executions(spark, sf_dir))


@query(f"WITH {_EX} SELECT round(100.0 * count(*) FILTER (execution_status = 'completed') / count(*) FILTER (execution_status IN ('completed', 'failed')), 1) AS success_rate FROM ex")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.success_rate(executions(spark, sf_dir))


@query(f"WITH {_EV}, {_EX} SELECT ex.investigation_id, ex.plugin_name, count(*) AS n, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low FROM ev JOIN ex ON ev.execution_id = ex.id WHERE execution_status = 'completed' GROUP BY 1, 2")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_overview(reports.scope(evidence(spark, sf_dir), executions(spark, sf_dir)))


_MALFIND = f"WITH {_AT}, {_EX}, run AS (SELECT investigation_id, max(id) AS id FROM ex WHERE execution_status = 'completed' AND plugin_name = 'windows.malfind' GROUP BY 1), h AS (SELECT a.investigation_id, coalesce(process, 'unknown') AS process, a.pid, coalesce(priv = '1', false) AS own FROM att a JOIN run r ON r.id = a.execution_id WHERE artifact_type = 'malfind' AND risk_level = 'high' AND j IS NOT NULL) "


@query(_MALFIND + "SELECT investigation_id, count(*) AS total, count(*) FILTER (own) AS private, count(*) FILTER (NOT own) AS mapped, count(DISTINCT (process, pid)) AS processes FROM h GROUP BY 1")
def malfind_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.malfind_breakdown(classify.parsed(evidence(spark, sf_dir)), executions(spark, sf_dir), F.col("attributes"))


@query(_MALFIND + ", c AS (SELECT investigation_id, process, pid, 'all' AS list, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT investigation_id, process, pid, 'private', count(*) FILTER (own) FROM h GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY investigation_id, list ORDER BY n DESC, process, pid) AS INT) AS rank FROM c WHERE n > 0) SELECT * FROM r WHERE rank <= 8")
def malfind_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.malfind_top(classify.parsed(evidence(spark, sf_dir)), executions(spark, sf_dir), F.col("attributes"))


@query(_CLASSIFY[: _CLASSIFY.rindex("SELECT id, CASE WHEN j IS NULL")] + ", refs AS (SELECT DISTINCT p.id, b.fam AS family, b.id AS ref_id FROM pts p JOIN ents a ON a.id = p.id JOIN ents b ON b.investigation_id = a.investigation_id AND b.kind = a.kind AND b.value = a.value AND b.fam <> a.fam WHERE p.corroborated AND (p.strong OR p.score >= 3)), n AS (SELECT *, row_number() OVER (PARTITION BY id, family ORDER BY ref_id) AS n FROM refs) SELECT id, family, ref_id FROM n WHERE n <= 3")
def corroboration_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir)
    return classify.corroboration_refs(classify.classify_evidence(rows), rows, 3)


@query(f"WITH {_EV}, {_EX} SELECT DISTINCT ex.investigation_id, plugin_name FROM ex JOIN ev ON ev.execution_id = ex.id")
def distinct_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.distinct_plugins(evidence(spark, sf_dir), executions(spark, sf_dir))


@query(f"WITH {_EV}, {_EX} SELECT DISTINCT ex.investigation_id, artifact_type FROM ex JOIN ev ON ev.execution_id = ex.id")
def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.distinct_types(evidence(spark, sf_dir), executions(spark, sf_dir))


@query("WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-04', DATE '2024-01-10', INTERVAL 1 DAY)) AS DATE) AS day) SELECT d.day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_trend(view(spark, sf_dir, "events").withColumnRenamed("ts", "created_at"), "2024-01-10")


@query(f"WITH {_EV}, {_EX}, r AS (SELECT DISTINCT i.investigation_id, p.plugin_name FROM ex i, (SELECT plugin_name FROM ex UNION SELECT 'windows.pstree') p), c AS (SELECT execution_id, count(*) AS n FROM ev GROUP BY 1) SELECT r.investigation_id, r.plugin_name, CASE WHEN ex.id IS NULL THEN 'UNAVAILABLE' WHEN coalesce(c.n, 0) > 0 THEN 'AVAILABLE' WHEN execution_status = 'completed' THEN 'RAN-EMPTY' ELSE 'UNAVAILABLE' END AS state, coalesce(c.n, 0) AS rows FROM r LEFT JOIN ex ON ex.investigation_id = r.investigation_id AND ex.plugin_name = r.plugin_name LEFT JOIN c ON c.execution_id = ex.id")
def assess_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = executions(spark, sf_dir)
    plugins = runs.select("plugin_name").distinct().union(spark.createDataFrame([("windows.pstree",)], "plugin_name string"))
    routes = runs.select("investigation_id").distinct().crossJoin(F.broadcast(plugins))  # one row a plugin
    return reports.assess_coverage(routes, runs, evidence(spark, sf_dir))


@query("SELECT date_trunc('minute', ts) AS ts, event_type AS description, string_agg(DISTINCT 'p' || CAST(user_id % 3 AS STRING), ',' ORDER BY 'p' || CAST(user_id % 3 AS STRING)) AS plugins, min(event_id) AS id FROM events GROUP BY 1, 2")
def dedup_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events").select(F.date_trunc("minute", "ts").alias("ts"), F.col("event_type").alias("description"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("plugin"), F.col("event_id").alias("id"))
    return reports.dedup_timeline(rows)


@query("WITH m AS (SELECT conv_id, turn, role, lag(role) OVER w AS prior, lag(turn) OVER w AS q FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, q AS question_id, turn AS answer_id FROM m WHERE role = 'assistant' AND prior = 'user'")
def pair_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pair_exchanges(view(spark, sf_dir, "conversations").withColumnRenamed("turn", "id"), "conv_id")


@query(f"WITH {_EV}, r AS (SELECT *, CASE plugin WHEN 'windows.netscan' THEN 1 WHEN 'windows.cmdline' THEN 2 ELSE 3 END AS place, row_number() OVER (PARTITION BY investigation_id, plugin ORDER BY CASE WHEN contains(artifact_value, 'proc1') THEN 0 ELSE 1 END, CASE risk_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, id) AS turn FROM ev WHERE plugin IN ('windows.netscan', 'windows.cmdline', 'windows.pslist')), s AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY turn, place) AS rank FROM r) SELECT investigation_id, id, CAST(rank AS INT) AS rank FROM s WHERE rank <= 30")
def fetch_by_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.fetch_by_plugins(evidence(spark, sf_dir), ["windows.netscan", "windows.cmdline", "windows.pslist"], 30, F.col("artifact_value").contains("proc1"))
    return found.select("investigation_id", "id", "rank")


@query("SELECT sha256(text) AS sha256_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def find_duplicate_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.find_duplicate_dumps(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256_hash")))


@query(f"WITH {_AT}, x AS (SELECT DISTINCT rip AS address FROM att WHERE rip IS NOT NULL) SELECT address, CASE WHEN starts_with(address, '10.1.') OR starts_with(address, '10.0.') THEN 'low' WHEN address = '127.0.0.1' THEN 'loop' ELSE 'ten' END AS name FROM x WHERE starts_with(address, '10.') OR address = '127.0.0.1'")
def match_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.parsed(evidence(spark, sf_dir).where("artifact_type = 'netscan'")).select(A.first_key(F.col("attributes"), "remote_ip").alias("address"))
    nets = spark.createDataFrame([(0, "low", "10.0.0.0/15"), (1, "ten", "10.9.9.9/8"), (2, "loop", "127.0.0.1"), (3, "bad", "300.1.1.1/8")], "position int, name string, cidr string")
    return networks.match_networks(rows, nets).select("address", "name")


@query("SELECT doc_id AS evidence_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents UNION ALL SELECT -1 - doc_id, 'stale' FROM documents WHERE doc_id % 11 = 0")
def index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), A.content_hash(F.col("text")).alias("content_hash"))
    old = docs.where("id % 5 <> 0").select(F.col("id").alias("evidence_id"), F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    gone = docs.where("id % 11 = 0").select((-1 - F.col("id")).alias("evidence_id"), "content_hash")
    return reports.index_delta(docs, old.union(gone))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), vec_id LIMIT 20")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = view(spark, sf_dir, "embeddings")
    query_vector = vectors.where("vec_id = 0").first().embedding
    return reports.vector_search(vectors, query_vector, 20).select("vec_id")


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), vec_id) AS rank FROM embeddings, q) SELECT query_id, CAST(rank AS INT) AS rank, vec_id FROM d WHERE rank <= 20")
def vector_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = view(spark, sf_dir, "embeddings")
    return reports.vector_search_all(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20)


from . import case_queries, extra_queries, state_queries  # noqa: E402, F401  register their queries here
