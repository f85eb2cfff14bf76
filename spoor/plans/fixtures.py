"""Case tables derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVIDENCE_SQL = """
SELECT id, investigation_id, execution_id, plugin, substr(plugin, 9) AS artifact_type, artifact_value, risk_level, 100 AS confidence_score, created_at FROM (
SELECT event_id AS id, 'INV-' || CAST(user_id % 7 AS STRING) AS investigation_id, user_id % 7 * 9 + event_id % 9 AS execution_id, ts AS created_at,
  CASE event_id % 9 WHEN 0 THEN 'windows.pslist' WHEN 1 THEN 'windows.cmdline' WHEN 2 THEN 'windows.filescan' WHEN 3 THEN 'windows.netscan' WHEN 4 THEN 'windows.malfind'
    WHEN 5 THEN 'windows.dlllist' WHEN 6 THEN 'windows.handles' WHEN 7 THEN 'windows.printkey' ELSE 'windows.info' END AS plugin,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE event_id % 9
    WHEN 0 THEN '{"pid": ' || u || ', "name": "proc' || d || '.exe", "path": ' || CASE k % 4 WHEN 0 THEN '"c:/users/u/appdata/proc' || d || '.exe"' WHEN 1 THEN '"c:/windows/system32/svchost.exe"' WHEN 2 THEN '"c:/temp/other.exe"' ELSE 'null' END || '}'
    WHEN 1 THEN '{"pid": ' || u || ', "cmd": "' || CASE k % 6 WHEN 0 THEN 'c:/temp/proc' || d || '.exe -enc abc' WHEN 1 THEN 'whoami /all' WHEN 2 THEN 'nc 10.0.0.' || d || ':4444' WHEN 3 THEN 'c:/windows/system32/cmd.exe' WHEN 4 THEN 'run net user' ELSE '' END || '"}'
    WHEN 2 THEN '{"name": "/users/u/downloads/file' || d || CASE k % 3 WHEN 0 THEN '.exe' WHEN 1 THEN '.exe.txt' ELSE '.pdf' END || '"}'
    WHEN 3 THEN '{"pid": ' || u || ', "remote_ip": "' || CASE k % 5 WHEN 0 THEN '127.0.0.1' ELSE '10.' || d || '.' || CAST(event_id % 250 AS STRING) || '.7' END || '", "remote_port": 443, "local_port": ' || CAST(1000 + k AS STRING) || ', "state": "' || CASE k % 2 WHEN 0 THEN 'LISTENING' ELSE 'ESTABLISHED' END || '"}'
    WHEN 4 THEN '{"pid": ' || u || ', "process": "proc' || d || '.exe", "protection": "' || CASE k % 2 WHEN 0 THEN 'PAGE_EXECUTE_READWRITE' ELSE 'PAGE_READONLY' END || '", "privatememory": ' || CAST(k % 2 AS STRING) || '}'
    WHEN 5 THEN '{"pid": ' || u || ', "name": "' || CASE k % 2 WHEN 0 THEN 'c:/temp/' ELSE 'c:/windows/system32/' END || 'lib' || d || '.dll"}'
    WHEN 6 THEN '{"pid": ' || u || ', "granted_access": ' || CASE k % 3 WHEN 0 THEN '"0x1fffff"' WHEN 1 THEN '4' ELSE '"none"' END || '}'
    WHEN 7 THEN '{"key": "software' || b || 'microsoft' || b || 'windows' || b || 'currentversion' || b || CASE k % 2 WHEN 0 THEN 'run' || b ELSE 'fonts' || b END || 'x' || d || '"}'
    ELSE CASE k % 2 WHEN 0 THEN 'free text ' || u ELSE '{"pid": ' || u || ', "name": "info"}' END END AS artifact_value
FROM (SELECT event_id, user_id, ts, CAST(user_id AS STRING) AS u, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS STRING) AS d, chr(92) || chr(92) AS b FROM events) e) f
"""

EXECUTIONS_SQL = """
SELECT DISTINCT user_id % 7 * 9 + event_id % 9 AS id, 'INV-' || CAST(user_id % 7 AS STRING) AS investigation_id,
  CASE event_id % 9 WHEN 0 THEN 'windows.pslist' WHEN 1 THEN 'windows.cmdline' WHEN 2 THEN 'windows.filescan' WHEN 3 THEN 'windows.netscan' WHEN 4 THEN 'windows.malfind'
    WHEN 5 THEN 'windows.dlllist' WHEN 6 THEN 'windows.handles' WHEN 7 THEN 'windows.printkey' ELSE 'windows.info' END AS plugin_name,
  CASE (user_id % 7 * 9 + event_id % 9) % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS execution_status
FROM events
"""

#: A second part of the executions: those of a plugin that has no rows.
EMPTY_EXECUTIONS_SQL = """
SELECT DISTINCT 63 + user_id % 7 AS id, 'INV-' || CAST(user_id % 7 AS STRING) AS investigation_id, 'windows.pstree' AS plugin_name,
  CASE user_id % 7 % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS execution_status
FROM events
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVIDENCE_SQL.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`"))


def empty_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EMPTY_EXECUTIONS_SQL.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EXECUTIONS_SQL.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`"))
