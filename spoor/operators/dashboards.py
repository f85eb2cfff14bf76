"""Counts, totals and summaries of investigations, and their dated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import attributes as A

#: Words that put evidence into a group of findings.
FINDINGS = {
    "malware": ("malware", "malfind", "yara", "trojan", "ransomware", "backdoor", "rootkit", "injected"),
    "network": ("netscan", "netstat", "network", "connection", "socket", "listen", "connect", "remote"),
    "suspicious": ("suspicious", "suspect", "hidden", "unusual", "anomaly", "inject", "hollow", "unknown"),
}
HIGH_CONFIDENCE = 90
PROCESS_PLUGINS, SOCKET_PLUGINS = ("windows.pslist", "windows.psscan", "windows.pstree"), ("windows.netscan", "windows.netstat")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def recent_investigations(dumps: DataFrame, evidence: DataFrame, n: int = 5) -> DataFrame:
    """dumps(investigation_id, created_at): the newest n with their evidence rows."""
    newest = dumps.orderBy(F.desc("created_at"), F.desc("investigation_id")).limit(n)
    counts = count_by(evidence.join(F.broadcast(newest.select("investigation_id")), "investigation_id", "left_semi"), "investigation_id")  # n rows
    return newest.join(counts, "investigation_id", "left").select("investigation_id", "created_at", F.coalesce("n", F.lit(0)).alias("evidence_count"))


def dashboard(dumps: DataFrame, evidence: DataFrame, executions: DataFrame, messages: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of totals."""
    number = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    done, ended = F.count_if(F.col("execution_status") == "completed"), F.count_if(F.col("execution_status").isin("completed", "failed"))
    row = executions.agg(ended.alias("finished_executions"), F.when(ended > 0, F.round(100.0 * done / ended, 1)).otherwise(0.0).alias("success_rate"))
    for part in (dumps.agg(F.count_distinct("investigation_id").alias("investigations")), number(evidence, "evidence"), number(reports, "reports"), number(messages.where("role = 'user'"), "questions")):
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row


def unavailable_plugins(executions: DataFrame, evidence: DataFrame) -> DataFrame:
    """executions(id, investigation_id, plugin_name, execution_status, error): those not completed and without rows, with the reason."""
    empty = executions.where("execution_status <> 'completed'").join(evidence.select(F.col("execution_id").alias("id")), "id", "left_anti")
    reason = F.coalesce(A.error_summary(F.col("error"), 120), F.col("execution_status"))
    return empty.select("investigation_id", "plugin_name", reason.alias("reason")).distinct()


def evidence_summary(df: DataFrame, n: int = 30) -> DataFrame:
    """Per family its rows, mean confidence (halves to even), the first n ids and how many more there are."""
    totals = df.groupBy("investigation_id", "artifact_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("confidence_score"), 0).cast("int").alias("confidence"))
    first = df.withColumn("place", F.row_number().over(Window.partitionBy("investigation_id", "artifact_type").orderBy("id"))).where(F.col("place") <= n)
    ids = first.groupBy("investigation_id", "artifact_type").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))  # at most n each
    return totals.join(ids, ["investigation_id", "artifact_type"]).select("investigation_id", "artifact_type", "n", "confidence", "ids", F.greatest(F.col("n") - n, F.lit(0)).alias("more"))


def high_priority_findings(df: DataFrame, n: int = 20) -> DataFrame:
    """(investigation_id, finding, total, place, id): evidence in each of the groups it belongs to, the first n of a group."""
    text = F.lower(F.concat_ws(" ", "plugin", "artifact_type", "artifact_value"))
    has = lambda words: F.when(text.rlike("|".join(words)), True)
    groups = F.array_compact(F.array(F.when(F.col("confidence_score") >= HIGH_CONFIDENCE, "high_confidence"), *(F.when(has(words), name) for name, words in FINDINGS.items())))
    rows = df.dropDuplicates(["id"]).select("investigation_id", "id", F.explode(groups).alias("finding"))
    totals = rows.groupBy("investigation_id", "finding").agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("investigation_id", "finding").orderBy("id"))).where(F.col("place") <= n)
    return first.join(totals, ["investigation_id", "finding"]).select("investigation_id", "finding", "total", "place", "id")


def investigation_stats(executions: DataFrame, evidence: DataFrame) -> DataFrame:
    """executions(..., executed_at): plugins in all, completed and failed, evidence rows, and seconds from first to last run."""
    rows = count_by(evidence, "execution_id")
    runs = executions.join(rows, executions.id == rows.execution_id, "left")
    seconds = F.unix_timestamp(F.max("executed_at")) - F.unix_timestamp(F.min("executed_at"))
    state = lambda s: F.count_if(F.col("execution_status") == s).alias(s)
    return runs.groupBy("investigation_id").agg(F.count(F.lit(1)).alias("plugins"), state("completed"), state("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("evidence"), F.coalesce(seconds, F.lit(0)).alias("seconds"))


def investigation_status(executions: DataFrame) -> DataFrame:
    """executions(..., error): finished runs, and the error of the latest failed one that has any."""
    wrong = (F.col("execution_status") == "failed") & F.col("error").isNotNull()
    ended = F.count_if(F.col("execution_status").isin("completed", "failed"))
    return executions.groupBy("investigation_id").agg(
        F.count_if(F.col("execution_status") == "completed").alias("completed"), F.count_if(F.col("execution_status") == "failed").alias("failed"), (ended == F.count(F.lit(1))).alias("finished"), F.max_by("error", F.when(wrong, F.col("id"))).alias("error")
    )


def with_progress(df: DataFrame) -> DataFrame:
    """df(done, total, seconds) with percent and the seconds that the rest takes at the mean pace."""
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.floor(F.col("done") * 100 / F.col("total")))).otherwise(0)
    rest = F.when(F.col("done") > 0, F.round(F.col("seconds") / F.col("done") * F.greatest(F.col("total") - F.col("done"), F.lit(0)), 1))
    return df.withColumns({"percent": percent.cast("int"), "eta_seconds": rest})


def describe_event(plugin: Column, attributes: Column) -> Column:
    """One line on a process start or a connection; what is missing shows as None."""
    a = lambda key, other="None": F.coalesce(A.first_key(attributes, key), F.lit(other))
    full = lambda key, other: F.coalesce(F.nullif(A.first_key(attributes, key), F.lit("")), F.lit(other))
    start = F.concat(F.lit("process started: "), full("imagefilename", "unknown"), F.lit(" (PID "), a("pid"), F.lit(", PPID "), a("ppid"), F.lit(")"))
    peer = F.concat(F.lit("connection "), full("proto", ""), F.lit(" "), a("localaddr"), F.lit(":"), a("localport"), F.lit(" -> "), a("foreignaddr"), F.lit(":"), a("foreignport"), F.lit(" ["), full("state", "n/a"), F.lit("] (PID "), a("pid"), F.lit(")"))
    return F.when(plugin.isin(*PROCESS_PLUGINS), start).when(plugin.isin(*SOCKET_PLUGINS), peer).otherwise(F.concat(plugin, F.lit(" record (PID "), a("pid"), F.lit(")")))


def timeline_events(scoped: DataFrame, attributes: Column) -> DataFrame:
    """scoped(..., plugin, execution_status): the dated rows of completed process and socket runs, as (investigation_id, ts, description, plugin, id)."""
    raw = F.when(F.col("plugin").isin(*PROCESS_PLUGINS), A.first_key(attributes, "createtime")).otherwise(A.first_key(attributes, "created"))
    rows = scoped.where(F.col("plugin").isin(*PROCESS_PLUGINS, *SOCKET_PLUGINS) & (F.col("execution_status") == "completed"))
    return rows.select("investigation_id", A.parse_event_ts(raw).alias("ts"), describe_event(F.col("plugin"), attributes).alias("description"), "plugin", "id").where("ts is not null")


def overview_with_totals(evidence: DataFrame, executions: DataFrame) -> DataFrame:
    """(investigation_id, plugin_name, level, rows, high, medium, rank) of each plugin's last completed execution: level plugin, investigation or all, in one pass.

    rank orders an investigation's plugins by high, then medium rows, most first, then by name; totals have none. A plugin whose last completed execution has no rows is not listed."""
    last = executions.where("execution_status = 'completed'").groupBy("investigation_id", "plugin_name").agg(F.max("id").alias("execution_id"))
    rows = evidence.select("execution_id", "risk_level").groupBy("execution_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("risk_level") == "high").alias("high"), F.count_if(F.col("risk_level") == "medium").alias("medium"))
    sums = rows.join(last, "execution_id").rollup("investigation_id", "plugin_name").agg(F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in ("rows", "high", "medium")))
    level = F.when(F.col("g") == 0, "plugin").when(F.col("g") == 1, "investigation").otherwise("all")
    order = Window.partitionBy("investigation_id", "g").orderBy(F.desc("high"), F.desc("medium"), "plugin_name")
    return sums.withColumn("rank", F.when(F.col("g") == 0, F.row_number().over(order))).select("investigation_id", "plugin_name", level.alias("level"), "rows", "high", "medium", "rank")
