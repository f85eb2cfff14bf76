"""Ranked evidence for an investigator's question: lookups, derived suspicion, samples, pinned rows.

Limits count within an investigation, by row_number, so one job answers for all investigations at once.
Rows without JSON never match on attributes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import attributes as A

#: Families that describe processes, and those a general sample starts with.
PROCESS_FAMILIES = ("pslist", "pstree", "cmdline", "malfind")
IDENTITY_KEYS = ("imagefilename", "name", "process", "owner")
#: Places that users can write to.
SUSPICIOUS_PATHS = ("\\windows\\temp\\", "\\temp\\", "\\appdata\\", "\\users\\public\\", "\\programdata\\", "\\recycle.bin\\", "$recycle.bin", "\\downloads\\", "\\desktop\\", "\\tmp\\", "/dev/shm")
#: Parts of commands that attackers use.
SUSPICIOUS_COMMANDS = (
    "powershell", "-enc ", "encodedcommand", "frombase64string", "downloadstring", "invoke-expression", " iex ", "bypass", "certutil", "-urlcache", "mshta", "regsvr32", "rundll32", "wmic", "bitsadmin", "-transfer", "cscript",
    "wscript", "netsh", "schtasks", ".ps1", ".vbs", ".bat", "cmd /c", "/c whoami", "-e ", "malware", "mimikatz",
)
#: Ports of known tools, and addresses that are no peer.
SUSPICIOUS_PORTS = ("1337", "4444", "5555", "6666", "6667", "9000", "9050", "31337", "12345")
NO_PEER = ("0.0.0.0", "::", "127.0.0.1", "localhost")


def _any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, tokens)))  # one pass over one evaluation of text


def _attribute(key: str, value: str = "artifact_value") -> Column:
    return F.get_json_object(value, f"$.{key}")


def derive_suspicion(family: Column, attributes: Column) -> Column:
    """Names of the signals that the attributes themselves show; empty without attributes."""
    value = lambda *keys: F.lower(F.concat_ws(" ", *(F.coalesce(A.first_key(attributes, k), F.lit("")) for k in keys)))
    everything = F.lower(F.concat_ws(" ", F.map_values(attributes)))
    peer, port = A.text_of(A.first_key(attributes, "foreignaddr")), F.trim(A.text_of(A.first_key(attributes, "foreignport")))
    net = family == "netscan"
    flags = F.array_compact(
        F.array(
            F.when(family == "malfind", "injected-memory-region"),
            F.when((family == "cmdline") & _any_of(everything, SUSPICIOUS_COMMANDS), "suspicious-command"),
            F.when(family.isin("pslist", "pstree", "cmdline") & _any_of(value("path", "imagefilename", "name"), SUSPICIOUS_PATHS), "executable-in-suspicious-location"),
            F.when((family == "dlllist") & _any_of(value("name"), SUSPICIOUS_PATHS), "module-in-suspicious-location"),
            F.when(net & (peer != "") & ~peer.isin(*NO_PEER), "external-network-connection"),
            F.when(net & port.isin(*SUSPICIOUS_PORTS), F.concat(F.lit("connection-to-port-"), port)),
        )
    )
    return F.when(F.size(attributes) > 0, flags).otherwise(F.array().cast("array<string>"))


def identity(attributes: Column) -> Column:
    """(pid, process_name): the first non-blank name without its last slash."""
    named = F.coalesce(*(F.when(F.trim(A.first_key(attributes, k)) != "", A.first_key(attributes, k)) for k in IDENTITY_KEYS))
    return F.struct(A.first_key(attributes, "pid").alias("pid"), F.regexp_replace(named, r"[\\/]$", "").alias("process_name"))


def evidence_document(df: DataFrame, attributes: Column, flags: Column) -> Column:
    """Lines of plugin, type, risk, flags, every attribute with a value, and what an injected region is."""
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))
    entries = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull())
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", line("plugin", df["plugin"]), line("type", df["artifact_type"]), line("risk", df["risk_level"]), line("flags", F.array_join(flags, ", ")), pairs, line("region", A.region_kind(df["artifact_type"], attributes)))


def _first(df: DataFrame, k: int | None, *order: Column | str) -> DataFrame:
    """With rank by order within an investigation; the first k of each, or all."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("investigation_id").orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def by_execution(df: DataFrame, execution: int) -> DataFrame:
    return df.where(F.col("execution_id") == execution).orderBy("id")


def by_type(df: DataFrame, family: str) -> DataFrame:
    return df.where(F.col("artifact_type") == family).orderBy("id")


def by_investigation(df: DataFrame, investigation: str) -> DataFrame:
    return df.where(F.col("investigation_id") == investigation).orderBy("id")


def executions_by(executions: DataFrame, *, investigation: str | None = None, plugin: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first."""
    for wanted, name in ((investigation, "investigation_id"), (plugin, "plugin_name"), (status, "execution_status")):
        if wanted is not None:
            executions = executions.where(F.col(name) == wanted)
    return executions.orderBy(F.desc("id"))


def fetch_pid(df: DataFrame, pid: str, k: int | None = None) -> DataFrame:
    """Rows whose pid or processid is that text."""
    return _first(df.where((_attribute("pid") == pid) | (_attribute("processid") == pid)), k, "id")


def fetch_tid(df: DataFrame, tid: str, k: int | None = None) -> DataFrame:
    """Rows of that thread, or handles of type Thread with that value."""
    own = F.lit(False)
    for key in ("tid", "threadid", "thread"):
        own = own | F.coalesce(_attribute(key) == tid, F.lit(False))
    handle = (F.col("artifact_type") == "handles") & (F.lower(_attribute("type")) == "thread") & (_attribute("handlevalue") == tid)
    return _first(df.where(own | F.coalesce(handle, F.lit(False))), k, "id")


def fetch_process_names(df: DataFrame, names: list[str], k: int | None = None) -> DataFrame:
    """Process families' rows named so (exact) before those that hold a name anywhere; each row once, in one scan."""
    wanted = [n.lower() for n in names]
    rows = df.where(F.col("artifact_type").isin(*PROCESS_FAMILIES, "netscan", "handles", "dlllist"))
    exact = F.lit(False)
    for key in IDENTITY_KEYS:
        exact = exact | F.coalesce(F.lower(_attribute(key)).isin(wanted), F.lit(False))
    rows = rows.where(_any_of(F.lower("artifact_value"), tuple(wanted))).withColumn("exact_match", exact)
    return _first(rows, k, F.desc("exact_match"), "id")


def fetch_by_ids(df: DataFrame, ids: list[int]) -> DataFrame:
    """In the caller's order."""
    return df.where(F.col("id").isin(ids)).withColumn("position", F.array_position(F.array(*(F.lit(i).cast("long") for i in ids)), F.col("id").cast("long"))).orderBy("position")


def merge_pinned(pinned: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """pinned, ranked (investigation_id, id, rank): pinned ones first, each id once, k an investigation."""
    both = pinned.select("investigation_id", "id", "rank", F.lit(0).alias("source")).unionByName(ranked.select("investigation_id", "id", "rank", F.lit(1).alias("source")))
    best = both.groupBy("investigation_id", "id").agg(F.min(F.struct("source", "rank")).alias("best"))
    return _first(best, k, "best", "id").select("investigation_id", "id", "rank", (F.col("best.source") == 0).alias("pinned"))


def fetch_suspicious(df: DataFrame, attributes: Column, k: int) -> DataFrame:
    """High and medium rows of process families and sockets, and rows with derived flags; process families first, then risk, then id."""
    process = F.col("artifact_type").isin(*PROCESS_FAMILIES)
    risk = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    rows = df.where(process | (F.col("artifact_type") == "netscan")).withColumn("suspicious_flags", derive_suspicion(F.col("artifact_type"), attributes))
    rows = rows.where((risk < 2) | (F.size("suspicious_flags") > 0))
    return _first(rows, k, (~process).cast("int"), risk, "id")


def fetch_types(df: DataFrame, families: list[str], k: int | None = None) -> DataFrame:
    return _first(df.where(F.col("artifact_type").isin(families)), k, "id")


def fetch_general(df: DataFrame, k: int, primary: tuple[str, ...] = (*PROCESS_FAMILIES, "netscan")) -> DataFrame:
    """Primary families by id, then the others."""
    return _first(df, k, (~F.col("artifact_type").isin(*primary)).cast("int"), "id")


def to_match(df: DataFrame, attributes: Column) -> DataFrame:
    """id, document, identity, flags (persisted ones in stored_flags, if that column exists, before derived ones), score."""
    derived = derive_suspicion(F.col("artifact_type"), attributes)
    flags = F.array_distinct(F.concat(F.coalesce("stored_flags", F.array().cast("array<string>")), derived)) if "stored_flags" in df.columns else derived
    rows = df.withColumn("suspicious_flags", flags)
    who = identity(attributes)
    return rows.select("investigation_id", "id", evidence_document(rows, attributes, F.col("suspicious_flags")).alias("document"), who["pid"].alias("pid"), who["process_name"].alias("process_name"), "risk_level", "suspicious_flags", (F.col("confidence_score") / 100).alias("score"))


def choose_source(vector: DataFrame, tabular: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(question_id, id, score): a question's vector hits if the best of them reaches the threshold, else its tabular rows."""
    good = vector.groupBy("question_id").agg(F.max("score").alias("best")).where(F.col("best") >= threshold).select("question_id")
    semantic = vector.join(good, "question_id", "left_semi").withColumn("source", F.lit("semantic"))
    return semantic.unionByName(tabular.join(good, "question_id", "left_anti").withColumn("source", F.lit("authoritative")))


def chat_history(messages: DataFrame, investigation: object, session: object = None, by: str = "investigation_id") -> DataFrame:
    rows = messages.where(F.col(by) == investigation)
    return (rows if session is None else rows.where(F.col("session_id") == session)).orderBy("id")


def reports(df: DataFrame, investigation: str | None = None) -> DataFrame:
    """Newest first."""
    rows = df if investigation is None else df.where(F.col("investigation_id") == investigation)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def upsert_documents(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One document per document_id ("ev-" and the evidence id); the batch's replace stored ones, so a rerun changes nothing."""
    new = batch.dropDuplicates(["document_id"])
    return stored.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_index_state(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("evidence_id"), "evidence_id", "left_anti")


def distinct_plugins(evidence: DataFrame, executions: DataFrame) -> DataFrame:
    """(investigation_id, plugin_name) of the executions that have rows."""
    return executions.join(evidence.select(F.col("execution_id").alias("id")).distinct(), "id", "left_semi").select("investigation_id", "plugin_name").distinct()


def distinct_types(evidence: DataFrame, executions: DataFrame) -> DataFrame:
    """(investigation_id, artifact_type) of the rows of known executions."""
    pairs = evidence.groupBy("execution_id", "artifact_type").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(executions.select(F.col("id").alias("execution_id"), "investigation_id"), "execution_id").select("investigation_id", "artifact_type").distinct()
