"""Risk classification: rule flags per row, corroboration by an entity join, and a score.

Corroboration never compares rows with rows: an entity's set of families (at most one entry a family) is computed once, so a
busy process id with millions of rows is one row on the build side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions.attributes import basename, cmd_token, first_key, looks_like_path, norm_path, normalize_pid, stem, with_attributes

from spoor.state.store import written

from . import rules

RULE_VERSION, MIN_FAMILIES, MIN_FAMILIES_MALFIND = "1.0", 2, 1
ESCALATION, CORROBORATION, MEDIUM_FROM, HIGH_FROM = 4, 2, 3, 6


def parsed(evidence: DataFrame) -> DataFrame:
    """evidence(id, investigation_id, artifact_type, artifact_value, ...) with attributes."""
    return with_attributes(evidence)


def entities(family: Column, a: Column) -> Column:
    """The distinct entity keys of a row, as (kind, value); a connection's value is ip, a tab, and the port."""
    key = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    name = F.lower(F.trim(first_key(a, "name", "processname", "imagename")))
    command = first_key(a, "cmd", "commandline")
    token = cmd_token(command)
    is_cmd = family == "cmdline"
    token_path = F.when(is_cmd & command.isNotNull() & looks_like_path(token), norm_path(token))
    path = F.when(is_cmd, token_path).when(family.isin("pslist", "filescan", "dlllist"), norm_path(first_key(a, "path", "name")))
    token_name = F.when(is_cmd, basename(F.coalesce(norm_path(token), token)))
    ip, port = F.lower(F.trim(first_key(a, "remote_ip", "remoteip"))), F.trim(first_key(a, "remote_port", "remoteport"))
    link = F.when((family == "netscan") & (ip != ""), F.concat(ip, F.lit("\t"), F.coalesce(port, F.lit(""))))
    reg = F.when(family.isin("printkey", "registry"), norm_path(first_key(a, "key", "path", "hive", "name")))
    full = lambda c: F.when(c != "", c)
    found = [key("pid", normalize_pid(first_key(a, "pid", "processid"))), key("name", full(name)), key("name", full(token_name)), key("path", path), key("path_stem", stem(path)), key("conn", link), key("reg", reg)]
    return F.array_distinct(F.array_compact(F.array(*found)))


def judged(evidence: DataFrame) -> DataFrame:
    """evidence with usable, hits and entities, all from one parse of a row's attributes, or from those that normalize_evidence stored."""
    rows = evidence if "attributes" in evidence.columns else parsed(evidence)
    kind, a = F.col("artifact_type"), F.col("attributes")
    return rows.select(*evidence.columns, a.isNotNull().alias("usable"), rules.matched(kind, a).alias("hits"), F.when(a.isNotNull(), entities(kind, a)).alias("entities"))


def entity_edges(rows: DataFrame) -> DataFrame:
    """(investigation_id, id, family, kind, value) of evidence or of judged rows, one row per row and entity."""
    if "entities" not in rows.columns:
        rows = written(judged(rows), "judged")  # edges are used more than once
    return rows.where("id is not null and usable").select("investigation_id", "id", F.col("artifact_type").alias("family"), F.explode("entities").alias("e")).select("investigation_id", "id", "family", "e.kind", "e.value")


def correlate(rows: DataFrame) -> DataFrame:
    """(id, families): the other families that share an entity with a row, sorted; rows without any are left out."""
    edges = entity_edges(rows)
    key = ["investigation_id", "kind", "value"]
    shared = edges.groupBy(*key).agg(F.collect_set("family").alias("with")).where(F.size("with") > 1)
    near = edges.join(shared, key).select("id", F.explode(F.array_except("with", F.array("family"))).alias("other"))
    return near.groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("families"))


def scored(rows: DataFrame) -> DataFrame:
    """Judged rows with families, as correlate gives them or null: with corroborated, score, severity, indicators and reasons."""
    known = F.col("artifact_type").isin(rules.families())
    least = F.when(F.col("artifact_type") == "malfind", MIN_FAMILIES_MALFIND).otherwise(MIN_FAMILIES)
    rows = rows.withColumn("families", F.coalesce("families", F.array().cast("array<string>")))
    rows = rows.withColumn("corroborated", F.coalesce(F.col("usable") & known & (F.size("families") >= least), F.lit(False)))
    base = F.aggregate("hits", F.lit(0), lambda s, h: s + h["weight"])
    strong = F.exists("hits", lambda h: h["strong"])
    boost = F.when(strong & F.col("corroborated"), ESCALATION).when(F.col("corroborated"), CORROBORATION).otherwise(0)
    rows = rows.withColumn("score", F.when(F.col("usable") & known, base + boost).otherwise(0)).withColumn("strong", strong)
    level = F.when(~F.col("usable"), "unknown").when(F.coalesce(~known, F.lit(True)), "insufficient-evidence").when((F.col("score") >= HIGH_FROM) & F.col("strong") & F.col("corroborated"), "high").when(F.col("strong") | (F.col("score") >= MEDIUM_FROM), "medium").otherwise("low")
    rows = rows.withColumn("severity", level).withColumn("indicators", F.transform("hits", lambda h: h["code"])).withColumn("reasons", F.transform("hits", lambda h: h["reason"]))
    return rows.drop("strong")


def classify_evidence(evidence: DataFrame) -> DataFrame:
    """evidence with severity, score, indicators, reasons, corroborated and families.

    A row is judged once: what its attributes say is written to the shared folder, and the entity join and the score both read it there, the join its
    id, family and entities only."""
    rows = written(judged(evidence), "judged")
    found = scored(rows.join(correlate(rows), "id", "left"))
    return found.select(*evidence.columns, "severity", "score", "indicators", "reasons", "corroborated", "families")


def classify_incremental(evidence: DataFrame) -> DataFrame:
    """Only the rows without a risk level, judged against all rows, with the rules' version."""
    return classify_evidence(evidence).where("risk_level is null").withColumn("rule_version", F.lit(RULE_VERSION))


def corroboration_refs(classified: DataFrame, evidence: DataFrame, max_per_family: int) -> DataFrame:
    """(id, family, ref_id): for each corroborated medium or high row, the max_per_family rows of least id of every other family
    that shares an entity with it.

    An entity's rows are cut to that many a family before the join, which loses none of a row's: the least of the union are
    among the least of each part. So a busy entity meets a row with families times max_per_family rows at most."""
    edges = entity_edges(evidence)
    key = ["investigation_id", "kind", "value"]
    least = Window.partitionBy(*key, "family").orderBy("id")
    other = edges.withColumn("n", F.row_number().over(least)).where(F.col("n") <= max_per_family).select(*key, F.col("id").alias("ref_id"), F.col("family").alias("ref_family"))
    mine = edges.join(classified.where("corroborated and severity in ('medium', 'high')").select("id"), "id", "left_semi")
    refs = mine.join(other, key).where("ref_family <> family").select("id", F.col("ref_family").alias("family"), "ref_id").distinct()
    return refs.withColumn("n", F.row_number().over(Window.partitionBy("id", "family").orderBy("ref_id"))).where(F.col("n") <= max_per_family).drop("n")
