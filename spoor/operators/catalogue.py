"""Known tools, security products, signatures and networks named in questions.

Catalogues are short lists given by the caller. They become expressions in the plan, so a scan meets all entries at once and
nothing is joined or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import attributes as A

from . import networks

#: Fixed value: the width from which on a process name may be cut off.
TRUNCATED = 14
#: From strongest to weakest.
STRENGTHS = ("executed", "on-disk", "network")


@dataclass(frozen=True)
class Tool:
    """What identifies a tool; paths say nothing about a builtin, and ports only back up what else was found."""

    name: str
    processes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()
    pattern: str = ""
    ports: tuple[int, ...] = ()
    builtin: bool = False


def process_name_matches(observed: Column, candidate: str) -> Column:
    """Equal but for case, or at least 14 characters that the candidate starts with."""
    name = F.lower(F.trim(A.text_of(observed)))
    return (name == candidate.lower()) | ((F.char_length(name) >= TRUNCATED) & F.lit(candidate.lower()).startswith(name))


def _either(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | F.coalesce(c, F.lit(False))
    return found


def match_tools(evidence: DataFrame, attributes: Column, tools: list[Tool], *, image: tuple[str, ...] = ("imagefilename",), command: tuple[str, ...] = ("args",), peer_port: str = "foreignport") -> DataFrame:
    """(investigation_id, id, tool, strength, detail): processes, command lines, files on disk, and ports of tools found otherwise."""
    family, pid = F.col("artifact_type"), A.text_of(A.first_key(attributes, "pid"))
    running, process, args, path = (A.text_of(A.first_key(attributes, *keys)) for keys in (image, ("process",), command, ("name",)))
    port = A.first_key(attributes, peer_port)

    def hit(tool: Tool) -> Column:
        runs = family.isin("pslist", "psscan") & _either([process_name_matches(running, p) for p in tool.processes])
        asked = [process_name_matches(process, p) for p in tool.processes] + [F.lower(args).contains(t) for t in tool.tokens]
        said = (family == "cmdline") & _either(asked + ([args.rlike(f"(?i){tool.pattern}")] if tool.pattern else []))
        there = (family == "filescan") & F.lit(not tool.builtin) & _either([F.lower(path).contains(p) for p in tool.paths])
        talks = (family == "netscan") & F.coalesce(port.isin([str(p) for p in tool.ports]), F.lit(False))
        detail = F.when(family == "cmdline", F.concat(F.lit("command line of "), process, F.lit(" (PID "), pid, F.lit("): "), F.left(args, F.lit(160))))
        detail = detail.when(family == "filescan", F.concat(F.lit("file present: "), path)).when(family == "netscan", F.concat(F.lit("connection to port "), port))
        detail = detail.otherwise(F.concat(F.lit("process "), running, F.lit(" (PID "), pid, F.lit(")")))
        strength = F.when(runs | said, STRENGTHS[0]).when(there, STRENGTHS[1]).when(talks, STRENGTHS[2])
        return F.when(strength.isNotNull(), F.struct(F.lit(tool.name).alias("tool"), strength.alias("strength"), detail.alias("detail")))

    rows = evidence.where(family.isin("pslist", "psscan", "cmdline", "filescan", "netscan"))
    hits = rows.select("investigation_id", "id", F.explode(F.array_compact(F.array(*map(hit, tools)))).alias("h")).select("investigation_id", "id", "h.*")
    found = hits.where(F.col("strength") != STRENGTHS[2])
    known = found.select("investigation_id", "tool").distinct()
    return found.unionByName(hits.where(F.col("strength") == STRENGTHS[2]).join(known, ["investigation_id", "tool"], "left_semi"))


def summarize_tools(matches: DataFrame) -> DataFrame:
    """Per tool its strongest sign, distinct rows and distinct details."""
    rank = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength"))
    found = matches.groupBy("investigation_id", "tool").agg(F.min(rank).alias("r"), F.count_distinct("id").alias("n_rows"), F.count_distinct("detail").alias("n_details"), F.min("id").alias("first_id"))
    return found.select("investigation_id", "tool", F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("r").cast("int")).alias("strength"), "n_rows", "n_details", "first_id").orderBy("investigation_id", "r", "tool")


def security_product(process: Column, products: list[tuple[str, str]]) -> Column:
    """The first product of the list whose process name matches; null if none does."""
    return F.coalesce(*(F.when(process_name_matches(process, name), product) for name, product in products))


def assess_signatures(hits: DataFrame, products: list[tuple[str, str]]) -> DataFrame:
    """hits(investigation_id, rule, process, data): per rule all hits, those in a security product, those of low information, and those left that corroborate."""
    rows = hits.withColumn("product", security_product(F.col("process"), products)).withColumn("low", A.is_low_information(F.col("data")))
    rows = rows.withColumn("rule", F.when(F.col("rule") != "", F.col("rule")).otherwise("unnamed rule"))
    backs = F.col("product").isNull() & ~F.col("low")
    return rows.groupBy("investigation_id", "rule").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("product").isNotNull()).alias("in_product"), F.count_if(F.col("product").isNull() & F.col("low")).alias("low_information"), F.count_if(backs).alias("corroborating"),
        F.array_join(F.sort_array(F.collect_set("product")), ",").alias("products"), F.count_distinct(F.when(backs & (F.col("process") != ""), F.col("process"))).alias("processes"),
    )


def signature_ceiling(rules: DataFrame) -> DataFrame:
    """25 where no rule of an investigation is corroborated, 50 where some aren't, else null."""
    alone = F.col("corroborating") == 0
    return rules.groupBy("investigation_id").agg(F.when(F.bool_and(alone), 25).when(F.bool_or(alone), 50).alias("ceiling"))


def networks_in_text(questions: DataFrame) -> DataFrame:
    """questions(question, ...) with a row for each range, then each bare IPv4 address, that the text names: (position, cidr). What is no range or address is left out."""
    address = r"\d{1,3}(?:\.\d{1,3}){3}"
    span = rf"\b(?:{address}/\d{{1,2}}|[0-9a-fA-F:]{{2,}}:[0-9a-fA-F:]*/\d{{1,3}})\b"
    ranges = F.regexp_extract_all("question", F.lit(span), F.lit(0))
    bare = F.regexp_extract_all(F.regexp_replace("question", span, " "), F.lit(rf"\b{address}\b"), F.lit(0))
    return questions.select("*", F.posexplode(F.filter(F.concat(ranges, bare), lambda c: networks.network(c).isNotNull())).alias("position", "cidr"))


def summarize_network_scan(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """rows(id, address, state), matched(address, name): per matched address its network, rows and states."""
    per = rows.groupBy("address").agg(F.count_distinct("id").alias("n_rows"), F.min("id").alias("first_id"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"))
    return matched.select("address", "name").join(per, "address")
