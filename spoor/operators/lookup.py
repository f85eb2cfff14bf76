"""Catalogues of any length as tables: equi-joins on names and ports, one automaton for all words.

The plan is the same for ten entries and ten thousand. An automaton finds all words that a text holds in one pass; it is sent to the tasks if the
catalogue's text is at most MOST_BYTES, else the words meet the texts by trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.state import text_index

from .answers import _words
from .catalogue import STRENGTHS, TRUNCATED, Tool

MOST_BYTES = 32 << 20


def tool_table(spark: SparkSession, tools: Iterable[Tool]) -> DataFrame:
    """(tool, kind, value, builtin), a row for each name, path, token, pattern and port."""
    rows = []
    for t in tools:
        for kind, values in (("process", t.processes), ("path", t.paths), ("token", t.tokens), ("pattern", [t.pattern] if t.pattern else []), ("port", t.ports)):
            rows += [(t.name, kind, str(v), t.builtin) for v in values]
    return spark.createDataFrame(rows, "tool string, kind string, value string, builtin boolean")


def name_keys(names: DataFrame, *carry: str) -> DataFrame:
    """(key, carry...) of names(name, carry...): what an observed name, trimmed and in lower case, is equal to if it matches: the name, or what is left of a cut one."""
    low = F.lower("name")
    cut = F.when(F.char_length(low) > TRUNCATED, F.transform(F.sequence(F.lit(TRUNCATED), F.char_length(low) - 1), lambda n: F.substring(low, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    return names.where("name <> ''").select(F.explode(F.array_distinct(F.concat(F.array(low), cut))).alias("key"), *carry).distinct()


def observed(name: Column) -> Column:
    return F.lower(F.trim(A.text_of(name)))


def holders(rows: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """rows(id, ...) with holder, a row for each holder of words(word, holder) of which the text, in lower case, holds a word; words are matched as they are. Null and empty texts and words match nothing."""
    words = words.where("word <> ''").select("word", "holder").distinct()
    size = words.agg(F.sum(F.octet_length("word") + F.octet_length("holder") + 100)).first()[0] or 0
    if size > MOST_BYTES:
        lower = words.where(F.lower("word") == F.col("word"))
        found = text_index.match(rows.select("id", text).distinct(), lower.select(F.col("word").alias("token")), [], text).join(lower, F.col("token") == F.col("word")).select("id", "holder").distinct()
        return rows.join(found, "id")
    automaton = ahocorasick.Automaton()
    for word, holder in words.collect():
        automaton.get(word, None) or automaton.add_word(word, set())
        automaton.get(word).add(holder)
    automaton.make_automaton()
    sent, empty = rows.sparkSession.sparkContext.broadcast(automaton), not len(automaton)

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        known = sent.value
        return texts.map(lambda t: sorted(set().union(*(h for _, h in known.iter(t)))) if t and not empty else [])

    return rows.select("*", F.explode(held(F.lower(text))).alias("holder"))


def searched(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """rows with holder, a row for each holder of patterns(word, holder) that occurs in the text, whatever the case."""
    known = [(re.compile(r.word, re.I), r.holder) for r in patterns.collect()]

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({h for p, h in known if p.search(t)}) if t else [])

    return rows.select("*", F.explode(held(F.col(text))).alias("holder"))


def match_tools(evidence: DataFrame, attributes: Column, catalogue: DataFrame, *, image: tuple[str, ...] = ("imagefilename",), command: tuple[str, ...] = ("args",), peer: str = "foreignaddr", peer_port: str = "foreignport") -> DataFrame:
    """(investigation_id, id, tool, strength, detail) for catalogue(tool, kind, value, builtin): processes, command lines by name, token or pattern, files on disk of tools that are
    not builtin, and connections to the ports of tools that the investigation shows otherwise. evidence has id, plugin and artifact_type; ids must be unique."""
    text = lambda *keys: A.text_of(A.first_key(attributes, *keys))
    kind, base = F.col("artifact_type"), ["investigation_id", "id"]
    of = lambda k: catalogue.where(F.col("kind") == k)
    words = lambda k: of(k).select(F.lower("value").alias("word"), F.col("tool").alias("holder"))
    names = text_index._small(name_keys(of("process").withColumnRenamed("value", "name"), "tool"))
    pid = text("pid")

    running = evidence.where(kind.isin("pslist", "psscan")).select(*base, observed(text(*image)).alias("key"), F.concat(F.lit("process "), text(*image), F.lit(" (PID "), pid, F.lit(") via "), F.col("plugin")).alias("detail"))
    runs = running.join(names, "key").select(*base, "tool", "detail")
    said = F.concat(text("process"), F.lit(" (PID "), pid, F.lit("): "), F.left(text(*command), F.lit(160)))
    lines = evidence.where(kind == "cmdline").select(*base, observed(text("process")).alias("key"), text(*command).alias("line"), F.concat(F.lit("command line for "), said).alias("by_name"), F.concat(F.lit("command line of "), said).alias("by_word"))
    named = lines.join(names, "key").select(*base, "tool", F.col("by_name").alias("detail"))
    worded = holders(lines, "line", words("token")).unionByName(searched(lines, "line", of("pattern").select(F.col("value").alias("word"), F.col("tool").alias("holder"))))
    worded = worded.select(*base, F.col("holder").alias("tool"), F.col("by_word").alias("detail")).distinct().join(named.select(*base, "tool").distinct(), [*base, "tool"], "left_anti")
    files = evidence.where(kind == "filescan").select(*base, text("name").alias("path"))
    there = holders(files, "path", words("path").join(of("path").where("builtin").select(F.col("tool").alias("holder")).distinct(), "holder", "left_anti"))
    there = there.select(*base, F.col("holder").alias("tool"), F.concat(F.lit("file present: "), F.col("path")).alias("detail"))
    seen = runs.unionByName(named).unionByName(worded).withColumn("strength", F.lit(STRENGTHS[0])).unionByName(there.withColumn("strength", F.lit(STRENGTHS[1])))
    peers = evidence.where((kind == "netscan") & A.first_key(attributes, peer_port).isNotNull())
    peers = peers.select(*base, text(peer_port).alias("value"), F.concat(F.lit("connection to "), text(peer), F.lit(":"), text(peer_port), F.lit(" ("), text("state"), F.lit(")")).alias("detail"))
    talks = peers.join(text_index._small(of("port").select("value", "tool").distinct()), "value").join(seen.select("investigation_id", "tool").distinct(), ["investigation_id", "tool"], "left_semi")
    return seen.unionByName(talks.withColumn("strength", F.lit(STRENGTHS[2])).select(*base, "tool", "detail", "strength")).select(*base, "tool", "strength", "detail")


def tool_evidence(matches: DataFrame) -> DataFrame:
    """(investigation_id, tool, kind, value): the distinct rows (kind id) and details of each tool, as a table, as a tool may have any number of them."""
    rows = matches.select("investigation_id", "tool", F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("value")), F.struct(F.lit("detail").alias("kind"), F.col("detail").alias("value")))).alias("e"))
    return rows.select("investigation_id", "tool", "e.kind", "e.value").distinct()


def with_security_product(rows: DataFrame, process: Column, products: DataFrame) -> DataFrame:
    """rows with product, the first of products(position, name, product) that the process name matches; null if none does."""
    keys = name_keys(products, "position", "product").groupBy("key").agg(F.min_by("product", "position").alias("product"))
    return rows.withColumn("key", observed(process)).join(text_index._small(keys), "key", "left").drop("key")


def route_questions(questions: DataFrame, routes: DataFrame) -> DataFrame:
    """questions(question, ...) with qid: the route of routes(place, qid, keyword) whose keywords found in the question weigh most, ten a word and one a character, the first of equals; null if none is found."""
    weight = F.size(F.split(F.trim("keyword"), r"\s+")) * 10 + F.char_length("keyword")
    known = routes.select("place", "qid", _words(F.col("keyword")).alias("word"), weight.alias("weight")).where("word <> ''").groupBy("word", "place", "qid").agg(F.sum("weight").alias("weight")).collect()
    automaton, names = ahocorasick.Automaton(), {r.place: r.qid for r in known}
    for r in known:
        automaton.get(r.word, None) or automaton.add_word(r.word, {})
        automaton.get(r.word)[r.place] = r.weight
    automaton.make_automaton()
    sent = questions.sparkSession.sparkContext.broadcast((automaton, names))

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        known, names = sent.value

        def route(text: str | None) -> str | None:
            sums: dict[int, int] = {}
            for places in {id(p): p for _, p in known.iter(text)}.values() if text and names else ():
                for place, w in places.items():
                    sums[place] = sums.get(place, 0) + w
            return names[min(sums, key=lambda p: (-sums[p], p))] if sums else None

        return texts.map(route)

    return questions.withColumn("qid", best(F.coalesce(_words(F.col("question")), F.lit(""))))
