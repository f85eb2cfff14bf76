"""Evidence for a table of questions, each from the plugins it is routed to, else by the first kind of thing that it names.

Rows are ranked once for each thing asked for (a process id in an investigation, a plugin, ...), not for each question, so questions
that ask alike share the work; only their first k rows meet the questions. Names and other words are looked for by trigrams, so rows meet only the words whose rarest
trigram they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.state import text_index
from spoor.state.store import written

from . import answers, reports, retrieval

#: From the most to the least specific.
ROUTES = ("pid", "tid", "names", "suspicious", "types", "general")


def _top(rows: DataFrame, k: int, keys: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _routed(asked: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(question_id, investigation_id, id, rank) for asked(question_id, investigation_id, plugins, entities): of each plugin first the rows that hold one of
    the entities, then the others, both by risk and id; a row of each plugin in turn.

    A plugin's order without entities is one of 2 k rows, whoever asks: fewer than k rows that hold an entity leave k others among them."""
    keys = ["investigation_id", "plugin"]
    ask = asked.select("investigation_id", "plugins", "entities").distinct()
    per = ask.select("*", F.posexplode(F.array_distinct("plugins")).alias("place", "plugin")).where("plugin is not null")
    risk = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, reports.RISKS)), F.coalesce("risk_level", F.lit(""))), F.lit(0)), F.lit(len(reports.RISKS) + 1))
    rows = evidence.select(*keys, F.struct(risk.alias("risk"), F.col("id").alias("row")).alias("id"), "artifact_value").join(per.select(*keys).distinct(), keys, "left_semi")
    first = _top(rows.select(*keys, "id"), 2 * k, keys, "id").drop("rank")
    words = per.select("*", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("token"))
    held = text_index.match(rows, words.select(*keys, "token"), keys, "artifact_value")
    names = ["investigation_id", "plugins", "entities", "place"]
    hits = words.join(held, [*keys, "token"]).select(*names, "id").distinct()
    hits = _top(hits, k, names, "id").select(*names, "id", F.lit(0).alias("late"))
    both = hits.unionByName(per.join(first, keys).select(*names, "id", F.lit(1).alias("late")))
    both = both.groupBy(*names, "id").agg(F.min("late").alias("late"))
    turns = _top(both, k, names, "late", "id").withColumnRenamed("rank", "turn")
    found = _top(turns, k, names[:3], "turn", "place").select(*names[:3], F.col("id.row").alias("id"), "rank")
    return asked.join(found, names[:3]).select("question_id", "investigation_id", "id", "rank")


def retrieve(questions: DataFrame, evidence: DataFrame, attributes: Column, k: int) -> DataFrame:
    """(question_id, investigation_id, route, id, rank): the first k rows of each of questions(question_id, investigation_id, question).

    Where questions has plugins (an array, as a router gives them), a question that has any is answered from those alone (route plugins): rows that hold one of its entities, an array of
    words, come first, and before those the rows that pinned, an array of ids, names in its investigation, in that order. If that gives no row, and for all other questions, the
    route is the first of ROUTES that the text asks for; null or empty text is general. A suspicious question of an investigation without suspicious rows
    gets general ones. Questions with nothing to show have no row. question_id must be unique."""
    if "plugins" not in questions.columns:
        return _by_intent(questions, evidence, attributes, k)
    words = F.array().cast("array<string>")
    entities = F.coalesce("entities", words) if "entities" in questions.columns else words
    sent = questions.where(F.size("plugins") > 0)
    scoped = _routed(sent.select("question_id", "investigation_id", "plugins", entities.alias("entities")), evidence, k).withColumn("source", F.lit(1))
    if "pinned" in questions.columns:
        wanted = sent.select("question_id", "investigation_id", F.posexplode(F.array_distinct("pinned")).alias("rank", "id"))
        known = wanted.join(evidence.select("investigation_id", "id").distinct(), ["investigation_id", "id"], "left_semi")
        scoped = scoped.unionByName(known.withColumn("source", F.lit(0)))
    best = scoped.groupBy("question_id", "investigation_id", "id").agg(F.min(F.struct("source", "rank")).alias("best"))
    routed = _top(best, k, ["question_id"], "best").select("question_id", "investigation_id", F.lit("plugins").alias("route"), "id", "rank")
    routed = written(routed, "routed")
    others = questions.join(routed.select("question_id").distinct(), "question_id", "left_anti")
    return routed.unionByName(_by_intent(others, evidence, attributes, k))


def shaped(found: DataFrame, evidence: DataFrame, attributes: Column) -> DataFrame:
    """Retrieved rows with document, pid, process_name, risk_level, suspicious_flags and score of their evidence."""
    wanted = evidence.join(found.select("investigation_id", "id").distinct(), ["investigation_id", "id"], "left_semi")
    return found.join(retrieval.to_match(wanted, attributes), ["investigation_id", "id"])


def _by_intent(questions: DataFrame, evidence: DataFrame, attributes: Column, k: int) -> DataFrame:
    asked = answers.detect_intent(questions.select("question_id", "investigation_id", "question"))
    names = F.sort_array("process_names")
    route = F.when(F.col("pid").isNotNull(), ROUTES[0]).when(F.col("tid").isNotNull(), ROUTES[1]).when(F.size("process_names") > 0, ROUTES[2]).when(F.col("suspicious"), ROUTES[3]).when(F.size("families") > 0, ROUTES[4]).otherwise(ROUTES[5])
    asked = written(asked.withColumn("process_names", names).withColumn("route", route), "asked")  # every route reads it
    of = lambda i: asked.where(F.col("route") == ROUTES[i]).select("question_id", "investigation_id", "route", "pid", "tid", "process_names", "families")
    base, value = ["investigation_id", "id"], retrieval._attribute
    out = ["question_id", "investigation_id", "route", "id", "rank"]

    def by_value(i: int, key: str, values: list[Column]) -> DataFrame:
        wanted = of(i).select("investigation_id", key).distinct()
        rows = evidence.select(*base, F.explode(F.array_distinct(F.array_compact(F.array(*values)))).alias(key)).join(wanted, ["investigation_id", key], "left_semi")
        return of(i).join(_top(rows, k, ["investigation_id", key], "id"), ["investigation_id", key]).select(*out)

    kind = F.col("artifact_type")
    thread = F.when((kind == "handles") & (F.lower(value("type")) == "thread"), value("handlevalue"))
    pids, tids = by_value(0, "pid", [value("pid"), value("processid")]), by_value(1, "tid", [value("tid"), value("threadid"), value("thread"), thread])

    called = F.array_compact(F.array(*(F.lower(value(key)) for key in retrieval.IDENTITY_KEYS)))
    rows = evidence.where(kind.isin(*retrieval.PROCESS_FAMILIES, "netscan", "handles", "dlllist")).select("investigation_id", F.struct("id", called.alias("called")).alias("id"), "artifact_value")
    lists = of(2).select("investigation_id", "process_names").distinct()
    tokens = lists.select("*", F.explode("process_names").alias("token"))
    held = text_index.match(rows, tokens.select("investigation_id", "token"), ["investigation_id"], "artifact_value")
    rows = tokens.join(held, ["investigation_id", "token"]).select("investigation_id", "id.id", "process_names", F.arrays_overlap("process_names", "id.called").alias("exact")).distinct()
    named = of(2).join(_top(rows, k, ["investigation_id", "process_names"], F.desc("exact"), "id"), ["investigation_id", "process_names"]).select(*out)

    general = retrieval.fetch_general(evidence, k).select(*base, "rank")
    suspicious = retrieval.fetch_suspicious(evidence, attributes, k).select(*base, "rank")
    alarmed = of(3).join(suspicious, "investigation_id").select(*out)
    calm = of(3).join(suspicious.select("investigation_id").distinct(), "investigation_id", "left_anti").unionByName(of(5)).join(general, "investigation_id").select(*out)

    families = of(4).select("question_id", "investigation_id", "route", F.explode("families").alias("artifact_type"))
    first = _top(evidence.select(*base, "artifact_type"), k, ["investigation_id", "artifact_type"], "id").drop("rank")
    typed = _top(families.join(first, ["investigation_id", "artifact_type"]), k, ["question_id"], "id").select(*out)
    return pids.unionByName(tids).unionByName(named).unionByName(alarmed).unionByName(typed).unionByName(calm)
