"""Joins, group-bys and windows of the case tables: scope, search, dashboards, timelines, conversations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISKS = ("high", "medium", "low")


def scope(evidence: DataFrame, executions: DataFrame, investigation: str | None = None, completed: bool = False) -> DataFrame:
    """Evidence with its execution's plugin_name and execution_status."""
    runs = executions.select(F.col("id").alias("execution_id"), "plugin_name", "execution_status", "investigation_id")
    if investigation is not None:
        runs = runs.where(F.col("investigation_id") == investigation)
    if completed:
        runs = runs.where("execution_status = 'completed'")
    return evidence.drop("investigation_id").join(runs, "execution_id")


def scope_semi(evidence: DataFrame, executions: DataFrame, investigation: str) -> DataFrame:
    return evidence.join(executions.where(F.col("investigation_id") == investigation).select(F.col("id").alias("execution_id")), "execution_id", "left_semi")


def search_evidence(df: DataFrame, *, text: str | None = None, family: str | None = None, severity: str | None = None, sort: str = "id", descending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the matching rows, with total, the number of all matches. text is found anywhere in the type, plugin or value."""
    if sort not in ("id", "artifact_type", "risk_level", "created_at"):
        raise ValueError(f"cannot sort by {sort}")
    for wanted, name in ((family, "artifact_type"), (severity, "risk_level")):
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    if text is not None:
        t = F.lit(text.lower())
        df = df.where(F.lower("artifact_type").contains(t) | F.lower("plugin").contains(t) | F.lower("artifact_value").contains(t))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    order = [F.col(sort).desc() if descending else F.col(sort).asc(), F.col("id")]
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def page_after(df: DataFrame, after: int, limit: int) -> DataFrame:
    return df.where(F.col("id") > after).orderBy("id").limit(limit)


def severity_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("risk_level", F.lit("unclassified")).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def type_distribution(df: DataFrame, n: int = 8) -> DataFrame:
    return df.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artifact_type").limit(n)


def list_investigations(dumps: DataFrame, executions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every dump with its evidence rows and the plugins that gave any."""
    per_run = evidence.groupBy("execution_id").agg(F.count(F.lit(1)).alias("rows"))
    runs = executions.join(per_run, executions.id == per_run.execution_id, "left").groupBy("investigation_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("evidence_count"), F.count_distinct(F.when(F.col("rows") > 0, F.col("plugin_name"))).alias("plugin_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return dumps.join(runs, "investigation_id", "left").select("investigation_id", zero("evidence_count"), zero("plugin_count"))


def execution_stats(executions: DataFrame) -> DataFrame:
    return executions.groupBy("execution_status").agg(F.count(F.lit(1)).alias("n"))


def success_rate(executions: DataFrame) -> DataFrame:
    done = F.count_if(F.col("execution_status") == "completed")
    ended = F.count_if(F.col("execution_status").isin("completed", "failed"))
    return executions.agg(F.when(ended > 0, F.round(100.0 * done / ended, 1)).otherwise(0.0).alias("success_rate"))


def corpus_overview(scoped: DataFrame) -> DataFrame:
    """Rows by plugin and risk, over the last completed execution of each plugin."""
    last = scoped.where("execution_status = 'completed'").groupBy("investigation_id", "plugin_name").agg(F.max("execution_id").alias("execution_id"))
    rows = scoped.join(last, ["investigation_id", "plugin_name", "execution_id"], "left_semi")
    return rows.groupBy("investigation_id", "plugin_name").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("risk_level") == r).alias(r) for r in RISKS))


def _malfind_high(rows: DataFrame, executions: DataFrame, attributes: Column) -> DataFrame:
    """High-risk rows of each investigation's last completed malfind run; rows whose value is no object are left out."""
    run = executions.where("execution_status = 'completed' and plugin_name like '%malfind'").groupBy("investigation_id").agg(F.max("id").alias("execution_id"))
    value = lambda k: F.try_element_at(attributes, F.lit(k))
    name = F.when(F.coalesce(value("process"), F.lit("")) == "", "unknown").otherwise(value("process"))
    high = rows.where("artifact_type = 'malfind' and risk_level = 'high'").where(attributes.isNotNull())
    high = high.select("investigation_id", "execution_id", name.alias("process"), value("pid").alias("pid"), F.coalesce(value("privatememory") == "1", F.lit(False)).alias("is_private"))
    return high.join(run, ["investigation_id", "execution_id"], "left_semi")


def malfind_breakdown(rows: DataFrame, executions: DataFrame, attributes: Column) -> DataFrame:
    """(investigation_id, total, private, mapped, processes) of the high-risk injected regions."""
    high = _malfind_high(rows, executions, attributes)
    private = F.count_if("is_private")
    return high.groupBy("investigation_id").agg(F.count(F.lit(1)).alias("total"), private.alias("private"), (F.count(F.lit(1)) - private).alias("mapped"), F.count_distinct(F.struct("process", "pid")).alias("processes"))


def malfind_top(rows: DataFrame, executions: DataFrame, attributes: Column, k: int = 8) -> DataFrame:
    """(investigation_id, list, rank, process, pid, n): the k processes with most regions, and those with most private ones.
    Ties go by name, then process id."""
    high = _malfind_high(rows, executions, attributes)
    counts = high.groupBy("investigation_id", "process", "pid").agg(F.count(F.lit(1)).alias("all"), F.count_if("is_private").alias("private"))
    lists = F.explode(F.array(*(F.struct(F.lit(x).alias("list"), F.col(x).alias("n")) for x in ("all", "private"))))
    counts = counts.select("investigation_id", "process", "pid", lists.alias("x")).select("investigation_id", "x.list", "process", "pid", "x.n").where("n > 0")
    order = Window.partitionBy("investigation_id", "list").orderBy(F.desc("n"), "process", "pid")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def daily_trend(dumps: DataFrame, last_day: str, days: int = 7) -> DataFrame:
    """Rows a day of created_at, for the days up to last_day; days without any are 0."""
    end = F.to_date(F.lit(last_day))
    calendar = dumps.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = dumps.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def assess_coverage(routes: DataFrame, executions: DataFrame, evidence: DataFrame) -> DataFrame:
    """AVAILABLE, RAN-EMPTY or UNAVAILABLE for each (investigation_id, plugin_name) of routes, by its best execution: of the first
    one and the completed ones that with most rows, the latest of equals."""
    rows = evidence.groupBy("execution_id").agg(F.count(F.lit(1)).alias("rows"))
    runs = executions.join(rows, executions.id == rows.execution_id, "left").select("investigation_id", "plugin_name", "id", "execution_status", F.coalesce("rows", F.lit(0)).alias("rows"))
    plugin = Window.partitionBy("investigation_id", "plugin_name")
    runs = runs.withColumn("first", F.row_number().over(plugin.orderBy("id")) == 1).where("first or execution_status = 'completed'")
    best = runs.withColumn("n", F.row_number().over(plugin.orderBy(F.desc("rows"), F.desc("id")))).where("n = 1")
    state = F.when(F.col("rows") > 0, "AVAILABLE").when(F.col("execution_status") == "completed", "RAN-EMPTY").otherwise("UNAVAILABLE")
    return routes.join(best, ["investigation_id", "plugin_name"], "left").select("investigation_id", "plugin_name", F.when(F.col("id").isNull(), "UNAVAILABLE").otherwise(state).alias("state"), F.coalesce("rows", F.lit(0)).alias("rows"))


def dedup_timeline(events: DataFrame) -> DataFrame:
    """events(ts, description, plugin, id): one row for a time and description, with its plugins and least id."""
    return events.groupBy("ts", "description").agg(F.array_join(F.sort_array(F.collect_set("plugin")), ",").alias("plugins"), F.min("id").alias("id"))


def timeline_ends(events: DataFrame, limit: int = 40) -> DataFrame:
    """All events, or the first and the last half of limit: two top-k, no global window. Equal times and descriptions go by id, where there is one."""
    half, tie = limit // 2, [c for c in ("id",) if c in events.columns]
    first = events.orderBy("ts", "description", *tie).limit(limit - half)
    last = events.orderBy(F.desc("ts"), F.desc("description"), *map(F.desc, tie)).limit(half)
    return first.union(last).distinct()


def pair_exchanges(messages: DataFrame, session: str = "investigation_id") -> DataFrame:
    """(session, question_id, answer_id): an assistant message with the user message directly before it; other roles don't count."""
    w = Window.partitionBy(session).orderBy("id")
    rows = messages.where(F.col("role").isin("user", "assistant"))
    rows = rows.withColumn("prior", F.lag("role").over(w)).withColumn("question_id", F.lag("id").over(w))
    return rows.where("role = 'assistant' and prior = 'user'").select(session, "question_id", F.col("id").alias("answer_id"))


def fetch_by_plugins(evidence: DataFrame, plugins: list[str], k: int, hit: Column) -> DataFrame:
    """k rows taken in turn from the plugins, in each by hit, risk and id."""
    place = F.array_position(F.array(*(F.lit(p) for p in plugins)), F.col("plugin"))
    risk = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(r) for r in RISKS)), F.coalesce("risk_level", F.lit(""))), F.lit(0)), F.lit(len(RISKS) + 1))
    order = Window.partitionBy("investigation_id", "plugin").orderBy((~hit).cast("int"), risk, "id")
    rows = evidence.where(F.col("plugin").isin(plugins)).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)
    return rows.withColumn("place", place).withColumn("rank", F.row_number().over(Window.partitionBy("investigation_id").orderBy("turn", "place"))).where(F.col("rank") <= k)


def find_duplicate_dumps(dumps: DataFrame) -> DataFrame:
    return dumps.groupBy("sha256_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def index_delta(evidence: DataFrame, state: DataFrame) -> DataFrame:
    """(evidence_id, change): new, changed, unchanged or stale by content hash."""
    e, s = evidence.select(F.col("id").alias("evidence_id"), F.col("content_hash").alias("now")), state.select("evidence_id", F.col("content_hash").alias("then"))
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "stale").when(F.col("now") != F.col("then"), "changed").otherwise("unchanged")
    return e.join(s, "evidence_id", "full").select("evidence_id", change.alias("change"))


def upsert_index_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    return state.join(batch.select("evidence_id"), "evidence_id", "left_anti").unionByName(batch)


def vector_search(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest vec_ids by Euclidean distance, exact; one top-k over all rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    square = F.aggregate(F.zip_with("embedding", q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("vec_id", F.sqrt(square).alias("distance")).orderBy("distance", "vec_id").limit(k)


def vector_search_all(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id): the k nearest vectors(vec_id, embedding) of each of queries(query_id, embedding) by Euclidean
    distance, exact, ties by vec_id. Queries go in blocks of about that many, one pass over the vectors each. Null embeddings are neither
    searched nor found, null ids are neither too, and vectors of another length than the query's are not found."""
    known = queries.where("query_id is not null and embedding is not null")
    blocks = max(1, -(-known.count() // block))
    schema, found = "query_id long, vec_id long, distance double", None
    for i in range(blocks):
        own = [(r.query_id, np.array(r.embedding, float)) for r in known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()]  # about block rows
        given = vectors.sparkSession.sparkContext.broadcast(own)

        def nearest(batches, given=given):
            for batch in batches:
                ids, lists = batch.column(0), batch.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                out = []
                for size in {len(q) for _, q in given.value}:
                    rows = np.flatnonzero(sizes == size)
                    if not len(rows):
                        continue
                    x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                    names = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False)
                    for query_id, q in given.value:
                        if len(q) != size:
                            continue
                        d = np.sqrt(((x - q) ** 2).sum(1))
                        near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                        near = near[np.lexsort((names[near], d[near]))[:k]]
                        out += [(query_id, int(names[j]), float(d[j])) for j in near]
                columns = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "distance"])

        one = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(nearest, schema)
        found = one if found is None else found.union(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id")
