"""Structured Streaming: plugin outputs as they arrive, and runs finished per investigation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spoor.sources.evidence import normalize_evidence
from spoor.sources.split_json import read_arrays


def stream_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, verdicts: str | None = None) -> StreamingQuery:
    """Each new file <plugin>.json of folder, of any size, normalised and written to out, a folder a batch. A file that is no JSON array gives no rows and stops nothing;
    verdicts, if given, gets (file, accepted, rows) of every file. A batch that is repeated after a failure replaces what it had written."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", "1000").load(folder)

    def take(batch: DataFrame, k: int) -> None:
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in batch.select("path").collect()]  # at most a trigger's files; their contents are not read
        if not paths:
            return
        rows, told = read_arrays(spark, paths)
        plugin = F.regexp_extract("file", r"([^/]*)\.json$", 1)
        normalize_evidence(rows.select(plugin.alias("plugin"), "row")).write.mode("overwrite").parquet(f"{out}/batch={k}")
        if verdicts is not None:
            told.write.mode("overwrite").parquet(f"{verdicts}/batch={k}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()


class _Progress(StatefulProcessor):
    """An investigation's finished executions, until its last one; then how many there were, until that may be forgotten."""

    def __init__(self, linger_ms: int, idle_ms: int):
        self.linger_ms, self.idle_ms = linger_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", "execution_id long", "seen boolean")
        self.sums = handle.getValueState("sums", "finished long, total long, complete boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        finished, total, complete = self.sums.get() if self.sums.exists() else (0, 0, False)
        last = 0
        for frame in rows:
            last = max(last, int(frame["finished_at"].max().timestamp() * 1000))
            total = max(total, int(frame["total"].max()))
            for execution in frame["execution_id"].unique():
                if not complete and not self.done.containsKey((int(execution),)):
                    self.done.updateValue((int(execution),), (True,))
                    finished += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if total and finished >= total and not complete:
            complete = True
            self.done.clear()
        self.sums.update((finished, total, complete))
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + (self.linger_ms if complete else self.idle_ms))
        yield pd.DataFrame({"investigation_id": [key[0]], "finished": [finished], "total": [total], "percent": [finished * 100 // total if total else 0], "complete": [complete]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.done.clear()
        self.sums.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_progress(finished: DataFrame, plan: DataFrame, *, late: str = "1 hour", linger_ms: int = 0, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """(investigation_id, finished, total, percent, complete) whenever executions of an investigation end; update mode, RocksDB state.

    finished(investigation_id, execution_id, finished_at) is a stream, plan(investigation_id, total) a table with a row an investigation; where it has none, total is 0 and
    the investigation never complete. An execution counts once, so finished never falls. Of a complete investigation only its sums are kept, until the
    watermark, late behind the newest event, passes its last event by linger_ms; repeats that come after are late and dropped. One that never
    completes is forgotten idle_ms after its last event. Rows with nulls are dropped."""
    rows = finished.select("investigation_id", F.col("execution_id").cast("long").alias("execution_id"), F.col("finished_at").cast("timestamp").alias("finished_at")).where("investigation_id is not null and execution_id is not null and finished_at is not null")
    totals = plan.select("investigation_id", F.col("total").cast("long").alias("total"))
    rows = rows.withWatermark("finished_at", late).join(totals, "investigation_id", "left").fillna(0, ["total"])
    schema = "investigation_id string, finished long, total long, percent long, complete boolean"
    return rows.groupBy("investigation_id").transformWithStateInPandas(_Progress(linger_ms, idle_ms), schema, "Update", "EventTime")
