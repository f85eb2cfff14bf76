"""The documents of an index and what each was made of, changed batch by batch.

documents and state change in one commit, so a run that is lost midway leaves neither half done, and a batch that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoor.functions.attributes import content_hash

from .store import Store, Table, Transaction

TABLES = {
    "documents": Table("document_id string, evidence_id long, investigation_id string, document string", ("investigation_id", "document_id"), ("investigation_id",)),
    "state": Table("evidence_id long, investigation_id string, content_hash string, indexed_at timestamp", ("investigation_id", "evidence_id"), ("investigation_id",)),
}


class DocumentIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.store = Store(spark, folder, TABLES, buckets)

    def sync(self, evidence: DataFrame, batch: int, source: str = "sync") -> dict[str, int] | None:
        """Index evidence(id, investigation_id, document), which is all that the investigations that it names have: new and changed documents are written, those that are gone deleted.

        The counts of rows indexed, unchanged, removed and in total; None for a batch that is in the index. Null ids are left out; of rows that share an id and
        investigation any one counts."""
        return self._change(evidence, batch, source, stale=True)

    def upsert(self, evidence: DataFrame, batch: int, source: str = "stream") -> dict[str, int] | None:
        """As sync, but what evidence does not have stays."""
        return self._change(evidence, batch, source, stale=False)

    def stream(self, evidence: DataFrame, checkpoint: str, source: str = "stream") -> StreamingQuery:
        """Upsert the batches of a stream of evidence(id, investigation_id, document) that are there now. A batch that failed before its checkpoint was written is repeated by the next call, and
        by then either in the index already or not at all."""
        return evidence.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.upsert(rows, batch, source) and None).trigger(availableNow=True).start()

    def remove(self, investigations: DataFrame, batch: int, source: str = "remove") -> int | None:
        """Delete all of investigations(investigation_id); how many documents went."""
        change = self.store.begin(batch, source)
        if change is None:
            return None
        at = self.store.buckets_in("state", investigations)
        gone = change.read("state", at)
        gone = gone.join(investigations, gone["investigation_id"].eqNullSafe(investigations["investigation_id"]), "left_semi").select("evidence_id", "investigation_id")
        removed = self._delete(change, gone)
        change.commit()
        return removed

    def _delete(self, change: Transaction, gone: DataFrame) -> int:
        gone = change.put("state", gone, deleted=True)
        change.put("documents", gone.select("investigation_id", _document_id(F.col("evidence_id"))), deleted=True)
        return gone.count()

    def _change(self, evidence: DataFrame, batch: int, source: str, stale: bool) -> dict[str, int] | None:
        change = self.store.begin(batch, source)
        if change is None:
            return None
        rows = evidence.where("id is not null").select(F.col("id").cast("long").alias("evidence_id"), "investigation_id", "document", content_hash(F.col("document")).alias("content_hash"))
        rows = change.scratch(rows.dropDuplicates(["evidence_id", "investigation_id"]))
        at = self.store.buckets_in("state", rows)
        named = rows.select("investigation_id").distinct()
        held = change.read("state", at).alias("h")
        n = named.alias("n")
        held = held.join(n, F.col("h.investigation_id").eqNullSafe(F.col("n.investigation_id")), "left_semi").alias("h")
        r = rows.alias("r")
        same = F.col("r.evidence_id").eqNullSafe(F.col("h.evidence_id")) & F.col("r.investigation_id").eqNullSafe(F.col("h.investigation_id"))
        new = r.join(held, same & F.col("r.content_hash").eqNullSafe(F.col("h.content_hash")), "left_anti")
        new = change.scratch(new)
        removed = self._delete(change, held.join(r, same, "left_anti").select("evidence_id", "investigation_id")) if stale else 0
        change.put("documents", new.select("*", _document_id(F.col("evidence_id"))))
        change.put("state", new.withColumn("indexed_at", F.current_timestamp()))
        indexed, total = new.count(), rows.count()
        change.commit()
        return {"indexed": indexed, "unchanged": total - indexed, "removed": removed, "total": total}


def _document_id(evidence_id):
    return F.concat(F.lit("ev-"), evidence_id.cast("string")).alias("document_id")
