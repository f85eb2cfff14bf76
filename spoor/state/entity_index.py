"""Classification batch by batch, against an index of the entities that all earlier batches named.

The index keeps which families name an entity, which rows do, and what each row's own attributes say (its rule hits). A batch is parsed once.
It changes the families of its own rows' and of those earlier rows only whose entities gain a family; those are scored again from their kept
hits, without their evidence. A busy process id is one row a family in the index, whatever number of rows name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators import classify

from .store import Store, Table

_ENTITY = "investigation_id string, kind string, value string"
_HITS = "array<struct<code:string,weight:int,strong:boolean,reason:string>>"
_KEY = ("investigation_id", "kind", "value")
TABLES = {
    "families": Table(f"{_ENTITY}, family string", (*_KEY, "family"), ("investigation_id",), grows=True),
    "postings": Table(f"{_ENTITY}, family string, id long", (*_KEY, "id"), ("investigation_id",), grows=True),
    "rows": Table(f"id long, investigation_id string, artifact_type string, usable boolean, hits {_HITS}, families array<string>, severity string, score int, corroborated boolean", ("investigation_id", "id"), ("investigation_id",)),
}
_SCORE = ["id", "investigation_id", "artifact_type", "usable", "hits", "families", "severity", "score", "corroborated"]


class EntityIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.store = Store(spark, folder, TABLES, buckets)

    def classify(self, evidence: DataFrame, batch: int, source: str = "main") -> DataFrame | None:
        """The rows whose classification is new or changed by a batch of evidence(id, investigation_id, artifact_type, artifact_value, ...); None for a batch that is in the index.

        Ids that are in the index already are left out, as are null ids; of a batch's rows with equal ids any one counts. An investigation's rows must be read from
        its bucket only, so null investigations are one of their own."""
        change = self.store.begin(batch, source)
        if change is None:
            return None
        evidence = evidence.where("id is not null").dropDuplicates(["investigation_id", "id"])
        at = self.store.buckets_in("rows", evidence)
        same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
        known = change.read("rows", at).select("investigation_id", "id")
        new = evidence.join(known, same(evidence, known, ["investigation_id", "id"]), "left_anti")
        facts = change.scratch(classify.judged(new.select("id", "investigation_id", "artifact_type", "artifact_value", *(["attributes"] if "attributes" in new.columns else []))))
        edges = change.put("postings", classify.entity_edges(facts))

        seen = change.read("families", at)
        pairs = edges.select(*_KEY, "family").distinct()
        gained = change.put("families", pairs.join(seen, same(pairs, seen, [*_KEY, "family"]), "left_anti"))
        earlier = change.read("postings", at)
        g = gained.withColumnRenamed("family", "gain").alias("g")
        touched = earlier.alias("p").join(g, [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in _KEY]).where("p.family <> g.gain")
        touched = touched.groupBy("p.investigation_id", "p.id").agg(F.collect_set("gain").alias("gains"))

        entity = edges.select(*_KEY).distinct()
        before = seen.join(entity, same(seen, entity, _KEY), "left_semi")
        sets = before.unionByName(gained).groupBy(*_KEY).agg(F.collect_set("family").alias("with")).where(F.size("with") > 1)
        near = edges.join(sets, same(edges, sets, _KEY)).select("id", edges["investigation_id"], F.explode(F.array_except("with", F.array("family"))).alias("other"))
        own = near.groupBy("investigation_id", "id").agg(F.sort_array(F.collect_set("other")).alias("families"))
        added = classify.scored(facts.join(own, same(facts, own, ["investigation_id", "id"]), "left").select(*(facts[c] for c in ("id", "investigation_id", "artifact_type", "usable", "hits")), own["families"]))

        old = change.read("rows", at).withColumnRenamed("families", "had")
        wider = F.array_sort(F.array_union("had", "gains"))
        moved = old.join(touched, same(old, touched, ["investigation_id", "id"])).where(F.size(F.array_union("had", "gains")) > F.size("had"))
        moved = classify.scored(moved.select(*(old[c] for c in ("id", "investigation_id", "artifact_type", "usable", "hits")), wider.alias("families")))
        changed = change.put("rows", added.select(*_SCORE).unionByName(moved.select(*_SCORE)))
        change.commit()
        return changed

    def classified(self) -> DataFrame:
        """(id, investigation_id, artifact_type, severity, score, indicators, reasons, corroborated, families) of all batches."""
        rows = self.store.read("rows")
        return rows.select("id", "investigation_id", "artifact_type", "severity", "score", F.transform("hits", lambda h: h["code"]).alias("indicators"), F.transform("hits", lambda h: h["reason"]).alias("reasons"), "corroborated", "families")
