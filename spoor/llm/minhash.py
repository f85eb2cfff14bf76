"""MinHash near-duplicates with tensored banding, candidates verified on full shingle sets.

Two collections of M short bands (R minhashes each) are computed per set; the key of table
(i, j) joins band i of the first with band j of the second, so M * M tables of 2 R
rows cost 2 M R minhashes. A table's key can collide only where both of its bands
do, so bands that no other set shares are dropped before keys are formed; that
loses no collision.

Sets that are equal are one class before any search. Nodes of the search are classes; within a key, each
class is compared with the least one, and only keys whose classes are not connected by then go to an
exact prefix filter (rarest shingles first) over their own classes, which has no cap.
Jaccard is computed on the full sets of 64-bit shingle hashes.

At similarity 0.8 a pair shares a table with probability 1 - 2 (1 - 0.8**R)**M, over 0.9999 with R 3 and M 16.

Null, empty and white-space texts have empty sets: they link with nothing and are their own
component. Shorter texts than a shingle are one shingle. Rows that repeat a doc_id
with other texts are judged each by its text; a null doc_id is never the least of its component unless all are null. Extra columns are not returned by classes() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .linking import connected_components, link_members
from .storage import materialize, scope, small

R, M = 3, 16
WORDS = 8


def _constants(n: int) -> np.ndarray:
    return K.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketches(batches: Iterator[pa.RecordBatch], k: int, r: int, m: int) -> Iterator[pa.RecordBatch]:
    hashes = 2 * m * r
    c = _constants(hashes)
    a, b = c[:hashes] | np.uint64(1), c[hashes:]
    for batch in batches:
        n = batch.num_rows
        sizes, h1, h2, bands = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, 2 * m), np.uint64)
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            x, cuts = K.shingles(K.words(data, offsets), k)
            full = np.flatnonzero(np.diff(cuts) > 0)
            if not len(full):
                continue
            for d in full:
                own = np.unique(x[cuts[d] : cuts[d + 1]])
                sizes[lo + d] = len(own)
                h1[lo + d] = own.sum(dtype=np.uint64)
                h2[lo + d] = np.bitwise_xor.reduce(K.mix(own + np.uint64(7)))
            at = cuts[full]
            for i in range(2 * m):
                acc = np.full(len(full), i + 1, np.uint64)
                for j in range(i * r, i * r + r):
                    acc = K.mix(acc ^ np.minimum.reduceat(x * a[j] + b[j], at))
                bands[lo + full, i] = acc
        # the sums also hold the size, so that one 64-bit value names a set
        h1 = K.mix(h1 + K.mix(h2) + sizes.astype(np.uint64))
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * m)), pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), values, batch.column(2)], names=["doc_id", "n", "h1", "h2", "bands", "text_hash"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Full sets, and a bitmap in which each shingle toggles one of 64 * WORDS bits."""
    for batch in batches:
        parts, ends, bits = [], [0], []
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            x, cuts = K.shingles(K.words(data, offsets), k)
            for d in range(hi - lo):
                parts.append(np.unique(x[cuts[d] : cuts[d + 1]]))
                ends.append(ends[-1] + len(parts[-1]))
                odd = np.bincount((parts[-1] >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))], names=["node", "shingles", "bits"])


def classes(docs: DataFrame, *, k: int = 5, percent: int = 80, r: int = R, m: int = M) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    rows = docs.mapInArrow(lambda it: _sketches(it, k, r, m), "doc_id long, n int, h1 long, h2 long, bands array<long>, text_hash long")
    rows = materialize(rows, "sketches", keep=True)
    with scope(docs.sparkSession):
        moved = materialize(_moved(docs, rows, k, percent, m), "moved", keep=True)
    known = rows.select("doc_id", "n", "h1", "h2").join(small(moved).withColumn("found", F.lit(True)), ["h1", "h2"], "left")
    return known.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("found") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _moved(docs: DataFrame, rows: DataFrame, k: int, percent: int, m: int) -> DataFrame:
    """(h1, h2, component_id) of the sets whose rows' component is not their own doc_id."""
    sets = rows.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"))
    sets = materialize(sets, "sets").withColumnRenamed("h1", "node")

    bands = sets.select("node", "n", F.posexplode("bands").alias("i", "band"))
    shared = materialize(bands.groupBy("i", "band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "band"), "shared-bands")
    alive = bands.join(small(shared), ["i", "band"], "left_semi")
    own = alive.groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("i", "band")).alias("own"))  # at most 2 M
    own = materialize(own, "shared-own")
    first, second = F.filter("own", lambda x: x["i"] < m), F.filter("own", lambda x: x["i"] >= m)
    tables = own.where((F.size(first) > 0) & (F.size(second) > 0)).select("node", "n", F.explode(first).alias("u"), second.alias("second")).select("node", "n", "u", F.explode("second").alias("v"))
    members = tables.select(F.xxhash64("u.i", "u.band", "v.i", "v.band").alias("key"), "node", "n")

    memo: dict[str, DataFrame] = {}

    def full_sets() -> DataFrame:
        """The shingle sets of the classes that share a key with another."""
        if "sets" not in memo:
            named = materialize(own.select("node").join(sets.select("node", "row.doc_id", "row.text_hash"), "node"), "named")
            # a doc_id may stand for several texts, and texts may have none: the hash of a row's own text decides, so a row has at most one node
            texts = docs.join(small(named), docs.doc_id.eqNullSafe(named.doc_id) & (docs.text_hash == named.text_hash)).select(named.node, "text")
            found = materialize(texts.mapInArrow(lambda it: _sets(it, k), "node long, shingles array<long>, bits array<long>"), "full-sets")
            # rows that repeat a doc_id and its text have equal sets
            memo["sets"] = found if found.count() == named.count() else materialize(found.dropDuplicates(["node"]), "full-sets")
        return memo["sets"]

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs is read from files. Only the sets of its nodes are shuffled."""
        ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair-nodes")
        s = full_sets().join(small(ends), "node", "left_semi")
        left, right = s.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), s.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")

    def rest(left: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs of unsettled classes in different components that share a shingle of their prefixes where both can still
        reach the overlap: by the prefix, positional and bitmap filters, all that can link."""
        token = full_sets().select("node", F.explode("shingles").alias("s")).join(small(left.select("node")), "node", "left_semi")
        # a shingle that no other unsettled class has is common to no pair, and comes first in every order
        often = materialize(token.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common-shingles")
        held = Window.partitionBy("node")
        ranked = token.join(small(often), "s").withColumn("known", F.count(F.lit(1)).over(held)).withColumn("rank", F.row_number().over(held.orderBy("df", "s")))
        own = full_sets().select("node", "bits").join(small(left), "node")
        prefix = ranked.join(small(materialize(own, "unsettled-bits")), "node").withColumn("rank", F.col("n") - F.col("known") + F.col("rank"))
        # the smaller set of a pair needs a shorter prefix: their overlap is at least 2 p / (1 + p) of its size
        probe, index = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1, F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent) - F.lit(1e-9)) + 1
        prefix = prefix.where(F.col("rank") <= probe).select("s", "node", "n", "comp", "rank", "known", (F.col("rank") <= index).alias("short"), "bits")
        prefix = materialize(prefix, "prefixes")
        x, y = (prefix.select("s", "short", *(F.col(c).alias(f"{c}{i}") for c in ("node", "n", "comp", "rank", "known", "bits"))) for i in (1, 2))
        smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
        # a linked pair's first shared shingle has most of the overlap behind it; other shared ones need not find the pair
        room = 1 + F.least(F.col("n1") - F.col("rank1"), F.col("n2") - F.col("rank2"))
        # bits that differ are shingles that only one set has, at least
        unlike = sum((F.bit_count(F.get("bits1", F.lit(i)).bitwiseXOR(F.get("bits2", F.lit(i)))) for i in range(1, WORDS)), F.bit_count(F.get("bits1", F.lit(0)).bitwiseXOR(F.get("bits2", F.lit(0)))))
        both = F.col("n1") + F.col("n2")
        fits = (F.least(room, "known1", "known2") * (100 + percent) >= percent * both) & ((both - unlike) * (100 + percent) >= 2 * percent * both)
        pairs = x.where("short").drop("short").join(y.drop("short"), "s").where(smaller & (F.col("comp1") != F.col("comp2")) & may_link("n1", "n2") & fits)
        pairs = pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
        return pairs.join(links, ["a", "b"], "left_anti")

    def may_link(x: str, y: str) -> F.Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    links = materialize(link_members(members, may_link, verify, rest), "all-links")
    comps = connected_components(links)
    placed = sets.join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    changed = (F.col("rows") > 1) | (F.col("comp") != F.col("node")) | ~F.col("component_id").eqNullSafe(F.col("least"))
    return placed.join(least, "comp").where(changed).select(F.col("node").alias("h1"), "h2", "component_id")


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of docs with one document of each component: the one of least doc_id. Rows that repeat
    a doc_id and its text stay once; rows without a doc_id stay."""
    found = classes(docs.select("doc_id", "text"), **settings)
    kept = materialize(found.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    marked = named.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return marked.select(*docs.columns).unionByName(docs.where("doc_id is null"))
