"""Hard negatives by exact inner-product search with coordinate pruning.

Vectors are dealt into length buckets, a bucket's rows of one label into blocks of about 4,096. A block keeps its rows' vectors, their
longest length, and for each coordinate the list of its rows sorted by that coordinate of the unit vector. An anchor that needs a score of at least t
from a block needs a cosine of at least t / (its length * the block's longest): over 1 and the block is skipped. Else each of the
anchor's focus coordinates, its largest, bounds that coordinate of any such row; the ranges are looked up in the sorted lists and intersected, and only what is left is scored
exactly. Where even the narrowest range holds over a quarter of a block, the block is scored as one matrix product instead. t is the k-th
best score so far, so it rises as a task goes through its blocks; tasks return their k best, which Spark merges.

Rows without an id, a label or a vector, with a null or non-finite component, or with a scaled component of 2^26 or more in size (scores of 2,048 of those still fit in
64 bits) take no part. Rows equal in id, label and vector count once; rows that share only an id are rows of their own, but never each other's positive or
negative. Shorter vectors are filled up with zeros. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, scope, small

BLOCK_ROWS, FOCUS, DENSE = 4096, 3, 0.25
#: Bytes of anchors that are broadcast at a time.
ANCHOR_BYTES = 16 << 20
#: Ratio of the longest and the shortest length in a bucket.
WIDTH = 1.05
_LEAST, _LARGEST = np.iinfo(np.int64).min, 1 << 26
_SLACK = 1e-9
_BLOCK = "label long, ids binary, vectors binary, sorted binary"
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def scaled(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, label, embedding) as (vec_id, label, v): v is floor(256 * x) of each component; the rows that take part, each once."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda x: x.cast("double") * 256).alias("x")).where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda x: F.coalesce(F.abs(x) < float(_LARGEST), F.lit(False))))
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v")).distinct()


def _pack(rows: pa.Table) -> pa.Table:
    """One block: ids ascending, vectors row by row, and each coordinate's row numbers by that coordinate of the unit vector."""
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, found = rows["vec_id"].to_numpy()[order], rows["v"].combine_chunks().take(pa.array(order))
    dims = max(len(x) for x in found)
    matrix = np.zeros((len(ids), dims), np.int32)
    for i, x in enumerate(found):
        matrix[i, : len(x)] = x.values.to_numpy()
    lists = np.argsort(_units(matrix), axis=0, kind="stable").T.astype(np.uint32)
    return pa.table({"label": [rows["label"][0].as_py()], "ids": [ids.tobytes()], "vectors": [matrix.tobytes()], "sorted": [np.ascontiguousarray(lists).tobytes()]})


def _units(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1)


def blocks(rows: DataFrame) -> DataFrame:
    """The index of rows(vec_id, label, v), written once."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = rows.withColumn("bucket", F.when(length > 0, F.floor(F.log(length) / np.log(WIDTH))).otherwise(-1))
    sizes = materialize(rows.groupBy("label", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts")), "sizes")
    dealt = rows.join(small(sizes), ["label", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    return materialize(dealt.select("label", "bucket", "part", "vec_id", "v").groupBy("label", "bucket", "part").applyInArrow(_pack, _BLOCK), "blocks")


class Block:
    def __init__(self, label: int, ids: bytes, vectors: bytes, lists: bytes):
        self.label, self.ids = label, np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), -1)
        self.lists = np.frombuffer(lists, np.uint32).reshape(-1, len(self.ids))
        self.units = _units(self.vectors)
        self.longest = float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1).max()))

    def scores(self, anchors: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact inner products; a matrix product in doubles where those hold every sum."""
        mine = self.vectors if rows is None else self.vectors[rows]
        dims = min(mine.shape[1], anchors.shape[1])
        a, b = anchors[:, :dims], mine[:, :dims]
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1)
        kind = np.float64 if most < 2**53 else np.int64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)

    def feasible(self, units: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(anchors, rows) that can reach an anchor's least score: the rows of one anchor, or None for the whole block."""
        reach = lengths * self.longest
        bound = np.where(least > 0, least / np.where(reach > 0, reach, 1e-300), -1.0)
        alive = np.flatnonzero(bound <= 1 + _SLACK)
        if not len(alive) or not self.vectors.shape[1]:
            yield alive, None
            return
        dims = min(self.vectors.shape[1], units.shape[1])
        focus = np.argsort(-np.abs(units[alive][:, :dims]), axis=1, kind="stable")[:, :FOCUS]
        own, room = np.arccos(np.clip(np.take_along_axis(units[alive], focus, 1), -1, 1)), np.arccos(np.clip(bound[alive], -1, 1))[:, None]
        low, high = np.cos(np.minimum(np.pi, own + room)) - _SLACK, np.cos(np.maximum(0, own - room)) + _SLACK
        free = (bound[alive] <= 0)[:, None]  # a score of nothing or less says nothing about the cosine
        low, high = np.where(free, -2, low), np.where(free, 2, high)
        first, last = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            values, at = self.units[self.lists[f], f], focus == f
            first[at], last[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        best = np.argmin(last - first, axis=1)
        width = np.take_along_axis(last - first, best[:, None], 1)[:, 0]
        wide = width > DENSE * len(self.ids)
        yield alive[wide], None
        for i in np.flatnonzero(~wide & (width > 0)):
            rows = self.lists[focus[i, best[i]]][first[i, best[i]] : last[i, best[i]]]
            for j, f in enumerate(focus[i]):
                if j != best[i]:
                    value = self.units[rows, f]
                    rows = rows[(value >= low[i, j]) & (value <= high[i, j])]
            if len(rows):
                yield alive[i : i + 1], np.sort(rows)


class Best:
    """The k best (score, id) of each of n lists, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, _LEAST)
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, of: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(of):
            return
        of, score, row = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.id, row])
        order = np.lexsort((row, -score, of))
        of, score, row = of[order], score[order], row[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        self.of, self.score, self.id = of[keep], score[keep], row[keep]
        full = rank == self.k - 1
        self.least[of[full]] = score[full]


def _offer(best: Best, of: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
    """Add to list of[i] what scores[i] allows and its least score so far does not rule out."""
    allowed = allowed & (scores >= best.least[of][:, None])
    if np.count_nonzero(allowed) > 4 * best.k * len(of) and scores.shape[1] > best.k:  # else ties at the k-th place stay, and few others
        kth = np.partition(np.where(allowed, scores, _LEAST), -best.k, axis=1)[:, -best.k]
        allowed &= scores >= kth[:, None]
    i, j = np.nonzero(allowed)
    best.add(of[i], scores[i, j], ids[j])


def _find_positives(anchors, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        best = Best(len(a["ids"]), k)
        for block in _read(batches):
            mine = np.flatnonzero(a["labels"] == block.label)
            for some, rows in block.feasible(a["units"][mine], a["lengths"][mine], best.least[mine]) if len(mine) else ():
                of, ids = mine[some], block.ids if rows is None else block.ids[rows]
                if len(of):
                    _offer(best, of, block.scores(a["vectors"][of], rows), ids, ids != a["ids"][of][:, None])
        yield pa.RecordBatch.from_arrays([pa.array(best.of), pa.array(best.score), pa.array(best.id)], ["of", "score", "id"])

    return run


def _find_negatives(anchors, wanted, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """wanted: (of, low, high) of each list, with the anchor's number first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (anchor, low, high) = anchors.value, wanted.value
        best = Best(len(anchor), k)
        best.least[:] = low  # until a list is full
        lists = np.argsort(anchor, kind="stable")
        begin, end = np.searchsorted(anchor[lists], np.arange(len(a["ids"]))), np.searchsorted(anchor[lists], np.arange(len(a["ids"])), "right")
        for block in _read(batches):
            mine = np.flatnonzero((a["labels"] != block.label) & (end > begin))
            if not len(mine):
                continue
            least = np.minimum.reduceat(best.least[lists], begin[mine]) if len(mine) == np.count_nonzero(end > begin) else np.array([best.least[lists[begin[m] : end[m]]].min() for m in mine])
            for some, rows in block.feasible(a["units"][mine], a["lengths"][mine], least):
                ids = block.ids if rows is None else block.ids[rows]
                if not len(some):
                    continue
                scores = block.scores(a["vectors"][mine[some]], rows)
                apart = ids != a["ids"][mine[some]][:, None]
                for p in range(int((end - begin)[mine[some]].max())):
                    has = np.flatnonzero(begin[mine[some]] + p < end[mine[some]])
                    of = lists[begin[mine[some[has]]] + p]
                    _offer(best, of, scores[has], ids, apart[has] & (scores[has] <= high[of][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(best.of), pa.array(best.score), pa.array(best.id)], ["of", "score", "id"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("label", "ids", "vectors", "sorted"))):
            yield Block(*(x.as_py() for x in row))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each list over all tasks, with rank."""
    order = Window.partitionBy("of").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _load(rows: list) -> dict[str, np.ndarray]:
    rows = sorted(rows, key=lambda r: (r.vec_id, r.label, r.v))
    vectors = np.zeros((len(rows), max((len(r.v) for r in rows), default=0)), np.int32)
    for i, r in enumerate(rows):
        vectors[i, : len(r.v)] = r.v
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    return {"ids": np.array([r.vec_id for r in rows], np.int64), "labels": np.array([r.label for r in rows], np.int64), "vectors": vectors, "units": _units(vectors), "lengths": lengths}


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, some of rows(vec_id, label, v):

    each anchor's POSITIVES best rows of its label, and for each the NEGATIVES best rows of other labels that score LOW to HIGH percent of it. Anchors go in chunks
    of about ANCHOR_BYTES, each of which is sent to all tasks; a chunk reads the index twice."""
    spark, out = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with scope(spark):
        index = blocks(rows)
        size = anchors.agg(F.sum(F.size("v") * 20 + 100)).first()[0] or 0  # of vectors, unit vectors and the driver's rows
        chunks, parts = max(1, -(-size // ANCHOR_BYTES)), []
        dealt = anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)))
        for c in range(chunks):
            chunk = _load(dealt.where(F.col("chunk") == c).collect())
            sent = spark.sparkContext.broadcast(chunk)
            near = _best(index.mapInArrow(_find_positives(sent, POSITIVES), "of long, score long, id long"), POSITIVES).select("of", "score", "id").where("score >= 0").collect()
            near = sorted(near, key=lambda r: (r.of, -r.score, r.id))
            of, score, positive = (np.array([r[i] for r in near], np.int64) for i in range(3))
            asked = spark.sparkContext.broadcast((of, -(-LOW * score // 100), HIGH * score // 100))
            found = _best(index.mapInArrow(_find_negatives(sent, asked, NEGATIVES), "of long, score long, id long"), NEGATIVES)
            names = spark.createDataFrame(pa.table({"of": pa.array(np.arange(len(of))), "anchor_id": chunk["ids"][of], "positive_id": positive, "positive_score": score}).to_pandas(), "of long, anchor_id long, positive_id long, positive_score long")
            named = found.join(F.broadcast(names), "of").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            parts.append(materialize(named, "negatives", keep=True))
            sent.unpersist(), asked.unpersist()
    result = spark.createDataFrame([], out)
    for part in parts:
        result = result.unionByName(part)
    return result
