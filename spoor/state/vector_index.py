"""Exact nearest vectors from an index of cells around pivots.

Every vector lies in the cell of its nearest pivot and keeps its distance to it. By the triangle inequality a vector x of pivot p is at least
|d(q, p) - d(x, p)| from a query q, so a cell whose distances to its pivot lie in [low, high] cannot hold a neighbour nearer than d(q, p) - high or low - d(q, p). A query first
reads its own cell, which bounds the k-th distance, then only the cells that this bound leaves; within them, only rows that it leaves are compared. Cells are
folders, so others are not opened. How few are left depends on the data: vectors in clusters leave few, vectors spread evenly over many dimensions nearly all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spoor.functions.attributes import distance_to_score

#: Bytes of queries that are sent to all tasks at a time, and the most pivots.
QUERY_BYTES, MOST_CELLS = 8 << 20, 4096
_SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.cells_read = self.cells = 0

    def build(self, vectors: DataFrame, cells: int = 64) -> None:
        """Write the index of vectors(vec_id, embedding, ...); other columns can be filtered by. Pivots are at most so many of the vectors, those whose hash is least.

        Null ids and embeddings are left out, as are vectors of another length than most have or with null or non-finite components; vectors that repeat are all kept."""
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        known = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(whole)
        most = known.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        known = known.where(F.size("embedding") == (most.dims if most else 0))
        chosen = known.select("vec_id", "embedding", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(min(cells, MOST_CELLS)).collect()
        pivots = np.array([r.embedding for r in chosen], float).reshape(len(chosen), most.dims if most else 0)
        self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>").coalesce(1).write.parquet(f"{self.folder}/pivots")
        sent, schema = self.spark.sparkContext.broadcast(pivots), StructType([*known.schema.fields])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("embedding"))
                best, cell = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
                for i, p in enumerate(sent.value):
                    d = _distances(x, p)
                    cell[d < best] = i
                    best = np.minimum(best, d)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(cell)], names=[*batch.schema.names, "to_pivot", "cell"])

        placed = known.mapInArrow(place, schema.add("to_pivot", "double").add("cell", "integer"))
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.folder}/vectors")
        rows = self.spark.read.parquet(f"{self.folder}/vectors") if len(pivots) else placed
        rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("low"), F.max("to_pivot").alias("high")).write.parquet(f"{self.folder}/cells")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, match: str | None = None) -> DataFrame:
        """(query_id, rank, vec_id, distance, score): the k nearest vectors of each of queries(query_id, embedding), ties by vec_id, among those that where holds for, and of those that have the query's
        own value of the column match, if one is given (null matches null). Null query ids or embeddings, and queries of another length than the vectors', find nothing. Queries go in blocks
        of about QUERY_BYTES. cells_read counts the cells that the blocks opened, of cells in all for each block."""
        pivots = np.array([r.pivot for r in self.spark.read.parquet(f"{self.folder}/pivots").orderBy("cell").collect()], float)
        stats = {r.cell: r for r in self.spark.read.parquet(f"{self.folder}/cells").collect()}
        columns = ["query_id", "embedding", *([match] if match else [])]
        known = queries.where("query_id is not null and embedding is not null").where(F.size("embedding") == (pivots.shape[1] if len(pivots) else -1)).select(*columns)
        size = known.agg(F.sum(F.size("embedding") * 8 + 100)).first()[0] or 0
        blocks, found = max(1, -(-size // QUERY_BYTES)), self.spark.createDataFrame([], "query_id long, vec_id long, distance double")
        self.cells_read, self.cells = 0, len(stats) * blocks
        for b in range(blocks if stats else 0):
            own = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if own:
                found = found.union(self._block(own, pivots, stats, k, where, match))
        order = "row_number() over (partition by query_id order by distance, vec_id)"
        ranked = found.selectExpr("query_id", f"cast({order} as int) as rank", "vec_id", "distance").where(F.col("rank") <= k)
        return ranked.withColumn("score", distance_to_score(F.col("distance")))

    def _block(self, own: list, pivots: np.ndarray, stats: dict, k: int, where: Column | None, match: str | None) -> DataFrame:
        q = np.array([r.embedding for r in own], float)
        to_pivots = np.array([_distances(pivots, x) for x in q])
        cells = np.array(sorted(stats))
        low, high = (np.array([stats[c][name] for c in cells]) for name in ("low", "high"))
        at_least = np.maximum(0, np.maximum(to_pivots[:, cells] - high, low - to_pivots[:, cells])) * (1 - _SLACK) - _SLACK
        home = cells[np.argmin(to_pivots[:, cells], axis=1)]
        first = self._scan(own, q, to_pivots, k, np.full(len(own), np.inf), [(int(c), np.flatnonzero(home == c)) for c in np.unique(home)], where, match)
        bound = np.full(len(own), np.inf)
        kept = _merge(first.collect(), len(own), k)  # at most k rows of each of a block's queries
        for i, rows in enumerate(kept):
            if len(rows) == k:
                bound[i] = rows[-1][0]
        left = [(int(c), np.flatnonzero((at_least[:, j] <= bound) & (home != c))) for j, c in enumerate(cells)]
        left = [(c, some) for c, some in left if len(some)]
        self.cells_read += len({int(c) for c in home} | {c for c, _ in left})
        more = self._scan(own, q, to_pivots, k, bound, left, where, match)
        names = self.spark.createDataFrame([(i, int(r.query_id)) for i, r in enumerate(own)], "i int, query_id long")
        near = self.spark.createDataFrame([(i, v, d) for i, rows in enumerate(kept) for d, v in rows], "i int, vec_id long, distance double")
        return near.union(more).join(F.broadcast(names), "i").select("query_id", "vec_id", "distance")

    def _scan(self, own: list, q: np.ndarray, to_pivots: np.ndarray, k: int, bound: np.ndarray, cells: list[tuple[int, np.ndarray]], where: Column | None, match: str | None) -> DataFrame:
        """(i, vec_id, distance): of each task the k best rows of each query in its cells."""
        rows = self.spark.read.parquet(f"{self.folder}/vectors").where(F.col("cell").isin([c for c, _ in cells]))
        rows = rows if where is None else rows.where(where)
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "to_pivot", "cell", *([F.col(match).cast("string").alias("value")] if match else []))
        wanted = [None if not match else (None if r[match] is None else str(r[match])) for r in own]
        sent = self.spark.sparkContext.broadcast((q, to_pivots, bound, dict(cells), wanted if match else None))
        return rows.mapInArrow(_nearest(sent, k), "i int, vec_id long, distance double")


def _merge(rows: list, n: int, k: int) -> list[list[tuple[float, int]]]:
    found: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for i, v, d in rows:
        found[i].append((d, v))
    return [sorted(x)[:k] for x in found]


def _nearest(sent, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, to_pivots, bound, asked, wanted = sent.value
        bound, best = bound.copy(), {}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell):
                part = batch.filter(pa.array(cell == c))
                x, ids, at = _matrix(part.column("embedding")), part.column("vec_id").to_numpy(), part.column("to_pivot").to_numpy()
                values = None if wanted is None else np.array([str(v) if v is not None else None for v in part.column("value").to_pylist()], object)
                for i in asked.get(int(c), ()):
                    near = np.abs(to_pivots[i, c] - at) * (1 - _SLACK) - _SLACK <= bound[i]
                    if values is not None:
                        near &= values == wanted[i]
                    rows = np.flatnonzero(near)
                    if not len(rows):
                        continue
                    d = _distances(x[rows], q[i])
                    if len(d) > k:
                        some = d <= np.partition(d, k - 1)[k - 1]
                        d, rows = d[some], rows[some]
                    both = sorted([*best.get(i, ()), *zip(d.tolist(), ids[rows].tolist())])[:k]
                    best[i] = both
                    if len(both) == k:
                        bound[i] = min(bound[i], both[-1][0])
        out = [(i, v, d) for i, rows in best.items() for d, v in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, (pa.int32(), pa.int64(), pa.float64()))], names=["i", "vec_id", "distance"])

    return run
