import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.sources import evidence as S
from spoor.state import vector_index
from spoor.state.vector_index import VectorIndex


def made(seed, n=600, spread=0.05, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return [(i, (centres[rng.integers(12)] + spread * rng.normal(size=dims)).astype(np.float32).tolist(), rng.choice(["A", "B", None])) for i in range(n)]


def brute(rows, queries, k, keep=lambda r, q: True):
    out = []
    for q, x, v in queries:
        near = sorted((float(np.sqrt(((np.array(y, float) - np.array(x, float)) ** 2).sum())), i) for i, y, w in rows if keep((i, y, w), (q, x, v)))
        out += [(q, r, i, round(1 / (1 + d), 4)) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, investigation_id string"


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_nearest_of_brute_force_from_few_cells(spark, spread, monkeypatch):
    rows = made(1, spread=spread)
    queries = [(i, x, v) for i, x, v in rows if i % 40 == 0]
    index = VectorIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"))
    odd = [(None, [0.0] * 8, "A"), (900, None, "A"), (901, [1.0], "A"), (902, [float("nan")] * 8, "A"), (903, [], "A")]
    index.build(spark.createDataFrame(rows + odd, SCHEMA), cells=24)
    asked = spark.createDataFrame(queries + odd[:2] + [(901, [1.0], "A")], "query_id long, embedding array<float>, investigation_id string")
    got = lambda **how: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in index.search(asked, 5, **how).collect())
    assert got() == brute(rows, queries, 5)
    if spread < 1:  # twelve clusters in 24 cells: each query of a cluster opens a cell or two
        one = spark.createDataFrame(queries[:1], "query_id long, embedding array<float>, investigation_id string")
        index.search(one, 5).collect()
        assert index.cells_read <= 4 and index.cells == 24  # pivots are rows, so no cell is empty
    assert got(where=F.col("vec_id") % 3 == 0) == brute(rows, queries, 5, lambda r, q: r[0] % 3 == 0)
    assert got(match="investigation_id") == brute(rows, queries, 5, lambda r, q: r[2] == q[2])
    monkeypatch.setattr(vector_index, "QUERY_BYTES", 500)
    assert got() == brute(rows, queries, 5)


def test_few_vectors_and_none(spark):
    index = VectorIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"))
    index.build(spark.createDataFrame([(1, [0.0, 0.0], None), (2, [0.0, 0.0], None)], SCHEMA), cells=8)
    asked = spark.createDataFrame([(7, [3.0, 4.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.distance, r.score) for r in index.search(asked, 5).orderBy("rank").collect()] == [(1, 5.0, 0.1667), (2, 5.0, 0.1667)]
    empty = VectorIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"))
    empty.build(spark.createDataFrame([], SCHEMA))
    assert empty.search(asked, 5).count() == 0


def rows_scanned(df):
    """Rows that the scan itself gave, after files and row groups were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/e"
    n = 60_000
    made = spark.range(n).select("id", F.concat(F.lit("I"), (F.col("id") % 3).cast("string")).alias("investigation_id"), F.lit("pslist").alias("artifact_type"), F.format_string('{"PID": %d, "text": "%s"}', F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") * 7 + 1), F.sha2(F.col("id").cast("string"), 512)).alias("artifact_value"))
    S.write_clustered(made, folder, row_group_bytes=256 << 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        stored = spark.read.parquet(folder)
        assert stored.count() == n
        found = S.lookup_pid(stored, "299")
        assert [r.id for r in found.collect()] == [299] and rows_scanned(found) < n / 5
        found = S.lookup_ids(stored, "I1", [1, 4, 31])
        assert sorted(r.id for r in found.collect()) == [1, 4, 31] and rows_scanned(found) < n / 5
        assert rows_scanned(S.lookup_pid(stored, "no such")) < n / 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.id for r in S.page_of(stored, "I2", 8, 3).collect()] == [11, 14, 17]
