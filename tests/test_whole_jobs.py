from spoor.operators import reports
from spoor.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_vector_is_searched(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = {r.vec_id for r in vectors.where("vec_id % 50 = 0").collect()}
    found = QUERIES["vector_search_all"](spark, SF).collect()
    assert len(asked) > 1 and {r.query_id for r in found} == asked and len(found) == 20 * len(asked)


def test_blocks_ties_and_odd_vectors(spark):
    rows = [(i, [float(i // 2), 0.0]) for i in range(8)] + [(20, None), (None, [0.0, 0.0]), (21, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = reports.vector_search_all(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 3, block=2).collect()
    near = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in found}}
    assert near == {**{q: sorted(range(8), key=lambda v: (abs(v // 2 - q // 2), v))[:3] for q in range(8)}, 21: [21]}


def test_all_evidence_counts_for_unavailable_plugins(spark):
    found = QUERIES["unavailable_plugins_all"](spark, SF).collect()
    assert {r.plugin_name for r in found} == {"windows.pstree"}  # the one plugin without rows
