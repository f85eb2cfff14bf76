import os

from pyspark.sql import functions as F

from spoor.llm import toxicity
from spoor.llm.queries import op10_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    if not os.path.isdir(SF):
        return
    found = op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    precision, recall = n[1, 1] / (n[1, 1] + n.get((0, 1), 0)), n[1, 1] / (n[1, 1] + n.get((1, 0), 0))
    assert precision > 0.95 and recall > 0.6, n  # 255 toxic rows to learn from; 2,100 give over 0.97


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.fit_and_score(odd_docs, labels, F.lit(True))
    rows = found.collect()
    assert len(rows) == odd_docs.count() and found.columns == [*(c for c in odd_docs.columns if c != "score"), "score"]
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = toxicity.fit_and_score(odd_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity.fit_and_score(odd_docs.limit(0), labels, F.lit(True)).count() == 0
