import importlib

import corpus_pipeline

from .test_minhash import shingle_set
from .test_tokens import check_packing


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.storage.materialize(stage(spark, docs, sf), name)
        if name == "packing":
            check_packing(docs.collect(), before)
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near-dedup":  # every dropped document is linked to another, every kept pair is not
            sets = {d: shingle_set(t, 5) for d, t in before.items()}
            like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
            assert all(any(like(sets[d], sets[o]) for o in before if o != d) for d in set(before) - set(after))
            assert not any(like(sets[a], sets[b]) for a in after for b in after if a < b)
        if name == "pii":
            assert set(after) == set(before)
            import re

            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "") for t in after.values())
        before = after


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= names
