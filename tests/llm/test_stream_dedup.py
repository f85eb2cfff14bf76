import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from spoor.llm import stream_dedup
from spoor.llm.stream_dedup import Deduplicator

SCHEMA = "doc_id long, text string, digest string, keep string, row int"


def put(spark, folder, rows, parts=1):
    spark.createDataFrame([(*r, "d", "k", 3) for r in rows], SCHEMA).coalesce(parts).write.mode("append").parquet(folder)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return [(i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


def result(found):
    return [tuple(r) for r in found.classes().select("id", "keep_id", "group_size", "digest").collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]), reverse=False)


ROWS = [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "a"), (5, "a"), (6, "x" * 200_000), (7, "x" * 200_000), (None, "a"), (None, None), (8, "A"), (9, "né"), (10, "né")]


def test_classes_over_several_batches_of_a_growing_folder(spark):
    folder, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    put(spark, f"{folder}/in", ROWS[:7])
    found = Deduplicator(spark, state)
    found.run(f"{folder}/in", most_bytes=1)  # a file a batch
    assert order(result(found)) == order(brute(ROWS[:7]))
    put(spark, f"{folder}/in", ROWS[7:])
    put(spark, f"{folder}/in", [(20 + i, "hot") for i in range(300)])
    everything = ROWS + [(20 + i, "hot") for i in range(300)]
    again = Deduplicator(spark, state)
    again.run(f"{folder}/in", most_bytes=1)
    assert order(result(again)) == order(brute(everything))
    kept = again.classes().where("kept").groupBy("digest").count()
    assert kept.where("count <> 1").count() == 0 and kept.count() == len({t or "" for _, t in everything})
    again.run(f"{folder}/in")  # nothing new
    assert order(result(again)) == order(brute(everything))


def test_equal_digests_of_unlike_texts_are_told_apart_by_their_bytes(spark):
    folder, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    weak = lambda text: F.left(F.sha2(text, 256), F.lit(1))
    rows = [(i, f"text {i % 60}") for i in range(200)]
    found = Deduplicator(spark, state, digest=weak)
    for lo in (0, 30, 120):  # unlike texts meet within a batch and across batches
        put(spark, f"{folder}/in", rows[lo : {0: 30, 30: 120, 120: 200}[lo]])
        found.run(f"{folder}/in")
    assert order([r[:3] for r in result(found)]) == order([r[:3] for r in brute(rows)])
    assert found.classes().where("kept").count() == 60


@pytest.mark.parametrize("step", ["_absorb", "_check"])
def test_a_batch_that_fails_midway_is_repeated_without_counting_twice(spark, monkeypatch, step):
    folder, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    put(spark, f"{folder}/in", ROWS[:5])
    found = Deduplicator(spark, state)
    found.run(f"{folder}/in")
    put(spark, f"{folder}/in", ROWS[5:])

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stream_dedup.Deduplicator, step, broken)
        with pytest.raises(Exception, match="lost"):
            found.run(f"{folder}/in")
    found.run(f"{folder}/in")
    assert order(result(found)) == order(brute(ROWS))


def test_an_empty_table(spark):
    folder, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    put(spark, f"{folder}/in", [])
    found = Deduplicator(spark, state)
    found.run(f"{folder}/in")
    assert result(found) == []


def test_state_is_on_disk_and_never_expires(spark):
    folder, state = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    put(spark, f"{folder}/in", ROWS)
    Deduplicator(spark, state).run(f"{folder}/in")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # the session's own setting is back
    kept = spark.read.format("statestore").load(f"{state}/state")
    assert kept.count() == len({t or "" for _, t in ROWS})
