import random
import tempfile

import pytest
from pyspark.sql import functions as F

from spoor.operators import classify
from spoor.state.entity_index import EntityIndex
from spoor.state.store import Store, Table

THINGS = {"things": Table("id long, grp string, value string", ("id",), ("grp",)), "seen": Table("id long", ("id",), ("id",), grows=True)}


def store(spark):
    return Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), THINGS, buckets=4)


def rows(s, name="things"):
    return sorted(tuple(r) for r in s.read(name).collect())


def frame(spark, data, schema="id long, grp string, value string"):
    return spark.createDataFrame(data, schema)


def test_upserts_deletes_and_repeated_batches(spark):
    s = store(spark)
    assert rows(s) == [] and s.version() == 0
    for _ in range(2):  # the second time changes nothing
        change = s.begin(0)
        if change:
            assert sorted(tuple(r) for r in change.put("things", frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, None, None)])).collect()) == [(1, "a", "x"), (2, "b", "y"), (3, None, None)]
            change.put("seen", frame(spark, [(1,)], "id long"))
            assert change.commit() == 1
    change = s.begin(1)
    change.put("things", frame(spark, [(2, "b", "z"), (4, "a", "w")]))
    change.put("things", frame(spark, [(1, "a")], "id long, grp string"), deleted=True)
    change.commit()
    assert sorted(rows(s), key=lambda r: r[0]) == [(2, "b", "z"), (3, None, None), (4, "a", "w")] and rows(s, "seen") == [(1,)]
    assert s.begin(1) is None and s.begin(0) is None and s.begin(0, "other") is not None
    a = s.buckets_in("things", frame(spark, [(9, "a", "")]))
    assert sorted(r.id for r in s.read("things", a).collect() if r.grp == "a") == [4]


def test_a_transaction_that_is_lost_or_late_changes_nothing(spark):
    s = store(spark)
    lost = s.begin(0)
    lost.put("things", frame(spark, [(1, "a", "half")]))  # and never committed
    assert rows(s) == []
    first, second = s.begin(0), s.begin(0)
    first.put("things", frame(spark, [(1, "a", "first")]))
    second.put("things", frame(spark, [(1, "a", "second")]))
    first.commit()
    with pytest.raises(Exception, match="exist"):
        second.commit()
    assert rows(s) == [(1, "a", "first")]


def test_compaction_and_vacuum_keep_the_rows(spark):
    s, expected = store(spark), {}
    rng = random.Random(1)
    for batch in range(3):
        new = {rng.randrange(12): str(batch) for _ in range(5)}
        change = s.begin(batch)
        change.put("things", frame(spark, [(i, "g", v) for i, v in new.items()]))
        change.put("things", frame(spark, [(100 + batch, "g")], "id long, grp string"), deleted=True)
        change.commit()
        expected |= new
    s.compact()
    assert s.vacuum() == 6 and rows(s) == sorted((i, "g", v) for i, v in expected.items()) and s.begin(2) is None


ATTRIBUTES = (
    ("pslist", '{"PID": %d, "name": "p%d.exe", "path": "c:/temp/p%d.exe"}'),
    ("cmdline", '{"pid": %d, "cmd": "p%d.exe -x %d"}'),
    ("netscan", '{"pid": %d, "remote_ip": "9.9.9.%d", "remote_port": %d}'),
    ("malfind", '{"pid": %d, "protection": "PAGE_EXECUTE_READWRITE %d", "n": %d}'),
    ("dlllist", '{"pid": %d, "name": "c:/temp/l%d.dll", "n": %d}'),
    ("info", '{"pid": %d, "a": %d, "b": %d}'),
    ("handles", "no json %d %d %d"),
)
SCHEMA = "id long, investigation_id string, artifact_type string, artifact_value string"
OUT = ["id", "severity", "score", "indicators", "reasons", "corroborated", "families"]


def made(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        family, text = rng.choice(ATTRIBUTES)
        pid = 7 if rng.random() < 0.3 else rng.randrange(30)  # one busy process
        out.append((i, rng.choice(["A", "B", None]), family, text % (pid, rng.randrange(9), rng.randrange(3))))
    return out


def plain(df):
    return sorted((repr(tuple(r)) for r in df.select(*OUT).collect()))


def test_batches_give_what_one_run_over_all_rows_gives(spark):
    data = made(120, 5)
    index = EntityIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    known = {}
    for batch, (lo, hi) in enumerate(((0, 80), (80, 120), (40, 90))):  # the last are all known
        got = index.classify(spark.createDataFrame(data[lo:hi], SCHEMA), batch)
        changed = {r.id: (r.severity, r.score, r.families) for r in got.collect()}
        whole = {r.id: (r.severity, r.score, r.families) for r in _whole(spark, data[: max(hi, 120 if batch == 2 else hi)]).collect()}
        assert set(changed) == {i for i in whole if whole[i] != known.get(i)}  # new rows, and those that an entity's new family reaches, no others
        known |= changed
        assert known == whole
    assert index.classify(spark.createDataFrame(data[:5], SCHEMA), 2) is None
    assert plain(index.classified()) == plain(_whole(spark, data))


def _whole(spark, data):
    # null investigations are one of their own in the index
    return classify.classify_evidence(spark.createDataFrame([(i, v or "-", f, t) for i, v, f, t in data], SCHEMA))


def test_a_batch_lost_before_its_commit_is_repeated(spark, monkeypatch):
    from spoor.state import store as module

    data = made(80, 6)
    index = EntityIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    index.classify(spark.createDataFrame(data[:40], SCHEMA), 0)
    before = plain(index.classified())
    with monkeypatch.context() as m:
        m.setattr(module.Transaction, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.classify(spark.createDataFrame(data[40:], SCHEMA), 1)
    assert plain(index.classified()) == before
    index.classify(spark.createDataFrame(data[40:], SCHEMA), 1)
    assert plain(index.classified()) == plain(_whole(spark, data))


def test_rows_are_parsed_once(spark):
    rows = spark.createDataFrame(made(10, 7), SCHEMA)
    plan = classify.judged(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 6 and plan.count("AS attributes") == 1  # one projection makes the attributes, and nothing above it parses
    stored = classify.parsed(rows)
    assert plain(classify.classify_evidence(stored)) == plain(classify.classify_evidence(rows))


def documents(spark, data):
    return spark.createDataFrame(data, "id long, investigation_id string, document string")


def contents(index):
    return sorted((r.document_id, r.investigation_id, r.document) for r in index.store.read("documents").collect())


def test_sync_counts_and_stale_documents(spark):
    from spoor.state.document_index import DocumentIndex

    index = DocumentIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    first = [(1, "A", "x"), (2, "A", "y"), (3, "B", "z"), (4, "B", None), (None, "B", "lost")]
    assert index.sync(documents(spark, first), 0) == {"indexed": 4, "unchanged": 0, "removed": 0, "total": 4}
    assert index.sync(documents(spark, first), 0) is None
    assert index.sync(documents(spark, first), 1) == {"indexed": 0, "unchanged": 4, "removed": 0, "total": 4}
    assert index.sync(documents(spark, [(1, "A", "x2"), (5, "A", "new"), (1, "A", "x2")]), 2) == {"indexed": 2, "unchanged": 0, "removed": 1, "total": 2}
    assert contents(index) == [("ev-1", "A", "x2"), ("ev-3", "B", "z"), ("ev-4", "B", None), ("ev-5", "A", "new")]
    assert index.upsert(documents(spark, [(6, "B", "more")]), 0) == {"indexed": 1, "unchanged": 0, "removed": 0, "total": 1}
    assert index.remove(spark.createDataFrame([("B",)], "investigation_id string"), 0) == 3
    index.store.compact()
    assert contents(index) == [("ev-1", "A", "x2"), ("ev-5", "A", "new")]
    assert {r.evidence_id for r in index.store.read("state").collect()} == {1, 5}


def test_a_stream_killed_in_the_middle_of_a_batch_goes_on(spark, monkeypatch):
    from spoor.state import store as module
    from spoor.state.document_index import DocumentIndex

    folder, mark = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    index = DocumentIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    schema = "id long, investigation_id string, document string"
    read = lambda: spark.readStream.schema(schema).parquet(f"{folder}/in")
    documents(spark, [(i, "A", f"d{i}") for i in range(6)]).write.parquet(f"{folder}/in")
    index.stream(read(), mark).awaitTermination()
    documents(spark, [(i, "A", f"e{i}") for i in range(4, 9)]).write.mode("append").parquet(f"{folder}/in")
    for when in ("before", "after"):  # the commit, and before the stream's own checkpoint
        commit = module.Transaction.commit
        with monkeypatch.context() as m:
            m.setattr(module.Transaction, "commit", lambda self, c=commit, w=when: (c(self) if w == "after" else None, 1 / 0))
            with pytest.raises(Exception, match="division"):
                index.stream(read(), mark).awaitTermination()
        assert (("ev-8", "A", "e8") in contents(index)) == (when == "after")
    version = index.store.version()
    index.stream(read(), mark).awaitTermination()
    assert index.store.version() == version  # the batch was in the index already
    assert contents(index) == sorted([(f"ev-{i}", "A", f"d{i}") for i in range(4)] + [(f"ev-{i}", "A", f"e{i}") for i in range(4, 9)])


TEXTS = [(1, "A", "C:/Temp/Run.EXE -x"), (2, "A", "run.exe"), (3, "B", "rundll32.exe run.exe"), (4, "B", None), (5, "B", ""), (6, "A", "x"), (7, "A", "ab"), (8, "B", "aab ÉTÉ"), (9, "A", "un.e"), (9, "A", "un.e")]
TOKENS = ["run.exe", "RUN", "x", "ab", "été", "nothing", "un.exe -", "", None, "rundll32.exe run", "exe"]


def test_substrings_by_trigrams(spark):
    from spoor.state.text_index import TextIndex, match

    rows = spark.createDataFrame(TEXTS, "id long, investigation_id string, text string")
    expected = sorted({(v, i, t.lower()) for i, v, s in TEXTS for t in TOKENS if t and s and t.lower() in s.lower()})
    asked = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    index = TextIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    assert index.add(rows.where("id < 4"), 0) and not index.add(rows, 0) and index.add(rows.where("id >= 4"), 1)
    assert sorted(tuple(r) for r in index.find(asked, rows).collect()) == expected
    of = spark.createDataFrame([(v, t) for t in TOKENS for v in "AB"], "investigation_id string, token string")
    assert sorted(tuple(r) for r in match(rows, of, ["investigation_id"]).collect()) == expected
    assert index.find(asked.limit(0), rows).count() == 0


def test_text_index_names_runs_and_shuffles_no_finds(spark):
    from spoor.state.text_index import TextIndex

    rows = spark.range(4000).selectExpr("id", "concat('INV-', id % 7) AS investigation_id", """concat('{"pid": ', id % 60, ', "name": "proc', id % 10, '.exe"}') AS text""")
    tokens = ["pr", "oc1", '"pid": 4', "nothing", "7", "c3.exe"]
    index = TextIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    index.add(rows.where("id % 2 = 0"), 0)
    index.add(rows.where("id % 2 = 1"), 1)
    postings = index.store.read("postings")
    assert postings.count() < rows.count()  # a posting for each row and gram were some 75 times as many
    often = {r.gram: r.n for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    assert (often["pro"], often["oc1"], often["e"], often["}"]) == (4000, 400, 12000, 4000)
    found = index.find(spark.createDataFrame([(t,) for t in tokens], "token string"), rows)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.investigation_id, r.id, t) for r in rows.collect() for t in tokens if t in r.text)


def test_text_index_has_a_bounded_number_of_runs(spark):
    from spoor.state.text_index import RUNS, TextIndex

    rows = spark.range(3 * RUNS).selectExpr("id * 20011001 AS id", "'A' AS investigation_id", "if(id % 999 = 5, 'xyz', 'ab') AS text")
    index = TextIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    index.add(rows, 0)
    assert index.store.read("postings").where("gram = 'ab'").count() <= RUNS  # sparse ids gave each row a run of its own
    found = index.find(spark.createDataFrame([("xyz",), ("xy",)], "token string"), rows).collect()
    assert sorted((r.id, r.token) for r in found) == sorted((i * 20011001, t) for i in range(5, 3 * RUNS, 999) for t in ("xyz", "xy"))


@pytest.mark.parametrize("sliced", [False, True])
def test_text_index_with_odd_ids_and_repeated_grams(spark, monkeypatch, sliced):
    from spoor.state import text_index

    texts = [(0, "A", "xaaaaa"), (16383, "A", "banana"), (16384, "B", "anan"), (-7, "A", "nanaaa"), (None, "A", "banana split"), (1 << 40, None, "a%_a\\aa"), (64, "B", "aXa"), (64, "B", "split"), (64, "B", "SPLIT aXa"), (64, "C", "aXa"), (65, "B", "lit"), (64, "A", None)]
    tokens = ["aaaa", "ana", "nan", "anan", "banana", "%_a", "\\aa", "axa", "split", "a", "li", "t a", "zz", "aaaaaaa"]
    rows = spark.createDataFrame(texts, "id long, investigation_id string, text string")
    if sliced:
        monkeypatch.setattr(text_index, "_bytes", lambda df: 2 * text_index.BROADCAST_BYTES + 1)
    index = text_index.TextIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), buckets=4)
    index.add(rows.limit(0).unionByName(rows.where("id >= 64")), 0)
    index.add(rows.where("id IS NULL OR id < 64"), 1)
    found = index.find(spark.createDataFrame([(t,) for t in tokens], "token string"), rows).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, {(v, i, t) for i, v, s in texts for t in tokens if s and t in s.lower()}))


def test_substrings_of_events_with_null_and_negative_ids(spark):
    import duckdb

    from spoor.plans.queries import ORACLES, QUERIES

    sf = tempfile.mkdtemp(prefix="spark-")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/events.parquet' UNION ALL SELECT * REPLACE (CASE WHEN event_id < 9 THEN -1 - 2 * event_id END AS event_id) FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id < 10) TO '{sf}/events.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    found, expected = QUERIES["find_substrings"](spark, sf).collect(), c.execute(ORACLES["find_substrings"]).fetchall()
    assert any(i is None for i, _ in expected) and any(i is not None and i < 0 for i, _ in expected)
    assert sorted(repr(tuple(r)) for r in found) == sorted(map(repr, expected))


def test_progress_with_totals(spark):
    from datetime import datetime, timedelta

    from spoor.streaming.ingest import stream_progress

    folder, mark = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    t0 = datetime(2024, 1, 1)
    plan = spark.createDataFrame([("A", 3), ("B", 2)], "investigation_id string, total long")
    seen = []

    def step(events):
        data = [(v, e, t0 + timedelta(minutes=m)) for v, e, m in events]
        spark.createDataFrame(data, "investigation_id string, execution_id long, finished_at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("investigation_id string, execution_id long, finished_at timestamp").parquet(f"{folder}/in")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            found = stream_progress(stream, plan, late="10 minutes")
            put = lambda rows, _: seen.extend((r.investigation_id, r.finished, r.total, r.percent, r.complete) for r in rows.collect())
            found.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        new, seen[:] = sorted(seen, key=lambda r: (r[0] or "", r[1])), []
        return new

    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(mark).count()
    assert step([("A", 1, 0), ("A", 1, 1), ("B", 9, 1), (None, 4, 1), ("C", 5, 1)]) == [("A", 1, 3, 33, False), ("B", 1, 2, 50, False), ("C", 1, 0, 0, False)]
    assert step([("A", 2, 2), ("A", 3, 3), ("A", 1, 3)]) == [("A", 3, 3, 100, True)]
    assert step([("A", 2, 4)]) == [("A", 3, 3, 100, True)]  # a repeat that comes in time
    assert held("done") == 2  # only the open investigations' executions
    assert step([("B", 8, 60)]) == [("B", 2, 2, 100, True)]  # the watermark passes all that came before
    step([("B", 8, 120)])
    assert held("sums") <= 2 and held("done") == 1  # complete ones are forgotten; C waits for its last event
    assert step([("A", 2, 4)]) == []  # late
