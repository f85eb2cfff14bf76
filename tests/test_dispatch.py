from pyspark.sql import functions as F

from spoor.functions.attributes import parse_attributes
from spoor.operators import dispatch


def test_each_route(spark):
    rows = [
        ("I", 1, "pslist", "low", '{"pid": 7, "name": "a.exe"}'),
        ("I", 2, "handles", "low", '{"processid": 7, "type": "Thread", "handlevalue": "5"}'),
        ("I", 3, "cmdline", "low", '{"pid": 8, "cmd": "run a.exe"}'),
        ("I", 4, "dlllist", None, '{"pid": 9, "name": "x.dll", "tid": 5}'),
        ("I", 5, "malfind", "high", '{"pid": 9}'),
        ("J", 6, "info", None, None),
    ]
    evidence = spark.createDataFrame(rows, "investigation_id string, id long, artifact_type string, risk_level string, artifact_value string").withColumn("attributes", parse_attributes(F.col("artifact_value")))
    texts = [("I", "pid 7 of a.exe?"), ("I", "thread 5?"), ("I", "a.exe?"), ("I", "anything suspicious?"), ("I", "which modules and handles?"), ("I", None), ("J", "any threats?"), ("K", "hello"), (None, "hello"), ("I", "pid 99")]
    asked = spark.createDataFrame([(i, v, t, 1) for i, (v, t) in enumerate(texts)], "question_id long, investigation_id string, question string, pid int")
    found = {}
    for r in dispatch.retrieve(asked, evidence, F.col("attributes"), 2).orderBy("question_id", "rank").collect():
        found.setdefault((r.question_id, r.route), []).append(r.id)
    assert found == {(0, "pid"): [1, 2], (1, "tid"): [2, 4], (2, "names"): [1, 3], (3, "suspicious"): [5], (4, "types"): [2, 4], (5, "general"): [1, 3], (6, "suspicious"): [6]}
    assert dispatch.retrieve(asked.limit(0), evidence, F.col("attributes"), 2).count() == 0


def test_routed_plugins_entities_and_pinned_rows(spark):
    rows = [(i, "I", p, p.split(".")[1], r, v) for i, p, r, v in (
        (1, "windows.pslist", "low", '{"pid": 4, "name": "system"}'), (2, "windows.pslist", "low", '{"pid": 9, "name": "LSASS.exe"}'), (3, "windows.pslist", "high", '{"pid": 5}'), (4, "windows.pslist", None, "lsass text"),
        (5, "windows.netscan", "medium", '{"pid": 5}'), (6, "windows.netscan", "low", None), (7, "windows.handles", "low", '{"pid": 7}'),
    )] + [(8, "J", "windows.pslist", "pslist", "low", '{"name": "other"}')]
    evidence = spark.createDataFrame(rows, "id long, investigation_id string, plugin string, artifact_type string, risk_level string, artifact_value string").withColumn("attributes", parse_attributes(F.col("artifact_value")))
    both = ["windows.netscan", "windows.pslist"]
    asked = spark.createDataFrame(
        [
            (0, "I", "pid 7", both, ["lsass"], None),
            (1, "I", "pid 7", both, None, [7, 3, 8, 99]),  # 8 is of another investigation
            (2, "I", "pid 7", ["windows.svcscan"], None, None),  # nothing there: by intent
            (3, "I", "pid 7", [], None, [1]),  # not routed
            (4, "I", "pid 7", ["windows.svcscan"], None, [6]),  # only pinned
            (5, "J", "hello", both, ["th"], None),
            (6, "I", "pid 7", ["windows.pslist", "windows.pslist", None], ["", None, "ab"], None),
        ],
        "question_id long, investigation_id string, question string, plugins array<string>, entities array<string>, pinned array<long>",
    )
    found = {}
    for r in dispatch.retrieve(asked, evidence, F.col("attributes"), 4).orderBy("question_id", "rank").collect():
        found.setdefault((r.question_id, r.route), []).append(r.id)
    assert found == {
        (0, "plugins"): [5, 2, 6, 4], (1, "plugins"): [7, 3, 5, 6], (2, "pid"): [7], (3, "pid"): [7], (4, "plugins"): [6], (5, "plugins"): [8], (6, "plugins"): [3, 1, 2, 4],
    }
    shown = dispatch.shaped(dispatch.retrieve(asked.where("question_id = 2"), evidence.withColumn("confidence_score", F.lit(100)), F.col("attributes"), 4), evidence.withColumn("confidence_score", F.lit(100)), F.col("attributes")).first()
    assert shown.pid == "7" and shown.score == 1.0 and "plugin: windows.handles" in shown.document
