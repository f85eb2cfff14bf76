"""Cases that the derived tables don't hold: cut names, citation forms, headings, path flags, unknown input."""

from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.operators import answers, catalogue, dashboards, retrieval


def column(spark, values, build, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(build(F.col("v"))).collect()]


def test_process_names_may_be_cut(spark):
    seen = ["MsMpEng.exe", "msedgewebview2", "msedge", "", None, "other.exe"]
    assert column(spark, seen, lambda v: catalogue.process_name_matches(v, "msedgewebview2.exe")) == [False, True, False, False, False, False]
    assert column(spark, seen, lambda v: catalogue.security_product(v, [("msmpeng.exe", "D"), ("msmpeng.exe", "E")])) == ["D", None, None, None, None, None]


def test_citation_forms(spark):
    raw = ["[1]", "[4,5]", "[1-3]", "[1]-[3]", "[9] [2] [2]", "[3-1]", None, "x [1–2]\nConfidence: 240\n", "[1-99999999999999999999]", "[1-2-3]"]
    rows = spark.createDataFrame([(i, r, 5) for i, r in enumerate(raw)], "i int, raw string, n_evidence int")
    found = answers.parse_citations(rows).orderBy("i").select("citations", "confidence", "answer").collect()
    assert [r[0] for r in found] == [[1], [4, 5], [1, 2, 3], [1, 2, 3], [2], [], [], [1, 2], [1, 2, 3, 4, 5], []]
    assert found[7][1:] == (100, "x [1–2]") and found[0][1] is None


def test_assessment(spark):
    texts = ["FINDING\na\n**ASSESSMENT**\nStrong but limited.\n## GAPS\nnone", "no heading", "ASSESSMENT:\nclearly", None, "ASSESSMENT\n\nGAPS\nweak"]
    assert column(spark, texts, answers.assessment) == ["Strong but limited.", "", "clearly", "", ""]
    assert column(spark, texts, lambda v: answers.assessment_band(answers.assessment(v))) == [35, 50, 85, 50, 50]


def test_calibration_ceilings(spark):
    asked = spark.createDataFrame([(1, "ASSESSMENT\nclearly", False, 0, 0, None), (2, "ASSESSMENT\nclearly", False, 1, 2, None), (3, "x", False, 0, 0, None), (4, "ASSESSMENT\nclearly", True, 0, 0, 10)], "question_id int, answer string, insufficient boolean, unavailable_sources int, total_sources int, prior int")
    cited = spark.createDataFrame([(1, "HIGH"), (2, "low"), (4, None)], "question_id int, risk_level string")
    assert [r.confidence for r in answers.calibrate(asked, cited).orderBy("question_id").collect()] == [95, 70, 25, 10]


def test_intent(spark):
    q = ["What did evil.exe (PID 42) do?", "thread id: 9, any suspicious registry keys", None, "process named 'foo.bar'"]
    found = answers.detect_intent(spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, question string")).orderBy("i").collect()
    assert [(r.pid, r.tid, r.process_names, r.suspicious) for r in found] == [("42", None, ["evil.exe"], False), (None, "9", [], True), (None, None, [], False), (None, None, ["foo.bar"], False)]
    assert found[0].families == ["cmdline", "malfind", "pslist", "pstree"] and found[1].families == ["printkey"]


def test_derived_suspicion(spark):
    rows = [("pslist", '{"path": "C:\\\\Windows\\\\Temp\\\\a.exe"}'), ("dlllist", '{"name": "c:\\\\users\\\\public\\\\a.dll"}'), ("netscan", '{"foreignaddr": "9.9.9.9", "foreignport": 4444}'), ("netscan", '{"foreignaddr": "::"}'), ("malfind", "no json"), ("cmdline", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, v string")
    found = df.orderBy("i").select(retrieval.derive_suspicion(F.col("f"), A.parse_attributes(F.col("v")))).collect()
    assert [r[0] for r in found] == [["executable-in-suspicious-location"], ["module-in-suspicious-location"], ["external-network-connection", "connection-to-port-4444"], [], [], []]


def test_thread_lookup(spark):
    rows = [(1, "handles", '{"type": "Thread", "handlevalue": "321"}'), (2, "handles", '{"type": "File", "handlevalue": "321"}'), (3, "pslist", '{"tid": 321}'), (4, "info", "text"), (5, "info", None)]
    df = spark.createDataFrame([("I", *r) for r in rows], "investigation_id string, id int, artifact_type string, artifact_value string")
    assert [r.id for r in retrieval.fetch_tid(df, "321").orderBy("id").collect()] == [1, 3]


def test_ports_need_other_signs(spark):
    rows = [(1, "I", "netscan", '{"foreignport": 7070}'), (2, "J", "netscan", '{"foreignport": 7070}'), (3, "I", "pslist", '{"imagefilename": "ANYTOOL.exe", "pid": 5}')]
    df = spark.createDataFrame(rows, "id int, investigation_id string, artifact_type string, artifact_value string").withColumn("a", A.parse_attributes(F.col("artifact_value")))
    hits = catalogue.match_tools(df, F.col("a"), [catalogue.Tool("AnyTool", processes=("anytool.exe",), ports=(7070,))])
    assert sorted((r.investigation_id, r.id, r.strength) for r in hits.collect()) == [("I", 1, "network"), ("I", 3, "executed")]


def test_events(spark):
    rows = [(1, "windows.netscan", '{"proto": "TCPv4", "localaddr": "1.1.1.1", "localport": 1, "foreignaddr": "2.2.2.2", "foreignport": 2, "pid": 3, "created": "2024-01-01T00:00:00+00:00"}', "completed"), (2, "windows.pslist", '{"pid": 4, "createtime": "1970-01-01T00:00:00"}', "completed"), (3, "windows.pslist", '{"pid": 4, "createtime": "2024-01-01T00:00:00"}', "failed")]
    df = spark.createDataFrame([("I", *r) for r in rows], "investigation_id string, id int, plugin string, v string, execution_status string")
    found = dashboards.timeline_events(df, A.parse_attributes(F.col("v"))).collect()
    assert [(r.id, r.description) for r in found] == [(1, "connection TCPv4 1.1.1.1:1 -> 2.2.2.2:2 [n/a] (PID 3)")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "investigation_id string, id int, plugin string, artifact_type string, artifact_value string, risk_level string, confidence_score int")
    assert retrieval.fetch_general(empty, 5).count() == 0 and dashboards.high_priority_findings(empty).count() == 0 and dashboards.evidence_summary(empty).count() == 0
