from pyspark.sql import functions as F

from spoor.functions.attributes import parse_attributes
from spoor.operators import catalogue, lookup
from spoor.operators.answers import route_questions
from spoor.operators.fixed_catalogues import PRODUCTS, ROUTES, TOOLS

ROWS = [
    ("I", 1, "pslist", '{"imagefilename": " AnyDesk.exe", "pid": 4}'), ("I", 2, "psscan", '{"imagefilename": "screenconnect.c", "pid": 5}'), ("I", 3, "pslist", '{"imagefilename": "screenconn", "pid": 6}'),
    ("I", 4, "cmdline", '{"process": "wmic.exe", "pid": 7, "args": "wmic /NODE:host"}'), ("I", 5, "cmdline", '{"process": "cmd.exe", "pid": 8, "args": "sc.exe \\\\\\\\HOST query"}'), ("I", 6, "cmdline", '{"process": "cmd.exe", "pid": 8, "args": "sc \\\\\\\\.\\\\pipe"}'),
    ("I", 7, "cmdline", '{"process": "p.exe", "pid": 9, "args": "Enter-PSSession -ComputerName x"}'), ("I", 8, "filescan", '{"name": "\\\\Program Files\\\\WinRAR\\\\rar.txt"}'), ("I", 9, "netscan", '{"foreignaddr": "1.2.3.4", "foreignport": 7070, "state": "CLOSED"}'),
    ("I", 10, "netscan", '{"foreignaddr": "1.2.3.4", "foreignport": 5938, "state": "CLOSED"}'), ("J", 11, "netscan", '{"foreignport": 7070}'), ("J", 12, "cmdline", None), ("J", 13, "filescan", '{"name": ""}'), ("I", 14, "pslist", '{"imagefilename": "mstsc.exe"}'),
]


def evidence(spark):
    rows = spark.createDataFrame([(i, n, f"windows.{k}", k, v) for i, n, k, v in ROWS], "investigation_id string, id long, plugin string, artifact_type string, artifact_value string")
    return rows.withColumn("attributes", parse_attributes(F.col("artifact_value")))


def test_tools_of_a_table(spark):
    rows, table = evidence(spark), lookup.tool_table(spark, TOOLS)
    found = lookup.match_tools(rows, F.col("attributes"), table)
    got = {(r.id, r.tool, r.strength): r.detail for r in found.collect()}
    assert len(got) == found.count()
    assert got == {
        (1, "AnyDesk", "executed"): "process  AnyDesk.exe (PID 4) via windows.pslist", (2, "ScreenConnect / ConnectWise Control", "executed"): "process screenconnect.c (PID 5) via windows.psscan", (4, "WMI remote execution", "executed"): "command line for wmic.exe (PID 7): wmic /NODE:host",
        (5, "Service control (remote)", "executed"): "command line of cmd.exe (PID 8): sc.exe \\\\HOST query", (7, "PowerShell remoting", "executed"): "command line of p.exe (PID 9): Enter-PSSession -ComputerName x", (8, "WinRAR", "on-disk"): "file present: \\Program Files\\WinRAR\\rar.txt",
        (9, "AnyDesk", "network"): "connection to 1.2.3.4:7070 (CLOSED)", (14, "Remote Desktop client", "executed"): "process mstsc.exe (PID ) via windows.pslist",
    }
    old = catalogue.match_tools(rows, F.col("attributes"), list(TOOLS)).select("id", "tool", "strength")
    assert sorted(map(tuple, old.collect())) == sorted(got)
    listed = lookup.tool_evidence(found).where("tool = 'AnyDesk' and kind = 'id'").collect()
    assert {r.value for r in listed} == {"1", "9"}


def test_words_beyond_the_automaton_give_the_same(spark, monkeypatch):
    rows, table = evidence(spark), lookup.tool_table(spark, TOOLS)
    run = lambda: sorted(map(tuple, lookup.match_tools(rows, F.col("attributes"), table).collect()))
    near = run()
    monkeypatch.setattr(lookup, "MOST_BYTES", 0)
    assert run() == near


def test_ten_thousand_entries_leave_the_plan_as_it_is(spark):
    rows = evidence(spark)
    many = [catalogue.Tool(f"T{i}", (f"tool number {i}.exe",), (f"\\dir{i}\\",), (f"--flag{i}x",), "", (10000 + i,)) for i in range(10_000)]
    plan = lambda tools: lookup.match_tools(rows, F.col("attributes"), lookup.tool_table(spark, tools))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(many) == plan(TOOLS)


def test_products_and_routes(spark):
    products = spark.createDataFrame([(i, *p) for i, p in enumerate(PRODUCTS)], "position int, name string, product string")
    names = spark.createDataFrame([("MsMpEng.exe ",), ("securityhealths",), ("securityh",), ("procmon64.exe",), (None,), ("",), ("x.exe",)], "process string")
    found = lookup.with_security_product(names, F.col("process"), products)
    slow = names.withColumn("product", catalogue.security_product(F.col("process"), list(PRODUCTS)))
    assert sorted(map(str, found.collect())) == sorted(map(str, slow.collect())) and found.where("product is null").count() == 4
    asked = spark.createDataFrame([("Is there process hollowing?",), ("Show LSASS access",), ("beacon",), ("PowerShell -enc!",), ("service or account",), ("nothing",), ("",), (None,), ("Which processes talk to the C2 framework?",)], "question string")
    table = spark.createDataFrame([(i, q, k) for i, (q, words) in enumerate(ROUTES) for k in words], "place int, qid string, keyword string")
    got = lookup.route_questions(asked, table)
    assert sorted(map(str, got.collect())) == sorted(map(str, route_questions(asked, [(q, list(w)) for q, w in ROUTES]).collect()))
    assert {r.question: r.qid for r in got.collect()}["Is there process hollowing?"] == "Q2"
