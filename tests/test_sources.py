from spoor.sources import evidence as S
from spoor.streaming.ingest import stream_ingest


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "windows.pslist.json").write_text('[{"PID": 4}, 7, {"PID": 5, "__children": []}]')
    (folder / "windows.netscan.json").write_text("{not json")
    rows = S.normalize_evidence(S.read_plugin_output(spark, str(folder / "windows.pslist.json"), "windows.pslist"))
    assert [r.artifact_type for r in rows.collect()] == ["pslist", "pslist"]
    assert S.read_plugin_output(spark, str(folder / "windows.netscan.json"), "x").count() == 0
    S.write_evidence(rows, str(tmp_path / "out"), truncate_at=5)
    assert {r.artifact_value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {'{"PID'}
    for _ in range(2):  # the second run finds nothing new
        stream_ingest(spark, str(folder), str(tmp_path / "sink"), str(tmp_path / "mark"), str(tmp_path / "told")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "sink")).collect()
        assert len(found) == 2 and {r.plugin for r in found} == {"windows.pslist"} and found[0].attributes["pid"] in "45"
        assert sorted((r.file.rsplit("/")[-1], r.accepted, r.rows) for r in spark.read.parquet(str(tmp_path / "told")).collect()) == [("windows.netscan.json", False, 0), ("windows.pslist.json", True, 2)]


def test_indicator_sets(spark, tmp_path):
    from spoor.sources.evidence import load_indicator_sets

    given = {"a.json": '{"name": "A", "source": "desk", "networks": ["10.0.0.0/8", " 1.2.3.4 ", "", null]}', "b.json": '{"networks": ["2001:db8::/32"]}', "c.json": "{broken", "d.json": "[1]", "e.json": '{"name": "E", "networks": []}', "f.txt": '{"networks": ["9.9.9.9"]}'}
    for name, text in given.items():
        (tmp_path / name).write_text(text)
    found = sorted(tuple(r) for r in load_indicator_sets(spark, str(tmp_path)).collect())
    assert found == [("a.json", "A", "desk", "1.2.3.4"), ("a.json", "A", "desk", "10.0.0.0/8"), ("b.json", "b", "b.json", "2001:db8::/32")]


def test_formats(spark):
    from pyspark.sql import functions as F

    from spoor.functions import attributes as A

    rows = spark.createDataFrame([(0.0, 0), (5.25, 1023), (65.0, 1024), (3599.4, 5 << 20), (None, None), (60.0, 3 << 40)], "s double, b long")
    found = [tuple(r) for r in rows.select(A.format_duration(F.col("s")), A.format_size(F.col("b"))).collect()]
    assert found == [("N/A", "0 B"), ("5.2s", "1023 B"), ("1m 5s", "1.00 KB"), ("59m 59s", "5.00 MB"), (None, None), ("1m 0s", "3.00 TB")]
