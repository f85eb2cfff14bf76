from pyspark.sql import functions as F

from spoor.functions import attributes as A
from spoor.operators import networks


def test_parse_attributes(spark):
    cases = ['{"PID": 4, "pid": 5, "Name": null}', '{"a": true, "b": {"c": 1}}', "[1]", "text", "", None, "{}"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(A.parse_attributes(F.col("t")).alias("m")).collect()
    assert rows[0].m == {"pid": "5", "name": None} and rows[1].m["a"] == "true"
    assert all(r.m is None for r in rows[2:])


def test_scalars(spark):
    row = spark.range(1).select(
        *(A.normalize_pid(F.lit(x)).alias(f"p{i}") for i, x in enumerate([" 7 ", "+4", "4.0", "x"])),
        A.norm_path(F.lit(" C:\\\\Temp\\\\A.exe/ ")).alias("path"),
        *(A.is_low_information(F.lit(x)).alias(f"l{i}") for i, x in enumerate(["", "00 00 00 00", "00 00", "4d 5a 90 00", "aaaa", "text"])),
        *(A.parse_event_ts(F.lit(x)).isNull().alias(f"t{i}") for i, x in enumerate(["2024-01-01T00:00:00", "1970-01-01", "2024", "n/a"])),
        *(networks.ipv4_number(F.lit(x)).alias(f"a{i}") for i, x in enumerate(["1.2.3.4", "01.2.3.4", "256.1.1.1"])),
    ).first()
    assert [row[f"p{i}"] for i in range(4)] == ["7", "4", None, None]
    assert [row[f"l{i}"] for i in range(6)] == [True, True, False, False, True, False]
    assert [row[f"t{i}"] for i in range(4)] == [False, True, True, True]
    assert [row[f"a{i}"] for i in range(3)] == [0x01020304, None, None]
