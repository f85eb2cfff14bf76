import json
import random

import pytest

from spoor.sources.split_json import read_arrays


@pytest.fixture
def small_ranges(spark):
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{name}", "64")
    yield spark
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return rng.choice(["", "a", "}{", "][", '"', "\\", '\\"}', "é日", "x" * 50, "\n"])
    if kind < 5:
        return rng.choice([None, True, 0, -1.5, 12345])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc{}") + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def put(tmp_path, texts):
    for i, text in enumerate(texts):
        (tmp_path / f"f{i:03d}.json").write_bytes(text if isinstance(text, bytes) else text.encode())


def expected(text):
    try:
        found = json.loads(text.decode(errors="replace") if isinstance(text, bytes) else text)
    except ValueError:
        return None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else None


def check(spark, tmp_path, texts):
    put(tmp_path, texts)
    rows, verdicts = read_arrays(spark, [str(tmp_path)])
    got = {}
    for r in rows.collect():
        got.setdefault(r.file[-8:-5], []).append(json.loads(r.row))
    key = lambda x: json.dumps(x, sort_keys=True)
    told = {r.file[-8:-5]: (r.accepted, r.rows) for r in verdicts.collect()}
    assert len(told) == verdicts.count() == len(texts)
    for i, text in enumerate(texts):
        want = expected(text)
        assert told[f"{i:03d}"] == (want is not None, len(want or ())), text
        assert sorted(got.get(f"{i:03d}", []), key=key) == sorted(want or [], key=key), text


def test_random_arrays_across_ranges(small_ranges, tmp_path):
    rng = random.Random(1)
    texts = [json.dumps([value(rng) for _ in range(rng.randrange(12))], indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for _ in range(12)]
    check(small_ranges, tmp_path, texts)


def test_flaws_reject_the_whole_file(small_ranges, tmp_path):
    whole = '[{"a": "}x"}, 7, [{"b": 1}], {"c": {"d": "\\"]"}}]'
    texts = [whole[:i] for i in range(0, len(whole) + 1, 3)] + [whole]  # each lost tail
    texts += [whole + " \n", whole + "x", whole + "]", "x" + whole, "[" + whole + "]", '{"a": {"b": 1}}', "7", '[{"a": 1} {"b": 2}]', '[{"a": 1},, {"b": 2}]', '[{"a": 1}.5, {"b": 2}]', '[{"a": 1},]', '[{"a"}]', '[{"a": 1}}, {"b": 2}]', "[]", " [ ] ", "[1, 2]", b'[{"a": "\xff}"}]', '[{"a": 1}] [{"b": 1}]', '[{"a": 1}], [{"b": 1}]', "﻿[]"]
    check(small_ranges, tmp_path, texts)


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"id": i, "children": [], "text": "} " * (i % 50)} for i in range(20_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    try:
        from spoor.sources.split_json import fragments

        assert fragments(spark, [str(tmp_path)]).rdd.getNumPartitions() >= 8
        rows, verdicts = read_arrays(spark, [str(tmp_path)])
        assert verdicts.collect()[0][1:] == (True, 20_000)
        assert rows.selectExpr("get_json_object(row, '$.id') AS id").distinct().count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
