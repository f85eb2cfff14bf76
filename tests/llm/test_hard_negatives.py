import numpy as np
import pytest

from spoor.llm import hard_negatives
from spoor.llm.hard_negatives import Block, _pack, mine, scaled

SCHEMA = "vec_id long, label long, embedding array<float>, score double, rank int"


def brute(rows):
    seen = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen[(i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))] = 1
    rows, out = sorted(seen), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in rows:
        if i % 50:
            continue
        others = sorted(((-dot(v, w), j, m) for j, m, w in rows if j != i))
        for p, j, _ in [o for o in others if o[2] == label][:5]:
            fit = [(s, n) for s, n, m in others if m != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fit[:3], 1)]
    return sorted(out)


def run(spark, rows):
    found = scaled(spark.createDataFrame([(i, label, v and [x if x is None else float(x) for x in v], 0.5, 1) for i, label, v in rows], SCHEMA))
    return sorted(tuple(r) for r in mine(found, found.where("vec_id % 50 = 0")).collect())


def clustered(n, dims, seed, spread=0.15, lengths=(1.0,)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(8)] + spread * rng.normal(size=dims) * np.sqrt(dims)
        rows.append((i, int(rng.integers(4)), (v / np.linalg.norm(v) * lengths[i % len(lengths)]).tolist()))
    return rows


@pytest.mark.parametrize("lengths", [(1.0,), (0.2, 1.0, 3.0)])
def test_rows_of_brute_force(spark, lengths):
    rows = clustered(700, 16, 1, lengths=lengths)
    assert run(spark, rows) == brute(rows)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = clustered(60, 4, 2) + [(100, 0, [1.0, 0, 0, 0])] + [(200 + i, i % 2, [0.5, 0.0, 0.0, 0.0]) for i in range(40)]  # all tie for anchor 100
    rows += [rows[3]] * 4 + [(50, 1, [0.1, 0.2, 0.3, 0.4]), (50, 1, [0.0, 0.0, 0.0, 0.0]), (400, 2, [0.0] * 4), (450, 3, [-1.0] * 4)]
    rows += [(None, 1, [1.0, 0, 0, 0]), (500, None, [1.0, 0, 0, 0]), (550, 1, None), (600, 1, [float("nan"), 0, 0, 0]), (650, 1, [None, 0, 0, 0]), (700, 1, [float("inf"), 0, 0, 0])]
    rows += [(750, 1, [0.7, 0.7]), (800, 1, []), (850, 9, [1.0, 0, 0, 0])]  # shorter, empty, alone in its label
    assert run(spark, rows) == brute(rows)


def test_large_components_are_scored_in_whole_numbers(spark):
    rows = [(i, i % 2, [200_000.0 + i, 150_000.0 - i, 1.0]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_no_rows_no_anchors(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []


def test_small_blocks_and_chunks_give_the_same(spark, monkeypatch):
    rows = clustered(400, 8, 3, lengths=(0.5, 1.0))
    whole = run(spark, rows)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 600)
    assert run(spark, rows) == whole == brute(rows)


def test_pruning_reads_few_rows_and_loses_none():
    import pyarrow as pa

    rows = clustered(3000, 16, 4, spread=0.05)
    table = pa.table({"vec_id": [r[0] for r in rows], "label": [0] * len(rows), "v": [[int(np.floor(256 * x)) for x in r[2]] for r in rows]})
    packed = _pack(table).to_pylist()[0]
    block = Block(*packed.values())
    a = block.vectors[::100]
    lengths, exact = np.sqrt((a.astype(float) ** 2).sum(axis=1)), block.scores(a)
    least = (0.97 * lengths * block.longest).astype(np.int64)
    read, found = 0, {}
    for some, rows_ in block.feasible(a / lengths[:, None], lengths, least):
        for i in some:
            found[int(i)] = set(range(len(block.ids))) if rows_ is None else set(map(int, rows_))
            read += len(found[int(i)])
    for i in range(len(a)):
        assert set(map(int, np.flatnonzero(exact[i] >= least[i]))) <= found.get(i, set())
    assert read < 0.25 * len(a) * len(block.ids)
