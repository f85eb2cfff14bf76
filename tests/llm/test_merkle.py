import hashlib
import random

from pyspark.sql import functions as F

from spoor.llm import merkle

SCHEMA = "id long, grp string, leaf string, seen string, root string, word int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, the siblings below each level of every leaf, as pairs of lists left and right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % 3
            paths[i].append((level[run:a], level[a + 1 : run + 3]))
        level = [sha("".join(level[j : j + 3])) for j in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        made[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
    below = {g: tree([r[2] for r in made[g]]) for g in names}
    root, tops = tree([below[g][0] for g in names]) if names else (None, [])
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(made[g], below[g][1]):
            h, sides = r[3], path + top
            for left, right in sides:
                h = sha("".join(left) + h + "".join(right))
            out.append((r[0], r[2], below[g][0], root, sha("".join("".join(x + y) for x, y in sides)), h, h == root))
    return out


def check(spark, rows):
    data = [(*r, "x", 1) for r in rows]
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(data, SCHEMA)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def row(i, grp, rng, changed=False):
    leaf = sha(f"{i}{grp}{rng.random()}")
    return i, grp, leaf, sha(leaf + "!") if changed else leaf


def test_ranks_of_dense_sparse_and_negative_ids_over_several_rounds(spark):
    rng = random.Random(3)
    rows = [row(i, "hot", rng, i % 7 == 0) for i in range(900)]  # two rounds of blocks
    rows += [row(i, "sparse", rng) for i in {rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)} | {-(1 << 63), (1 << 63) - 1, 63, 64, -1}]
    rows += [row(i, g, rng, i == 5) for g in ("", "Z", "a", "é", "𝄞", "￿", None) for i in range(5, 5 + rng.randrange(1, 6))]
    got = check(spark, rows)
    assert {r[6] for r in got if r[0] is not None and r[0] % 7} == {True, False} and sum(not r[6] for r in got) == sum(r[2] != r[3] for r in rows)


def test_null_and_repeated_ids_and_repeated_rows(spark):
    rng = random.Random(4)
    twin = row(70, "a", rng)
    rows = [row(None, "a", rng) for _ in range(40)] + [row(7, "a", rng) for _ in range(300)] + [twin] * 5 + [row(i, "a", rng) for i in (-3, 6, 8, 64, 71)] + [row(None, None, rng)] * 2
    check(spark, rows)


def test_one_leaf_one_group_and_nothing(spark):
    (alone,) = check(spark, [row(4, "a", random.Random(5))])
    assert alone[1] == alone[2] == alone[3] and alone[4] == sha("") and alone[6]
    check(spark, [])


def test_many_groups(spark):
    rng = random.Random(6)
    check(spark, [row(i, f"g{i % 400}", rng) for i in range(500)])


def test_leaf_encoding(spark):
    docs = spark.createDataFrame([(7, None, "é\n", -1)], "doc_id long, source string, text string, n int")
    got = docs.select(merkle.leaf_hash(*map(F.col, docs.columns))).first()[0]
    assert got == sha("1:7" + "-" + "3:é\n" + "2:-1")
