import random
import re

import pytest
from pyspark.sql import functions as F

from spoor.llm import linking, minhash


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingle_set(text, k=4):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, k=4):
    """Row index -> (n, component) by all pairs; rows are nodes."""
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least.get(find(i)) if s else docs[i][0]) for i, s in enumerate(sets)]


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 30, 80, 300]))] for _ in range(12)]
    shared = [rng.choice(vocabulary) for _ in range(60)]  # a passage that many documents hold
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):  # chains of edits around the threshold
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 4 == 0:
            w = shared + [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 12, 20]))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    docs = made(seed, 260)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()}
    assert found == {d: x for (d, _), x in zip(docs, brute(docs))}


def test_ids_with_several_texts_and_texts_without_id(spark):
    rng = random.Random(7)
    base = [[f"v{rng.randrange(900)}" for _ in range(90)] for _ in range(8)]
    near = lambda w, i: " ".join([*w[:i], "edit", *w[i + 1 :]])
    docs = [(1, " ".join(w)) for w in base[:4]] + [(10 + i, near(w, 40)) for i, w in enumerate(base[:4])]
    docs += [(None, " ".join(w)) for w in base[4:]] * 2 + [(None, near(w, 50)) for w in base[4:]] + [(20, near(base[4], 60))]
    found = minhash.classes(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((key((r.doc_id, r.n_shingles, r.component_id)) for r in found)) == sorted(key((d, *x)) for (d, _), x in zip(docs, brute(docs)))


def test_odd_rows(spark, odd_docs):
    found = minhash.classes(odd_docs, k=4).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in found) == [(-1, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 10, 6), (7, 8, 7)]
    kept = minhash.keep_one(odd_docs, k=4)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7]
    assert minhash.classes(odd_docs.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, x) for x in range(201, 260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.node: r.comp for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_table_recall_is_the_formula():
    s, r, m = 0.8, minhash.R, minhash.M
    assert (1 - (1 - s**r) ** m) ** 2 > 0.9999
    assert F is not None
