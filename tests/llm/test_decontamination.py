import random

from spoor.llm import decontamination as D

WORDS = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra se ti vo zu la mi no pu te xa wo".split()]


def brute_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        assert D.lcs(D.Passage._masks(x), len(x), y) == brute_lcs(x, y)


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, text(rng.choice([12, 20, 35, 60, 150])) + ".") for i in range(30)]
    docs, leaks = [], set()
    for d in range(150):
        body = text(rng.choice([5, 80, 900]))
        if d % 3 == 0:
            i = d // 3 % 30
            words = items[i][1].split()
            if d % 2:  # a paraphrase: a word in eight is another
                words = [w if k % 8 else rng.choice(WORDS) for k, w in enumerate(words)]
            body += " " + " ".join(words).upper() + " " + text(40)
            leaks.add((d, i))
        docs.append((d, body))
    return items, docs, leaks


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    items, docs, leaks = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.search(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= leaks and len(got) >= 0.95 * len(leaks)
    for r in found:
        assert 0.65 <= r.lcs_ratio <= 1 and r.cosine >= D.COSINE - 1e-6


def test_finds_paraphrases_of_one_sentence_and_of_early_passages(spark):
    """A word in four, at random, is another: most shares lie between PARAPHRASED and COPIED."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, text(rng.choice([24, 40, 60])) + ".") for i in range(30)] + [(100 + i, text(180) + ". " + text(8) + ".") for i in range(10)]
    docs, planted = [(1000 + d, text(300)) for d in range(150)], set()
    for i, (item, whole) in enumerate(items):
        words = whole.split()[:100]  # of long items without their end
        edits = set(rng.sample(range(len(words)), len(words) // 4))
        docs.append((i, " ".join([text(60), *(rng.choice(WORDS) if k in edits else w for k, w in enumerate(words)), text(60)])))
        planted.add((i, item))
    found = D.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    paraphrases = {(r.doc_id, r.item_id) for r in found if r.lcs_ratio < D.COPIED}
    print("recall", len(got & planted), len(planted), "paraphrases", len(paraphrases), "false", len(got - planted))
    assert got <= planted and len(got) >= 0.85 * len(planted) and paraphrases


def test_the_fit_takes_a_text_once(spark, monkeypatch):
    monkeypatch.setattr(D, "FIT_DOCS", 100)
    rows = [(i, i % 400 if i < 800 else 7, bytes([1, 0])) for i in range(1600)]
    fit = D._fitted(spark.createDataFrame(rows, "doc_id long, text_hash long, ids binary")).collect()
    assert len({r.text_hash for r in fit}) == len(fit) and 50 < len(fit) < 160


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "a b c d e f g h i j k"), (4, "a b c d e f g h i j k"), (None, "other words that stand in no text here")], "item_id long, text string")
    found = D.search(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} <= {(6, 4)}  # too few passages for a latent map: see the docstring
    kept = D.drop_contaminated(odd_docs, items)
    assert kept.count() == odd_docs.count() - len(found) and kept.columns == odd_docs.columns
    assert D.search(odd_docs, items.limit(0)).count() == 0
    assert D.search(odd_docs.limit(0), items).count() == 0


def test_latent_map_is_fitted_on_every_different_text(spark):
    """60,000 texts, a tenth of them twice; each is one row of the map's matrix."""
    n = 60_000
    rows = spark.range(n + n // 10).selectExpr("id as doc_id", f"id % {n} as text_hash", f"cast(cast(id % {n} as string) as binary) as ids")
    fitted = D._fitted(rows)
    assert fitted.count() == n and fitted.selectExpr("sum(cast(cast(ids as string) as long)) as x").first().x == n * (n - 1) // 2


def test_dropping_fits_the_map_on_every_different_text(spark, monkeypatch):
    seen, fit = [], D.latent_map
    monkeypatch.setattr(D, "latent_map", lambda rows, *rest: (seen.append(rows.count()), fit(rows, *rest))[1])
    docs = spark.range(45_000).selectExpr("id as doc_id", "concat('some words of text ', id) as text")
    bench = spark.createDataFrame([(1, "some words of other text than theirs")], "item_id long, text string")
    assert D.drop_contaminated(docs, bench).count() == 45_000 and seen == [45_000]


def test_no_bound_reaches_the_map_of_a_search(spark, monkeypatch):
    seen, fit = [], D.latent_map
    monkeypatch.setattr(D, "FIT_DOCS", 100)
    monkeypatch.setattr(D, "latent_map", lambda rows, *rest: (seen.append(rows.count()), fit(rows, *rest))[1])
    docs = spark.range(2_000).selectExpr("id as doc_id", "concat('some words of text ', id) as text")
    bench = spark.createDataFrame([(1, "some words of other text than theirs")], "item_id long, text string")
    assert D.drop_contaminated(docs, bench).count() == 2_000 and seen == [2_000]
