"""Similar documents whose common words are all hot, and whose smallest hashes are mostly their own."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as fx

from rasterloom.llm import jaccard


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        own = [rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, o])) for o in own)
        hot = np.unique(np.concatenate([rng.choice(common, int(rng.integers(0, n + 1)), replace=False), own[0][:1]]))
        assert not jaccard.similar(a, b) or np.isin(jaccard.prefix(a, hot), jaccard.prefix(b, hot)).any()


def test_near_copies_of_hot_words(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    chunks = [words(90) for _ in range(10)]
    template = sum(chunks, [])
    rows = []
    for i in range(400):
        rows.append((i, " ".join(sum((chunks[k] for k in sorted(rng.sample(range(10), 6))), []))))
    common = jaccard.set_of_text(" ".join(template).encode())
    limit = np.sort(common)[45]
    for i in (1000, 1001):
        while True:
            # many of a document's smallest hashes are of its own words
            text = " ".join(template + words(105)).encode()
            own = np.setdiff1d(jaccard.set_of_text(text), common)
            if (own < limit).sum() >= 13:
                break
        rows.append((i, text.decode()))
    sets = {i: jaccard.set_of_text(t.encode()) for i, t in rows}
    assert jaccard.similar(sets[1000], sets[1001])
    assert not any(jaccard.similar(sets[1000], sets[i]) for i in range(400))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got[1000] == got[1001] == 1000


def test_links_among_hot_passages(spark):
    """Pairs at 0.80 exactly, of two passages each that a hundred other documents hold: all of them are found."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [words(300) for _ in range(16)]
    rows = [(k * 100 + d, words(100) + passages[k] + words(100)) for k in range(16) for d in range(100)]
    pairs = [(i, j) for i in range(16) for j in range(i)]
    for m, (i, j) in enumerate(pairs):
        rows += [(10_000 + 2 * m + e, passages[i] + words(70) + passages[j]) for e in (0, 1)]
    rows = [(d, " ".join(w)) for d, w in rows]
    a, b = (set(jaccard.set_of_text(rows[-k][1].encode()).tolist()) for k in (1, 2))
    assert 100 * len(a & b) == 80 * len(a | b)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert all(got[10_000 + 2 * m] == got[10_001 + 2 * m] == 10_000 + 2 * m for m in range(len(pairs)))
    assert all(got[d] == d for d in range(1600))


def test_copies_of_a_template_against_brute_force(spark):
    """Near copies of one text at every distance, among unrelated ones: components as by comparing all pairs."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    template = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for d in range(700):
        text = list(template) if d % 7 else [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        rows.append((d, " ".join(text[: rng.choice([len(text), 130, 140])])))
    sets = [fx.word_set(t) for _, t in rows]
    want = fx.components(fx.similar_pairs(sets), range(len(rows)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want
