"""Collocations against a plain count, in shards and batches so small that phrases are summed over many."""

import collections
import random
import re

import pytest

from rasterloom.llm import collocation

from fixtures import lower

SCHEMA = "doc_id long, text string, lang string, n long"


def brute_force(rows, least, absorbed, top):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        c = counts["und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in (1, 2, 3):
                c.update((k, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(f for p, f in c.items() if p[0] == 1)
        kept = []
        for p, a in c.items():
            if p[0] == 1 or a < least:
                continue
            w = p[1:]
            cuts = [(10**6 * a * a // (c[k, *w[:k]] * c[len(w) - k, *w[k:]]), k, c[k, *w[:k]], c[len(w) - k, *w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            if any(q[0] > p[0] and f >= least and 100 * f >= absorbed * a and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q, f in c.items() if q[0] == 3):
                continue
            kept.append((-score, -a, " ".join(w).encode(), left, right, n))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def documents(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "état", "zu", "x", "a b", "-", "ß", "new", "york", "city"] + [f"w{i}" for i in range(25)]
    rows = []
    for i in range(260):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["new york city", "New York", "x x x x", rng.choice(words), rng.choice(words)]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".\r\n", "!"])
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"]), 1))
    rows += [(900, None, "en", 1), (901, "", "xx", 1), (902, " ,;", "xx", 1), (903, "the " * 3000, "en", 1), (904, "q" * 50_000 + " the of", "en", 1)]
    return rows + rows[:3]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_against_plain_count(spark, shard_bytes):
    rows = documents(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocation.best(collocation.collocations(docs, 5, 50, shard_bytes), 40)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 5, 50, 40)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_batches(monkeypatch, batch):
    """Occurrences of all pairs in one shard, whatever a batch holds, none across pieces."""
    import numpy as np

    monkeypatch.setattr(collocation, "BATCH", batch)
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "b", "c"]) + rng.choice([" ", " ", ". "]) for _ in range(900))
    words, keys, _, starts, blocks, bits = collocation._bitmaps([text.encode()], 0)
    row = {"hashes": keys.view(np.int64), "starts": starts.tobytes(), "blocks": blocks.tobytes(), "bits": bits.tobytes()}
    shard = collocation._Shard(row, np.full(1 << (collocation.FILTER_BITS - 6), -1))
    got = collections.Counter()
    for u, v, _, left in shard.extend(shard.word, shard.block, shard.bits):
        for k, f in zip(*collocation._summed(u * 3 + v, left)):
            got[words[k // 3], words[k % 3]] += int(f)
    want = collections.Counter((w[i], w[i + 1]) for w in (p.split() for p in text.split(".")) for i in range(len(w) - 1))
    assert got == want


def test_slices(monkeypatch):
    """Slices cut no word and no piece."""
    import numpy as np

    monkeypatch.setattr(collocation, "SLICE_BYTES", 16)
    data = np.frombuffer(b"one two, three four  five" + b"z" * 40 + b" six\n" + b" " * 40 + b"seven eight", dtype=np.uint8)
    _, first, end, begins = collocation._occurrences(data)
    assert [data[a:b].tobytes()[:5] for a, b in zip(first, end)] == [b"one", b"two", b"three", b"four", b"fivez", b"six", b"seven", b"eight"]
    assert begins.tolist() == [True, False, True, False, False, False, True, False]


def test_empty(spark):
    assert collocation.best(collocation.collocations(spark.createDataFrame([], SCHEMA)), 5).count() == 0
    assert collocation.best(collocation.collocations(spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1)], SCHEMA)), 5).count() == 0
