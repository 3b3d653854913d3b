"""Short lines and passages over line breaks against brute force."""

import collections
import os
import random
import re
import sys
from types import SimpleNamespace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as fx
from pyspark.sql import functions as F

from rasterloom.llm import substring


def odd_rows():
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    passage, line, edge = words(60), words(30), words(48)
    rows = [
        (1, wrap(words(20) + passage + words(9), 11)),
        (2, wrap(words(7) + passage + words(30), 8)),
        (3, " ".join(words(5) + passage[:55] + words(5))),
        (4, " ".join(line) + "\n" + "three short words"),
        (5, " ".join([*line[:15], "other", *line[15:]]) + "\nThree  short words"),
        (6, " ".join(line[1:]) + "\n\n" + " ".join(edge)),
        (7, " ".join([*edge, *words(4)])),
        (8, " ".join(passage[:49])),
        (9, None),
        (10, ""),
    ]
    rows += [(20 + i, wrap(words(90), 10)) for i in range(5)]
    return [*rows, (30, rows[0][1])]


def test_short_lines_and_wrapped_passages(spark, monkeypatch):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    session = SimpleNamespace(read=SimpleNamespace(parquet=lambda path: frame))
    got = substring.op7_substring_dedup(session, "any").collect()

    units = [(d, k, fx.WORD.findall(fx.lower(x))) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    units = [u for u in units if u[2]]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for _, _, w in units]
    comp = fx.components(fx.similar_pairs(sets), range(len(units)))
    size = collections.Counter(comp.values())
    want = {(u[0], u[1], units[comp[i]][0], comp[i] == i) for i, u in enumerate(units) if size[comp[i]] > 1}
    assert want and {(r["doc_id"], r["paragraph"], r["component_id"], r["kept"]) for r in got if r["unit"] == "line"} == want

    texts = {d: t or "" for d, t in rows}
    where = collections.defaultdict(list)
    for d in sorted(texts):
        w = fx.WORD.findall(fx.lower(texts[d]))
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].append((d, i))
    want = {(*p, v[0][0], p == v[0]) for v in where.values() if len(v) > 1 for p in v}
    found = set()
    for r in got:
        if r["unit"] == "passage":
            raw = texts[r["doc_id"]].encode()
            w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            a, b = [x for x, _ in w].index(r["begin"]), [y for _, y in w].index(r["end"])
            assert b - a + 1 == r["n_words"] and raw[: r["begin"]].count(b"\n") == r["paragraph"]
            found |= {(r["doc_id"], i, r["component_id"], r["kept"]) for i in range(a, b - 48)}
    assert want and found == want
    assert substring.repeated_passages(frame.limit(0)).count() == 0


def test_quotations_drop_no_line(spark):
    """Lines with text of their own that quote one passage of 50 words all stay; the passage alone is a span to remove."""
    rng = random.Random(12)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = words(50)
    rows = [(d, f"{words(40 + 20 * d)} {passage} {words(60)}") for d in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring.repeated_paragraphs(frame, least=1).count() == 0
    spans = substring.repeated_passages(frame).collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in spans) == [(d, 50, d == 0) for d in range(6)]
    texts = dict(rows)
    assert all(texts[r["doc_id"]].encode()[r["begin"] : r["end"]].decode() == passage for r in spans)


def test_repeated_rows_and_null_ids(spark):
    """Of repeated rows, and of different documents without an id, one paragraph and one passage alone is kept."""
    rng = random.Random(3)
    text = " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))
    near = text + " more"
    rows = [(1, text), (1, text), (None, near), (None, near + " words"), (None, near)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("pid", "oid", "key", "keys", "tid", "w", "i", "m", "kept", "place")})
    for found in (substring.repeated_paragraphs(frame), substring.repeated_passages(frame)):
        got = [(r["doc_id"], r["component_id"], r["kept"]) for r in found.collect() if r["n_words"] >= 80]
        assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, False), *[(None, 1, False)] * 3], key=str)
    other = [(None, near), (None, near)]
    got = [(r["component_id"], r["kept"]) for r in substring.repeated_paragraphs(spark.createDataFrame(other, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(None, False), (None, True)]


def test_large_keys_against_brute_force(spark):
    """Hundreds of variants of one line, which share bands but are similar to few: components as by comparing all pairs."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(45)]
    rows = []
    for d in range(500):
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            line[rng.randrange(len(line))] = f"n{rng.randrange(60)}"
        rows.append((d, " ".join(line)))
    want = fx.components(fx.similar_pairs([fx.word_set(t) for _, t in rows]), range(len(rows)))
    got = {r["doc_id"]: r["component_id"] for r in substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least=1).collect()}
    alone = collections.Counter(want.values())
    assert len(alone) > 50 and got == {d: c for d, c in want.items() if alone[c] > 1}


def test_spots_of_all_rows_are_those_of_each():
    import numpy as np

    from rasterloom.llm.common import mix

    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = rng.integers(0, 200, 12)
        words = mix(rng.integers(0, 300, int(sizes.sum())).astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(sizes)])
        row, key = substring._all_spots(words, first)
        for k in range(12):
            own = words[first[k] : first[k + 1]]
            want = substring._spots(own)[0] if len(own) >= 50 else np.zeros(0, np.uint64)
            assert sorted(key[row == k].tolist()) == sorted(want.tolist())
