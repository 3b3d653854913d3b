"""Every text operator against brute force over a table of odd rows, and over an empty table."""

import binascii
import collections
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as fx

from rasterloom.llm import decontam, jaccard, langid, linededup, mixing, quality, sharding, substring, suffix, topk
from rasterloom.llm.common import connected_components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fx.texts(), fx.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], fx.SCHEMA)


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100, i) for i in range(101, 160)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = fx.components([e for e in edges if e[0] != e[1]], {n for e in edges for n in e} - {30})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, docs, nothing):
    got = {(r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in linededup.fuzzy_lines(docs).collect()}
    rows = sorted({r[:2] for r in fx.texts()}, key=lambda r: (r[0] is None, r[0] or 0))
    places = [(i, k, x) for i, (_, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if x]
    lines = sorted({x for _, _, x in places})
    sets = [frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4))) for x in lines]
    comp = fx.components(fx.similar_pairs(sets), range(len(lines)))
    comp = {x: comp[i] for i, x in enumerate(lines)}
    first, removed = {}, collections.defaultdict(list)
    for i, k, x in places:
        if first.setdefault(comp[x], (i, k)) != (i, k):
            removed[i].append(k)
    want = {(d, sum(1 for x in (t or "").split("\n") if x), tuple(removed[i])) for i, (d, t) in enumerate(rows)}
    assert got == want
    assert linededup.fuzzy_lines(docs).count() == len(fx.texts())
    assert linededup.fuzzy_lines(nothing).count() == 0
    found = linededup.fuzzy_lines(docs.filter("doc_id in (0, 3, 6)"))
    kept = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs.filter("doc_id in (0, 3, 6)"), found).collect()}
    assert sum(t.count("\n") + 1 for t in kept.values()) == sum(t.count("\n") + 1 for d, t, *_ in fx.texts() if d in (0, 3, 6)) - 2


def test_quality(spark, docs, nothing, sf_dir):
    model = quality.fit_texts([f"a calm and plain sentence about the sea number {i} of many" for i in range(60)], [f"BUY!! ### NOW!! {i} $$$ ***" for i in range(60)], 0.5)
    got = quality.score(docs.withColumn("quality_score", F.lit("old")), model).collect()
    assert len(got) == len(fx.texts()) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert model.score("a plain sentence about the calm sea") > 0.5 > model.score("NOW!! ### BUY!! $$$")
    assert quality.score(nothing, model).count() == 0
    empty = quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.score(None) == empty.score("") == 0.5


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    out = quality.op2_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.9


def test_quality_of_all_rows_against_single_texts(spark, tmp_path):
    """Each row scores as its text alone by the model of the rows that are not held out; held-out labels change nothing."""
    good = [(i, f"a calm and plain sentence about the sea, number {i} of many " * (1 + i % 3)) for i in range(80)]
    bad = [(i + 100, f"BUY!! ### NOW!! {i} $$$ *** " * (1 + i % 4)) for i in range(80)]
    rows = [*good, *bad, (None, "no id"), (500, None), (501, ""), good[0], (502, "the sea " * 5000)]
    held = lambda d: binascii.crc32(str(d if d is not None else "").encode()) % 5 == 0
    scores = []
    for flip in (0, 1):
        path = tmp_path / str(flip)
        labels = [(d, 1 - flip if held(d) else 1) for d, _ in good] + [(d, flip if held(d) else 0) for d, _ in bad]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        scores.append({(r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in quality.op2_quality(spark, str(path)).collect()})
    assert scores[0] == scores[1]
    known = {d: t for d, t in rows}
    taught = [{d: t for d, t in side if not held(d)} for side in (good, bad)]
    share = len(taught[0]) / (len(taught[0]) + len(taught[1]))
    model = quality.fit_texts(list(taught[0].values()), list(taught[1].values()), share)
    assert scores[0] == {(d, held(d), s := model.score(t), int(s >= 0.3)) for d, t in known.items()}


def test_suffix_dedup(docs, nothing):
    rows = fx.texts()
    want = collections.Counter((r[0], *b) for r, b in zip(rows, fx.repeated_bytes([r[1] for r in rows])))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix.repeated_spans(docs).collect())
    assert got == want
    assert suffix.repeated_spans(nothing).count() == 0


@pytest.mark.parametrize("bucket_bytes", [1 << 23, 4096])
def test_sharding(docs, nothing, bucket_bytes):
    clash = docs.withColumn("shard", F.lit("x")).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(2))
    out = sharding.shuffle_to_shards(clash, 8, bucket_bytes=bucket_bytes).cache()
    rows = out.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter(r[:2] for r in fx.texts())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))] != sorted(r[0] or -1 for r in fx.texts())
    assert sharding.shuffle_to_shards(nothing).count() == 0
    # rows, buckets and places follow from the rows alone: other layouts and a second run give the same
    again = sharding.shuffle_to_shards(clash.repartition(7, "text"), 8, bucket_bytes=bucket_bytes).collect()
    place = lambda rows: collections.Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows)
    assert place(again) == place(rows)
    with pytest.raises(ValueError):
        sharding.shuffle_to_shards(docs, 0)


def test_sharding_written(docs, tmp_path, spark):
    sharding.write_shards(sharding.shuffle_to_shards(docs, 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(fx.texts())


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(docs, nothing):
    rows = fx.texts()
    n = lambda t: len(fx.WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += n(t)
    want = water(sizes)
    mixed = mixing.mix(docs.withColumn("size", F.lit("old"))).cache()
    got = mixed.collect()
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == collections.Counter((d, n(t), sizes[s]) for d, t, _, s in rows)
    taken = collections.Counter()
    for r in got:
        words = r["whole"] * r["size"] + r["part"]
        assert 0 <= words <= 2 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += words
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    repeated = mixing.repeat_rows(mixed)
    assert repeated.columns == docs.columns and sum(n(r["text"]) for r in repeated.collect()) == sum(taken.values())
    again = mixing.mix(docs.repartition(5)).select("doc_id", "size", "whole", "part").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r["doc_id"], r["size"], r["whole"], r["part"]) for r in got)
    assert mixing.mix(nothing).count() == 0


def test_mixing_many_sources(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 50:02d}") for i in range(400)]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.9)
    want = water(sizes, share=1.9)
    assert all(abs(r[1] - want[r[0]]) < 1e-6 for r in got.select("source", "target").distinct().collect())


def test_top_k(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], 1) for i in range(400)]
    rows += [(401, None, 1), (402, [None] + [0.1] * 7, 1), (450, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1), (404, [0.5] * 3, 1), (405, rows[7][1], 1), (None, [0.1] * 8, 1), (407, [3e10] * 8, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, qid int").repartition(5)
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in fine:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v)))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    vectors = topk.quantised(frame)
    for block in (8192, 3):
        got = {tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, query_block=block).collect()}
        assert got == want
    few = topk.quantised(frame.filter("vec_id < 3"))
    assert topk.top_k(few, few.filter("vec_id = 0"), 5).count() == 2
    none = topk.quantised(frame.filter("vec_id < 0"))
    assert topk.top_k(none, none, 5).count() == 0


def test_substring_dedup(docs, nothing):
    rows = sorted({r[:2] for r in fx.texts()}, key=lambda r: (r[0] is None, r[0] or 0))
    units = [(d, k, fx.WORD.findall(fx.lower(x))) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    units = [u for u in units if len(u[2]) >= 50]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for _, _, w in units]
    comp = fx.components(fx.similar_pairs(sets), range(len(units)))
    size = collections.Counter(comp.values())
    want = {(u[0], u[1], units[comp[i]][0], comp[i] == i) for i, u in enumerate(units) if size[comp[i]] > 1}
    once = docs.dropDuplicates(["doc_id", "text"])
    got = {(r["doc_id"], r["paragraph"], r["component_id"], r["kept"]) for r in substring.repeated_paragraphs(once).collect()}
    assert got == want
    assert substring.repeated_paragraphs(nothing).count() == 0


def test_every_common_passage_has_a_common_key():
    import numpy as np

    from rasterloom.llm.common import mix

    rng = np.random.default_rng(1)
    for _ in range(300):
        shared = mix(rng.integers(0, 2**63, 50).astype(np.uint64))
        sides = [np.concatenate([mix(rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)), shared, mix(rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64))]) for _ in range(2)]
        a, b = (substring._spots(s)[0] for s in sides)
        assert np.isin(a, b).any()


def test_language_id(spark, docs, nothing):
    counts = {"en": {b"the": 50, b"with": 20, b"and": 30, b"that": 20}, "de": {b"der": 50, b"und": 40, b"nicht": 20, "für".encode(): 10}}
    model = langid.learn(counts, langid.load_pieces())
    rows = spark.createDataFrame([(1, "the and that"), (2, "Nicht für und der"), (3, None), (4, ""), (5, "12 !?"), (6, "und " * 5000), (7, "q" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(rows.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"] and got[7]["lang_pred"] in counts
    assert all(0 <= r["lang_score"] <= 1 for r in got.values()) and got[3]["lang_score"] == 0
    assert langid.predict(nothing, model).count() == 0
    blank = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.predict(docs, blank).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba"]
    p = np.array([[0.3], [0.2], [0.1], [0.25], [0.1], [0.05], [0.0]])
    lattice = langid.Lattice(pieces)

    def brute(word):
        return 1.0 if not word else sum(p[i, 0] * brute(word[len(q) :]) for i, q in enumerate(pieces) if word.startswith(q))

    words = [b" ab", b" aba", b" b", b" abab"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    sizes = np.array([len(w) for w in words])
    at = np.cumsum(sizes) - sizes
    total = lattice.forward(p, at, sizes, lattice.arcs(data, at, sizes))
    assert np.allclose(total[at + np.arange(4) + sizes, 0], [brute(w) for w in words])


def test_long_words_are_segmented_whole(monkeypatch):
    import math
    import random
    from fractions import Fraction

    import numpy as np

    rng = random.Random(3)
    pieces = sorted({b" ", b"a", b"b", b"c", b"ab", b" a", b"ba", b"abab", b"bcb", b"cc", b"aaaaaaaaaaaa"})
    p = np.array([[0.001 * (i + 1), 1e-6 * (len(pieces) - i)] for i in range(len(pieces))] + [[0, 0]])
    model = langid.LanguageModel(pieces, ["x", "y"], p)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (3, 200, 31, 32, 33, 500, 64)] + ["a" * 300, "c" * 40]
    text = " ".join(words).encode()
    ends = np.cumsum([len(w) + 1 for w in words])

    def brute(word, k):
        word, sums = b" " + word.encode(), [Fraction(1)]
        for t in range(1, len(word) + 1):
            sums.append(sum((sums[t - len(q)] * Fraction(p[i, k]) for i, q in enumerate(pieces) if word[:t].endswith(q)), Fraction(0)))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    want = [[brute(w, 0), brute(w, 1)] for w in words]
    for block in (1 << 18, 100, 16):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = model.word_scores(np.frombuffer(text, dtype=np.uint8), ends - [len(w) + 1 for w in words], ends - 1)
        assert np.allclose(got, want, rtol=1e-9)


def test_language_id_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    out = langid.op8_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_jaccard_join(docs, nothing):
    rows = fx.texts()
    sets = [fx.word_set(t) for _, t, *_ in rows]
    comp = fx.components(fx.similar_pairs(sets), range(len(rows)))
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    want = collections.Counter((r[0], len(s), least.get(comp[i])) if s else (r[0], 0, r[0]) for i, (r, s) in enumerate(zip(rows, sets)))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs.withColumn("cid", F.lit(1))).collect())
    assert got == want
    assert jaccard.jaccard_components(nothing).count() == 0


def contaminated(docs, items):
    split = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: [w for w in split.split(fx.lower(t)) if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[x]
        out.append((d, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    return collections.Counter(out)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_decontamination(spark, docs, nothing, broadcast_rows, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast_rows)
    rows = [r[:2] for r in fx.texts()]
    some = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(some[0].split()[3:30])), (2, " ".join(some[1].split()[5:18]).upper()), (3, "one"), (4, None), (5, ""), (6, "never seen words here at all"), (7, " ".join(some[0].split()[10:40])), (7, "ab ab"), (10, "...")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(r["hits"]), tuple(r["items"])) for r in decontam.contamination(docs.select("doc_id", "text", F.lit(1).alias("word")), frame).collect())
    assert got == contaminated(rows, items)
    assert decontam.contamination(nothing, frame).count() == 0
    assert all(not r["hits"] for r in decontam.contamination(docs, frame.limit(0)).collect())


def test_written_crc(docs, spark):
    out = docs.select("text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")).collect()
    assert all(r["c"] == binascii.crc32((r["text"] or "").encode()) for r in out)
