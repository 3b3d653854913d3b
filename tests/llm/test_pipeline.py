"""The pipeline's stages, each on its own input, against brute force; and all of them in a row."""

import collections
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as fx

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in fx.texts()]
    spark.createDataFrame(rows, fx.SCHEMA + ", n_chars long").write.parquet(f"{path}/documents.parquet")
    words = fx.texts()[5][1].split()
    items = [(1, " ".join(words[2:40])), (2, "nothing that any document says")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


def test_language_stage(spark, docs, folder):
    kept = corpus_pipeline.identify_language(spark, docs, folder)
    assert kept.columns == COLUMNS
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not {300, 301, 302, 305} & ids and {0, 1, 2, 3, None} <= ids


def test_jaccard_stage(spark, docs, folder):
    kept = corpus_pipeline.one_of_each_group(spark, docs, folder)
    assert kept.columns == COLUMNS
    rows = [r for r in fx.texts() if r[0] is not None]
    comp = fx.components(fx.similar_pairs([fx.word_set(r[1]) for r in rows]), range(len(rows)))
    least = collections.defaultdict(lambda: 10**9)
    for i, c in comp.items():
        least[c] = min(least[c], rows[i][0])
    assert sorted(r[0] for r in kept.filter("doc_id is not null").select("doc_id").collect()) == sorted({least[comp[i]] for i in comp})
    assert kept.filter("doc_id is null").count() == 1


def test_decontamination_stage(spark, docs, folder):
    kept = corpus_pipeline.decontaminate(spark, docs, folder)
    assert kept.columns == COLUMNS
    gone = collections.Counter(r[0] for r in fx.texts()) - collections.Counter(r[0] for r in kept.select("doc_id").collect())
    item = re.split(r"[^a-z0-9\x80-\U0010ffff]+", fx.lower(" ".join(fx.texts()[5][1].split()[2:40])))
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    bad = set()
    for d, t, *_ in fx.texts():
        w = [x for x in re.split(r"[^a-z0-9\x80-\U0010ffff]+", fx.lower(t)) if x]
        hit = {k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for k in range(i, i + 13)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(d)
    assert set(gone) == bad and 5 in bad
    same = kept.select("doc_id", "text").collect()
    assert {tuple(r) for r in same} <= {r[:2] for r in fx.texts()}


def test_mixing_stage(spark, docs, folder):
    out = corpus_pipeline.mix_sources(spark, docs, folder)
    assert out.columns == COLUMNS
    total = sum(len((r["text"] or "").split()) for r in out.collect())
    size = sum(len(fx.WORD.findall(r[1] or "")) for r in fx.texts())
    assert abs(total - 1.5 * size) < 0.01 * size + 4


CLASHES = ("n", "w", "at", "ids", "prefix", "size", "source_size", "target", "whole", "part", "lang_pred", "lang_score", "_id", "_row", "_ws", "_i", "_h", "_b", "_s", "row", "name", "n_words", "hits", "items", "cid", "bucket", "key", "word")


@pytest.mark.parametrize("k", range(4))
def test_any_other_columns(spark, docs, folder, k):
    """Columns of any name come back as they are from each stage, and change nothing."""
    stage = corpus_pipeline.STAGES[k][1]
    plain, wide = stage(spark, docs, folder), stage(spark, docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}), folder)
    assert wide.columns == [*COLUMNS, *CLASHES]
    rows = wide.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    counted = lambda rows: collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in rows)
    assert counted(rows) == counted(plain.collect())


def test_sharding_stage(spark, docs, folder):
    out = corpus_pipeline.shard(spark, docs.withColumn("slot", F.lit("own")), folder)
    assert out.columns == [*COLUMNS, "law", "shard", "slot", "grown_shard"] and out.count() == len(fx.texts())


def test_two_texts_of_one_id(spark, folder):
    text = lambda *ws: " ".join(f"word{w}" for w in ws)
    rows = [(1, text(*range(50)), "en", "a", 1), (1, text(*range(100, 150)), "en", "a", 1), (0, text(*range(100, 150)), "en", "a", 1), (None, text(*range(50)), "en", "a", 1), (1, text(*range(50)), "en", "a", 1)]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, fx.SCHEMA + ", n_chars long"), folder)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, rows[2][1]), (1, rows[0][1])]


def test_run(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*COLUMNS, "law", "shard", "slot", "grown_shard"]
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and out.filter(F.col("doc_id") == 5).isEmpty()


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], fx.SCHEMA + ", n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
