"""What operators move and hold: wide rows that several joins need lie in buckets, Python gets few texts at once."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as fx

from rasterloom.llm import linededup, substring, suffix


@pytest.fixture
def shuffled(spark):
    """No join is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def test_suffix_dedup_joins_move_no_texts(shuffled, monkeypatch):
    """Each of the three joins that bring places to the texts reads these from their buckets, and the table goes."""
    plans = []
    for name in ("_steps", "_single", "_without"):

        def spy(rows, f=getattr(suffix, name)):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return f(rows)

        monkeypatch.setattr(suffix, name, spy)
    docs = shuffled.createDataFrame(fx.texts(), fx.SCHEMA)
    assert suffix.repeated_spans(docs).filter("n_removed > 0").count() > 0
    assert len(plans) == 3 and all("Bucketed: true" in p for p in plans)
    assert not [t for t in shuffled.catalog.listTables() if t.name.startswith("bucketed_")]


def test_substring_dedup_hands_texts_to_python_a_few_at_a_time(spark, monkeypatch, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    for of in ("repeated_paragraphs", "repeated_passages"):

        def spy(*args, f=getattr(substring, of), **more):
            seen.append(int(spark.conf.get(name)))
            return f(*args, **more)

        monkeypatch.setattr(substring, of, spy)
    spark.createDataFrame(fx.texts(), fx.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert substring.op7_substring_dedup(spark, str(tmp_path)).filter("not kept").count() > 0
    assert seen == [substring.ROWS_AT_ONCE] * 2 and spark.conf.get(name) == before


def test_line_dedup_moves_only_lines_of_its_pairs(shuffled, monkeypatch):
    plans = []

    def spy(members, verify, elements, percent, f=linededup.link_by_keys):
        pairs = members.filter("id <> lead").selectExpr("least(id, lead) as a", "greatest(id, lead) as b").distinct().limit(1)
        plans.append(verify(pairs)._jdf.queryExecution().executedPlan().toString())
        return f(members, verify, elements, percent)

    monkeypatch.setattr(linededup, "link_by_keys", spy)
    rows = [(1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog."), (3, "nothing like it")]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.fuzzy_lines(shuffled.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert plans[0].count("LeftSemi") >= 2
