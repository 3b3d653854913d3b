"""A corpus pipeline: language, near copies, benchmark passages, mixture, shards.

Each stage takes all that the one before kept, as written to Parquet, and all but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontam, jaccard, langid, mixing, sharding
from rasterloom.llm.common import ensure_checkpoint_dir


#: Posterior probability that the likeliest language must have.
SURE = 0.5


def _packed(docs: DataFrame) -> Column:
    """All columns as one, which no name used within an operator can meet."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without text or letters, and those for which no language is as likely as all others together.

    The model is learned from the labelled rows of docs. Labels decide nothing, as they may be wrong where the text is fine.
    Null and empty texts go; texts of any length are read whole; repeated rows are each judged alike; columns of any name
    come back as they are; an empty table, or one without labels, gives an empty result.
    """
    model = langid.fit(docs.select("text", "lang"))
    out = langid.predict(docs.select(_packed(docs), "text"), model)
    return out.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= SURE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of the n-gram Jaccard join: the one with the least id, once.

    A document is named by id and text, so of two texts with one id each has a component of its own; null ids come last.
    Documents without words (null, empty) are groups of their own by id. Repeated rows stay once; columns of any name come
    back as they are; an empty table gives an empty result.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("blank"), F.xxhash64("text").alias("text"))
    keyed = docs.select(_packed(docs), name.alias("name"))
    comps = jaccard.jaccard_components(docs.select(name.alias("doc_id"), "text"))
    kept = comps.filter("doc_id = component_id").select(F.col("doc_id").alias("name")).distinct()
    return keyed.join(kept, "name", "left_semi").dropDuplicates(["name"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents a twentieth of whose words lie in windows of benchmark items.

    Null and empty texts hold no window and stay; long texts are read whole; repeated rows are each judged alike; columns
    of any name come back as they are; empty tables drop nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.contamination(docs.select(_packed(docs), "text"), items)
    bad = decontam.is_contaminated(F.col("n_words"), F.size("hits"))
    return found.filter(~bad).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or sample each source's documents to the target weights; a document taken twice comes back twice.

    Null sources are one source; null and empty texts have no words and are never taken; of the last document of a
    source a part may be taken, so text and n_chars are anew; columns of any name come back otherwise as they are;
    repeated rows count each; an empty table gives an empty result.
    """
    out = mixing.repeat_rows(mixing.mix(docs.select(_packed(docs), "doc_id", "text", "source")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in one random order, dealt to eight shards; adds law, shard, slot and grown_shard, in place of columns of these names.

    Null, empty and long texts and repeated rows are rows as any other; an empty table gives an empty result.
    """
    return sharding.shuffle_to_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Sampling and the language model are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    where = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{where}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
