"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Buckets of a source's documents in hash order; only the one in which the mix ends is sorted.
BUCKETS = 1 << 16
#: Sources up to which their targets (about 60 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than blank and tab to carriage return; 0 for null."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - edges).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources numbered from 0 in code point order, null last, by a range sort and counts of its partitions."""
    ordered = cut(
        sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
        .withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() % (1 << 33))
    )
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return ordered.join(first, "part").select("source", "source_size", (F.col("first") + F.col("i")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) by water-filling over one row for each source.

    All sources share `share` of all sizes by weight; a target above `most` times its source's size is clamped there and
    the excess is shared again by weight among the rest, until none is above. Each round is one sum over the sources.
    """
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, want = None, share * total
    while True:
        clamped = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        sums = ranked.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(clamped).alias("n")).first()
        if not sums["w"]:
            level = float("inf")
            break
        nxt = max(0.0, (want - sums["cap"]) / sums["w"])
        if level is not None and nxt <= level:
            break
        level = nxt
    # an infinite level times a weight is infinite, and the cap counts
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 29, text: str = "text", source: str = "source") -> DataFrame:
    """Whole and fractional repetitions of each document, so that every source comes to its target of words.

    Adds size (words), source_size, target, whole (repetitions in full) and part (words of one more repetition, from
    its begin). A source takes floor(target / source_size) repetitions of all its documents, and of the rest as many
    documents as fit in the order of a seeded hash of id and text; the one at which the mix ends is taken in part, so a
    source's words meet its target rounded to whole words. Columns of those names are replaced.

    The documents are cut into BUCKETS by the hash, and sums by source and bucket tell in which bucket the source ends;
    only that bucket's documents are sorted, so a source that holds most rows is no single task. Null source: one
    source, the last. Null or empty texts: size 0, taken never. Equal rows share a hash and are taken in any order among
    themselves. An empty table gives an empty result. Equal input gives equal results. Other columns may have any names.
    """
    # the columns travel as one, so no name of theirs meets one used here
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "whole", "part")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)]).alias("_row")
    back = [F.col("_row")[f"f{i}"].alias(c) for i, c in enumerate(names)]
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(f"`{text}`"))
    sized = docs.select(row, n_words(F.col(f"`{text}`")).alias("size"), key.alias("_h"), F.pmod(F.shiftrightunsigned(key, 20), F.lit(BUCKETS)).cast("int").alias("_b"), F.col(f"`{source}`").alias("_s"))
    sums = cut(sized.groupBy("_s", "_b").agg(F.sum("size").alias("n")))
    goal = targets(sums.groupBy(F.col("_s").alias("source")).agg(F.sum("n").alias("source_size")), weights, share, most)
    goal = goal.withColumn("words", F.round("target").cast("long"))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
    goal = cut(goal.withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size")))
    # the bucket in which the rest ends, and what comes before it
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    upto = sums.select("_s", "_b", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    end = upto.join(goal, F.col("_s").eqNullSafe(F.col("source"))).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    end = end.select(F.col("source").alias("_e"), F.col("_b").alias("end"), "before")
    plan = cut(goal.join(end, F.col("source").eqNullSafe(F.col("_e")), "left").select(F.col("source").alias("_g"), "source_size", "target", "whole", "rest", "end", "before"))
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    joined = sized.join(side, F.col("_s").eqNullSafe(F.col("_g")))
    out = [*back, "size", "source_size", "target", F.col("whole").cast("int").alias("whole")]
    at_end = (F.col("rest") > 0) & (F.col("_b") == F.coalesce("end", F.lit(BUCKETS)))
    simple = joined.filter(~at_end).select(*out, F.when((F.col("rest") > 0) & (F.col("_b") < F.coalesce("end", F.lit(BUCKETS))), F.col("size")).otherwise(0).alias("part"))
    order = Window.partitionBy("_s").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = joined.filter(at_end).select("_row", "size", "source_size", "target", "whole", F.greatest(F.lit(0), F.least(F.col("size"), left)).alias("part"))
    return simple.unionByName(last.select(*out, "part"))


def repeat_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each repetition of a mixed document; a repetition in part holds the text up to its last word."""
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "whole", "part")]
    full = F.when(F.col("part") == F.col("size"), F.col("whole") + F.when(F.col("size") > 0, 1).otherwise(0)).otherwise(F.col("whole"))
    times = mixed.withColumn("_t", full)
    whole = times.filter("_t > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int"))))
    words = F.split(F.col(f"`{text}`"), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    part = times.filter("part > 0 and part < size").withColumn(text, cut_text)
    keep = [F.col(f"`{c}`") for c in columns]
    return whole.select(*keep).unionByName(part.select(*keep))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))
