"""Two-pass external shuffle into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import utf8_bytes


#: Partitions at most into which buckets are scattered, and buckets whose counts one task sums up.
PARTITIONS, RANGE = 20_000, 4096


def _first_numbers(counts: DataFrame) -> DataFrame:
    """(bucket, first): rows in all buckets before, from (bucket, n); ranges of buckets are summed first."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("range", F.expr(f"bucket div {RANGE}"))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.orderBy("range")).alias("upto"))
    within = counts.select("bucket", "range", before(Window.partitionBy("range").orderBy("bucket")).alias("within"))
    return within.join(ranges, "range").select("bucket", (F.col("upto") + F.col("within")).alias("first"))


def shuffle_to_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """All rows of docs in one random order, dealt to shards whose row counts differ by one at most (law `rows`).

    Pass 1 scatters the rows into buckets of about bucket_bytes by a seeded hash of the whole row, so a source or a text
    that many rows share makes no bucket larger than others. Pass 2 shuffles each bucket with Spark's `shuffle`
    (Fisher-Yates) and numbers all rows: the bucket's first number, from counts of all buckets, plus the place within it.
    Row p goes to shard p mod n_shards, slot p div n_shards. The texts move once.

    The order depends on the rows and the parameters alone, so a task that runs again deals as before: buckets lie in a
    fixed number of partitions, in order within each, and a bucket's rows are sorted by hash before its generator, which
    Spark seeds by partition, deals them.

    Adds the columns law, shard, slot and grown_shard (null under this law); they replace columns of those names.
    Null ids or texts, empty texts and repeated rows are rows as any other (rows equal in all columns meet in one
    bucket); an empty table gives an empty result. One text is the least that a bucket holds, so memory follows
    the larger of bucket_bytes and the longest text.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = docs.drop("law", "shard", "slot", "grown_shard")
    columns = docs.columns
    total = docs.agg(F.count("*").alias("n"), F.sum(utf8_bytes(F.col(text)) + 64).alias("b")).first()
    buckets = max(1, -(-int(total["b"] or 0) // bucket_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    key = F.xxhash64(F.lit(seed), F.lit("scatter"), *[F.col(f"`{c}`") for c in columns])
    bucket = F.pmod(key, F.lit(buckets)).alias("bucket")
    first = _first_numbers(docs.groupBy(bucket).agg(F.count("*").alias("n")))
    dealt = docs.select(bucket, F.xxhash64(F.lit(seed), F.lit("order"), key).alias("at"), row.alias("row"))
    # a given number of partitions is one that adaptive execution leaves as it is
    lying = dealt.repartition(min(buckets, PARTITIONS), "bucket")
    whole = lying.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows")).sortWithinPartitions("bucket")
    whole = whole.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    placed = whole.join(first, "bucket").select("first", F.posexplode("rows").alias("i", "x"))
    place = (F.col("first") + F.col("i")).alias("place")
    out = placed.select(place, F.col("x.row").alias("row"))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).alias("slot") if n_shards == 1 else F.expr(f"place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard, its rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shuffle_to_shards(docs)
    return out.select(
        "doc_id",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "law", "shard", "slot", "grown_shard",
    )
