"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Prefix words and windows up to which they are broadcast (a row of a few hundred bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 50_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: lower-cased runs of ASCII letters and digits and of all characters beyond ASCII. Null: none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item_id, w, n): each run of `size` words of an item, or all its words if they are fewer, but not none."""
    words = items.select(F.col("item_id"), words_of(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(size))
    at = words.select("item_id", "ws", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("i"))
    return at.select("item_id", F.slice("ws", F.col("i"), F.col("n")).alias("w"), "n")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """Windows of benchmark items found in documents: (row columns of docs, n_words, hits, items).

    hits: sorted distinct places (from 0) of the document's words that lie in an occurrence of a window; items: sorted
    distinct ids, as text, of the items with an occurring window.

    A window is the set of its words by place, to be contained whole, so the prefix that a filter needs is one word: its
    rarest, by counts of the benchmark's words over all documents. Documents' words are joined with these prefix words;
    a pair survives the length and positional bounds if the window fits in the document around the word; what is left is
    compared word by word. The document carries an end mark that always joins, so one scan returns clean documents too.

    The benchmark's words are counted over all documents by map-side sums. Both small tables are broadcast up to
    BROADCAST_ROWS rows, which is counted first; a larger benchmark joins by a shuffle of the words with the window's
    reach around each, of the windows' prefix words only where these can be broadcast. Null or empty texts have no words;
    null item ids count as an item of the empty name; repeated items or documents are counted as they come; empty tables
    give empty hits. Other columns of docs come back whatever their names; n_words, hits and items are replaced.
    """
    windows = cut(windows_of(items.select("item_id", "text"), window).groupBy("w", "n").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids")))
    vocabulary = cut(windows.select(F.explode("w").alias("word")).distinct())
    broadcast = windows.count() <= BROADCAST_ROWS and vocabulary.count() <= 4 * BROADCAST_ROWS
    hint = F.broadcast if broadcast else (lambda df: df)
    said = docs.select(F.explode(words_of(F.col(f"`{text}`"))).alias("word"))
    counts = said.join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    df = vocabulary.join(counts, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    places = windows.select("w", "n", "ids", F.posexplode("w").alias("at", "word")).join(df, "word")
    rarest = places.groupBy("w", "n", "ids").agg(F.min(F.struct("df", "at", "word")).alias("least"))
    prefix = rarest.select(F.col("least.word").alias("prefix"), "w", F.col("n").cast("int").alias("n"), F.col("least.at").cast("int").alias("at"), "ids")
    mark = docs.sparkSession.range(1).select(F.lit("").alias("prefix"), F.array(F.lit("")).alias("w"), F.lit(1).alias("n"), F.lit(0).alias("at"), F.array(F.lit("")).alias("ids"))
    prefix = cut(prefix.unionByName(mark))
    # the other columns travel as one, so no name of theirs meets one used here
    columns = [c for c in docs.columns if c not in (text, "n_words", "hits", "items")]
    row = F.struct(F.lit(True).alias("f"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(columns)])
    # no lambda from here to the aggregation, so scan, explosion, join and comparison compile to one loop over the words
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), row.alias("_row"), F.concat(words_of(F.col(f"`{text}`")), F.array(F.lit(""))).alias("_ws"))
    at = rows.select("*", (F.size("_ws") - 1).alias("_n"), F.posexplode("_ws").alias("_i", "_word"))
    if broadcast:
        near, place = F.col("_ws"), F.col("_i")
    else:
        # the words that a window can reach from this one travel with it
        some = prefix.select(F.col("prefix").alias("_word")).distinct()
        if some.count() <= 4 * BROADCAST_ROWS:
            at = at.join(F.broadcast(some), "_word", "left_semi")
        begin = F.greatest(F.col("_i") - (window - 1), F.lit(0))
        at = at.select("_id", "_row", "_n", "_i", "_word", F.slice("_ws", begin + 1, F.lit(2 * window - 1)).alias("_near"), begin.alias("_begin"))
        near, place = F.col("_near"), F.col("_i") - F.col("_begin")
    first = place - F.col("at")
    whole = (first >= 0) & (first + F.col("n") <= F.size(near)) & (F.slice(near, F.greatest(first, F.lit(0)) + 1, F.col("n")) == F.col("w"))
    met = at.join(hint(prefix), (F.col("_word") == F.col("prefix")) & whole)
    run = F.when(F.col("prefix") != "", F.struct((F.col("_i") - F.col("at")).alias("i"), F.col("n"), F.col("ids")))
    out = met.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("_n").alias("n_words"), F.collect_list(run).alias("runs"))
    spread = F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1)))
    names = F.flatten(F.transform("runs", lambda r: r["ids"]))
    keep = [F.col("_row")[f"f{i}"].alias(c) for i, c in enumerate(columns)]
    return out.select(*keep, "n_words", F.array_sort(F.array_distinct(spread)).alias("hits"), F.array_sort(F.array_distinct(names)).alias("items"))


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    n_hit = F.size("hits").cast("long")
    out = contamination(docs, items).withColumn("n_words", F.col("n_words").cast("long")).withColumn("n_hit", n_hit)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark
), w AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM w),
r AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)
), h AS (SELECT r.doc_id, r.i, r.n, w.item_id FROM r JOIN w ON r.n = w.n AND r.s = w.s),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
