"""Removal of long repeated byte strings: ranks of positions at growing lengths, over winnowed positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, RADIX, RADIX_INV, bucketed, cut, mix, powers, raw_bytes, text_slices, winnow

#: Bytes of a repeated string, of the first rank, and starts that one step ranks together.
LENGTH, SEED, STEP = 400, 64, 32
CHUNK = 1 << 22


class Spans:
    """Hashes of any substrings of one text."""

    def __init__(self, data: np.ndarray):
        self.inverse = powers(RADIX_INV, len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * powers(RADIX, len(data)), dtype=np.uint64)]) if len(data) else np.zeros(1, np.uint64)

    def __call__(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + np.uint64(size))


def seeds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start): winnowed SEED-byte strings, such that each string of LENGTH bytes picks one by its content.

    The starts from `first start` to the next one's, or to the last start of the text, pick this seed.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = LENGTH - SEED + 1
    found: list[tuple] = []
    for a in range(0, n - LENGTH + 1, CHUNK):
        part = data[a : a + CHUNK + LENGTH - 1]
        h = Spans(part)(np.arange(len(part) - SEED + 1), SEED)
        place = winnow(h, width)
        # the first start that picks a place is past the starts that pick the one before
        low = _first_starts(h, place, width)
        found.append((h[place], place + a, low + a))
    h, place, low = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate([[True], place[1:] != place[:-1]])  # a place that two chunks pick
    return h[new], place[new], low[new]


def _first_starts(h: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    from .common import sliding_min

    low = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), width)
    picks = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.searchsorted(picks, place, side="left")


def _seeded(docs: DataFrame) -> DataFrame:
    """(th, n, z, kh, pos, low) from (th, text): the text compressed, and its seeds."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, column = batch.column("th"), batch.column("text")
            for a, b in text_slices(column):
                data, ends = raw_bytes(column.slice(a, b - a))
                z, kh, pos, low = [], [], [], []
                for i in range(b - a):
                    own = data[ends[i] : ends[i + 1]]
                    h, p, s = seeds(own)
                    z.append(packer.compress(own.tobytes()))
                    kh.append(h.view(np.int64))
                    pos.append(p.astype(np.int32))
                    low.append(s.astype(np.int32))
                arrays = [ids.slice(a, b - a), pa.array(np.diff(ends)), pa.array(z, pa.binary()), pa.array(kh, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32())), pa.array(low, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["th", "n", "z", "kh", "pos", "low"])

    return docs.mapInArrow(run, "th long, n long, z binary, kh array<long>, pos array<int>, low array<int>")


def _unpack(value) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_py()), dtype=np.uint8)


STEPS = "th long, kh long, step int, i0 int, i1 int, core long, all long"


def _steps(rows: DataFrame) -> DataFrame:
    """For each listed seed, its starts in steps of STEP by their distance to the seed.

    core: hash of the bytes that all strings of the step share; all: hash of the bytes that they cover together, null at
    the ends of a text that lacks some of them.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                data = _unpack(batch.column("z")[i])
                hashes = Spans(data)
                kh, pos, low = (batch.column(c)[i].values.to_numpy() for c in ("kh", "pos", "low"))
                high = np.append(low[1:] - 1, len(data) - LENGTH)
                j = np.sort(batch.column("js")[i].values.to_numpy())
                kh, pos, low, high = kh[j], pos[j].astype(np.int64), low[j].astype(np.int64), high[j].astype(np.int64)
                first, last = (pos - high) // STEP, (pos - low) // STEP
                count = last - first + 1
                step = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                p, lo, hi = np.repeat(pos, count), np.repeat(low, count), np.repeat(high, count)
                begin = p - step * STEP - (STEP - 1)  # of the step's first string
                core = hashes(begin + STEP - 1, LENGTH - STEP + 1)
                there = (begin >= 0) & (begin + STEP - 1 + LENGTH <= len(data))
                both = np.zeros(len(step), np.uint64)
                both[there] = hashes(begin[there], LENGTH + STEP - 1)
                out = [
                    pa.array(np.full(len(step), batch.column("th")[i].as_py(), np.int64)), pa.array(np.repeat(kh, count)), pa.array(step.astype(np.int32)),
                    pa.array(np.maximum(begin, lo).astype(np.int32)), pa.array(np.minimum(begin + STEP - 1, hi).astype(np.int32)),
                    pa.array(core.view(np.int64)), pa.array(both.view(np.int64), mask=~there),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["th", "kh", "step", "i0", "i1", "core", "all"])

    return rows.select("th", "z", "kh", "pos", "low", "js").mapInArrow(run, STEPS)


def _single(rows: DataFrame) -> DataFrame:
    """(th, kh, i, h): the hash of each string whose start lies in a listed step."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                data = _unpack(batch.column("z")[r])
                hashes = Spans(data)
                steps = batch.column("steps")[r].values
                kh, i0, i1 = (steps.field(c).to_numpy() for c in ("kh", "i0", "i1"))
                count = i1 - i0 + 1
                i = (np.repeat(i0, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int64)
                out = [pa.array(np.full(len(i), batch.column("th")[r].as_py(), np.int64)), pa.array(np.repeat(kh, count)), pa.array(i.astype(np.int32)), pa.array(hashes(i, LENGTH).view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=["th", "kh", "i", "h"])

    return rows.select("th", "z", "steps").mapInArrow(run, "th long, kh long, i int, h long")


def _without(rows: DataFrame) -> DataFrame:
    """(th, spans, n_removed, kept_sha256) from texts and the ranges of starts of repeated strings."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {"th": [], "spans": [], "n_removed": [], "kept_sha256": []}
            for r in range(batch.num_rows):
                data = _unpack(batch.column("z")[r])
                runs = batch.column("runs")[r].values
                i0, i1 = runs.field("i0").to_numpy(), runs.field("i1").to_numpy()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, i0, 1)
                np.add.at(edge, i1 + LENGTH, -1)
                gone = np.cumsum(edge)[:-1] > 0
                flips = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = list(zip(np.flatnonzero(flips == 1).tolist(), np.flatnonzero(flips == -1).tolist(), strict=True))
                out["th"].append(batch.column("th")[r].as_py())
                out["spans"].append([{"begin": b, "end": e} for b, e in spans])
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["th"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())],
                names=list(out),
            )

    return rows.select("th", "z", "runs").mapInArrow(run, "th long, spans array<struct<begin:long,end:long>>, n_removed long, kept_sha256 string")


def _gone(texts: DataFrame) -> DataFrame:
    """(th, spans, n_removed, kept_sha256) of the texts that lose something; n_removed is -1 where a text has copies and goes as a whole."""
    seed = texts.select("th", F.posexplode("kh").alias("j", "kh"))
    often = cut(seed.groupBy("kh").agg(F.count("*").alias("m")).filter("m > 1").select("kh"))
    listed = seed.join(often, "kh").groupBy("th").agg(F.collect_list("j").alias("js"))
    steps = cut(_steps(texts.join(listed, "th")))

    whole = cut(steps.filter("all is not null").groupBy("kh", "all").agg(F.count("*").alias("m"), F.min(F.struct("th", "i0")).alias("one")).filter("m > 1"))
    known = cut(steps.join(whole.select("kh", "all", F.lit(True).alias("rep"), "one"), ["kh", "all"], "left").select(steps["th"], "kh", "step", "core", "i0", "i1", "rep", "one"))
    sure = known.filter("rep")
    core = cut(known.groupBy("kh", "step", "core").agg(F.count("*").alias("m"), F.count_if(F.col("rep").isNull()).alias("left")).filter("m > 1 and left > 0").select("kh", "step", "core"))
    one = F.col("rep").isNull() | ((F.col("one.th") == F.col("th")) & (F.col("one.i0") == F.col("i0")))
    open_ = known.filter(one).join(core, ["kh", "step", "core"]).groupBy("th").agg(F.collect_list(F.struct("kh", "i0", "i1")).alias("steps"))
    single = cut(_single(texts.join(open_, "th")))
    twice = cut(single.groupBy("kh", "h").agg(F.count("*").alias("m")).filter("m > 1").select("kh", "h"))
    found = single.join(twice, ["kh", "h"]).select("th", F.col("i").alias("i0"), F.col("i").alias("i1"))

    runs = sure.select("th", "i0", "i1").unionByName(found).groupBy("th").agg(F.collect_list(F.struct("i0", "i1")).alias("runs"))
    unique = texts.filter("copies = 1").select("th", "z")
    return _without(unique.join(runs, "th")).unionByName(
        texts.filter("copies > 1").select("th", F.lit(None).cast("array<struct<begin:long,end:long>>").alias("spans"), F.lit(-1).cast("long").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    )


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) for each row of docs (doc_id and text).

    spans: maximal ranges (begin, end; bytes) that are covered by strings of LENGTH bytes which start anywhere else too,
    in this text or another; kept_sha256: of the other bytes. Null or empty texts: 0 bytes; null ids are ids as others;
    repeated rows are copies of each other; an empty table gives an empty result.

    Ranking every byte's suffix by doubling moves 16 bytes or more for each byte and round. Here a round moves about a
    fifth of a byte for each byte: equal texts become one, and every string of LENGTH bytes is ranked through the seed
    that it picks by its content (winnowing), which all its repetitions pick at the same distance.
    Round 1, SEED bytes: seeds are counted; strings with a unique seed are unique and drop out.
    Round 2, LENGTH - STEP + 1 and LENGTH + STEP - 1 bytes: the starts that pick a repeated seed are taken in steps of
    STEP. A step of which all bytes repeat is repeated as a whole; one whose common bytes are unique drops out.
    Round 3, LENGTH bytes: single starts of the other steps, and of one of each set of equal steps, are ranked.

    A round groups by hash with map-side sums and joins the repeated ones back; join sides are plain shuffles, which
    adaptive execution splits where a string is very common. Texts are moved once, into buckets of their hash, to which each
    round brings its places.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    th = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)).alias("th")
    base = cut(docs.select("doc_id", th, F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")))
    seeded = _seeded(docs.filter(F.octet_length("text") >= LENGTH).select(th, "text"))
    once = seeded.groupBy("th").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("z", "kh", "pos", "low")])
    with bucketed(once, "th") as texts:
        gone = cut(_gone(texts))
    out = base.join(gone, "th", "left")
    all_ = F.col("n_removed") == -1
    return out.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>"))).alias("spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Texts as hexadecimal, two characters a byte; runs of starts that touch are one span, and what lies between is kept.
OP3_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT r, i, hash(substring(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS m FROM k) WHERE m > 1),
g AS (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM c)),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, g),
t AS (SELECT r, a, b FROM s UNION ALL SELECT r, n, n FROM d),
u AS (SELECT t.r, a, b, coalesce(lag(b) OVER (PARTITION BY t.r ORDER BY a, b), 0) AS begin FROM t),
x AS (SELECT u.r, string_agg(substring(h, CAST(2 * begin + 1 AS BIGINT), CAST(2 * (a - begin) AS BIGINT)), '' ORDER BY a, b) AS kept, sum(b - a) AS n_removed, count(*) - 1 AS n_spans FROM u JOIN d USING (r) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN x USING (r)
"""
