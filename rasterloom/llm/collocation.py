"""Phrase collocations by compressed position bitmaps of words: shift, AND, popcount, summed over shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, mix, word_hashes, written

#: Bytes of text of one shard; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20
#: Bytes of text hashed at once.
SLICE_BYTES = 1 << 19
#: Positions in one block of a bitmap.
BITS = 8
#: Pairs of blocks compared at once, which bounds what an extension holds.
BATCH = 300_000
#: Documents, and shards, that go to Python at once.
DOCS_AT_ONCE, SHARDS_AT_ONCE = 200, 1
#: Bits of the filter of frequent words or pairs that tasks get: 4 MB, whatever the table's size.
FILTER_BITS = 25
#: Bytes that end a piece, and bytes of words: neither blank, tab nor an end of a piece.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAKS
IN_WORD[[0x20, 0x09]] = False

SHARDS = "lang string, words array<string>, hashes array<long>, counts array<long>, starts binary, blocks binary, bits binary"
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << BITS)], dtype=np.int64)
UPPER_TO_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


# ---------------------------------------------------------------- bitmaps


def _occurrences(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash, first byte, end byte, whether a piece begins with it. Slices end where no word is cut."""
    parts, a = [], 0
    while a < len(data):
        b = min(a + SLICE_BYTES, len(data))
        while b < len(data) and IN_WORD[data[b - 1]]:
            rest = IN_WORD[data[b : b + 4096]]
            b += len(rest) if rest.all() else int(np.argmin(rest)) + 1
        part = data[a:b]
        hashes, first, end, _ = word_hashes(part, np.array([0, len(part)]), IN_WORD)
        if len(first):
            broken = np.cumsum(BREAKS[part])
            parts.append((hashes, first + a, end + a, np.concatenate([[True], broken[first[1:]] > broken[end[:-1] - 1]])))
            if len(parts) > 1:  # a slice may end within a piece
                parts[-1][3][0] = BREAKS[data[parts[-2][2][-1] : first[0] + a]].any()
        a = b
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bitmaps(texts: list[bytes], seed: int) -> tuple:
    """Words, hashes, counts and bitmaps of a shard; between two pieces a position stays free.

    The bitmap of word i is entries starts[i] to starts[i + 1] of blocks (numbers, ascending) and bits: only blocks with
    a set bit are held.
    """
    joined = b"\n".join(texts)
    hashes, first, end, begins = _occurrences(np.frombuffer(joined, dtype=np.uint8))
    place = np.arange(len(first)) + np.cumsum(begins)
    keys, at, word, counts = np.unique(mix(hashes + np.uint64(seed)), return_index=True, return_inverse=True, return_counts=True)
    words = [joined[a:b].translate(UPPER_TO_LOWER).decode() for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]
    entry = word.astype(np.int64) << 32 | (place // BITS)
    order = np.argsort(entry, kind="stable")
    entry, bit = entry[order], (1 << (place[order] % BITS)).astype(np.uint8)
    new = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
    bits, entry = (np.bitwise_or.reduceat(bit, new) if len(new) else bit), entry[new]
    starts = np.searchsorted(entry >> 32, np.arange(len(keys) + 1))
    return words, keys, counts, starts, (entry & 0xFFFFFFFF).astype(np.int32), bits


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard of docs (lang, text): its words with their hashes, counts and bitmaps. Texts are not moved."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def row(lang):
            sizes.pop(lang)
            words, keys, counts, starts, blocks, bits = _bitmaps(held.pop(lang), int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "big"))
            cols = [[lang], [words], [keys.view(np.int64)], [counts], [starts.astype(np.int64).tobytes()], [blocks.tobytes()], [bits.tobytes()]]
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["lang", "words", "hashes", "counts", "starts", "blocks", "bits"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = (text or "").encode()
                if lang in held and sizes[lang] + len(b) > shard_bytes:
                    yield row(lang)
                held.setdefault(lang, []).append(b)
                sizes[lang] = sizes.get(lang, 0) + len(b)
        for lang in list(held):
            yield row(lang)

    return docs.mapInArrow(run, SHARDS)


# ---------------------------------------------------------------- extension


def _filter(rows: DataFrame, key: Column):
    """A filter of fixed size over hashes: it lets every one of them through, and others now and then.

    What is let through too much costs work alone: it is counted like all else and falls below the least count.
    """
    mask = (1 << FILTER_BITS) - 1
    probes = F.explode(F.array(key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, FILTER_BITS).bitwiseAND(F.lit(mask))))
    words = rows.select(probes.alias("p")).groupBy(F.expr("p div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("w"))
    table = words.toArrow()  # 2**FILTER_BITS / 64 rows at most
    full = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    full[table.column("at").to_numpy()] = table.column("w").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(full)


def _passes(full: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    ok = np.ones(len(key), dtype=bool)
    for p in (key & mask, (key >> np.uint64(FILTER_BITS)) & mask):
        p = p.astype(np.int64)
        ok &= (full[p >> 6] >> (p & 63)) & 1 == 1
    return ok


def _pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u ^ (v << np.uint64(1) | v >> np.uint64(63))


def pair_key(u: str, v: str) -> Column:
    return F.expr(f"{u} ^ (shiftleft({v}, 1) | shiftrightunsigned({v}, 63))")


class _Shard:
    """The bitmaps of a shard's frequent words, by word and by block."""

    def __init__(self, row: dict, frequent: np.ndarray):
        self.keys = row["hashes"].view(np.uint64)
        starts = np.frombuffer(row["starts"], dtype=np.int64)
        word = np.repeat(np.arange(len(self.keys)), np.diff(starts))
        keep = _passes(frequent, self.keys)[word]
        self.word = word[keep]
        self.block = np.frombuffer(row["blocks"], dtype=np.int32)[keep]
        self.bits = np.frombuffer(row["bits"], dtype=np.uint8)[keep]
        self.by_block = np.argsort(self.block, kind="stable")
        last = int(self.block.max(initial=-1))
        self.block_starts = np.searchsorted(self.block[self.by_block], np.arange(last + 3))

    def extend(self, prefix: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        """Bitmaps of prefixes, one position on, AND those of all words: (prefix, word, block, bits) where any is left."""
        on = (bits.astype(np.int32) << 1) & 0xFF
        over = np.flatnonzero(bits >> 7)
        prefix, block, on = np.concatenate([prefix, prefix[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([on, np.ones(len(over), np.int32)]).astype(np.uint8)
        first = self.block_starts[block]
        many = self.block_starts[block + 1] - first
        total = np.cumsum(many)
        a = 0
        while a < len(prefix):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH, side="right")))
            n = many[a:b]
            at = np.repeat(np.arange(a, b), n)
            entry = self.by_block[first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
            both = on[at] & self.bits[entry]
            left = np.flatnonzero(both)
            yield prefix[at[left]], self.word[entry[left]], block[at[left]], both[left]
            a = b


def _summed(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the popcounts of all their blocks."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], POPCOUNT[bits[order]]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], (np.add.reduceat(count, new) if len(new) else count)


def _rows(batches) -> Iterator[dict]:
    """The shards of Arrow batches, one at a time."""
    for batch in batches:
        hashes = batch.column("hashes")
        for i in range(batch.num_rows):
            yield {"hashes": hashes[i].values.to_numpy(), **{c: batch.column(c)[i].as_buffer() for c in ("starts", "blocks", "bits")}}


def _table(names: list[str], cols: list[np.ndarray]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=names)


def pairs(bitmaps: DataFrame, frequent) -> DataFrame:
    """(u, v, f): occurrences of pairs of frequent words, by the words' hashes."""

    def run(batches) -> Iterator:
        for row in _rows(batches):
            shard = _Shard(row, frequent.value)
            n = len(shard.keys)
            for u, v, _, bits in shard.extend(shard.word, shard.block, shard.bits):
                key, count = _summed(u * n + v, bits)
                yield _table(["u", "v", "f"], [shard.keys[key // max(n, 1)], shard.keys[key % max(n, 1)], count])

    return bitmaps.select("hashes", "starts", "blocks", "bits").mapInArrow(run, "u long, v long, f long").groupBy("u", "v").agg(F.sum("f").alias("f"))


def triples(bitmaps: DataFrame, frequent, frequent_pairs) -> DataFrame:
    """(u, v, w, f): each batch of pairs goes on to its triples before the next one; only frequent pairs do."""

    def run(batches) -> Iterator:
        for row in _rows(batches):
            shard = _Shard(row, frequent.value)
            n, keys = len(shard.keys), shard.keys
            for u, v, block, bits in shard.extend(shard.word, shard.block, shard.bits):
                good = _passes(frequent_pairs.value, _pair_key(keys[u], keys[v]))
                found, prefix = np.unique(u[good] * n + v[good], return_inverse=True)
                for p, w, _, left in shard.extend(prefix, block[good], bits[good]):
                    key, count = _summed(p * n + w, left)
                    two, w = found[key // max(n, 1)], key % max(n, 1)
                    u3, v3 = two // max(n, 1), two % max(n, 1)
                    good3 = _passes(frequent_pairs.value, _pair_key(keys[v3], keys[w]))
                    yield _table(["u", "v", "w", "f"], [keys[u3[good3]], keys[v3[good3]], keys[w[good3]], count[good3]])

    return bitmaps.select("hashes", "starts", "blocks", "bits").mapInArrow(run, "u long, v long, w long, f long").groupBy("u", "v", "w").agg(F.sum("f").alias("f"))


# ---------------------------------------------------------------- phrases


#: Parts in which a language's phrases are ranked before they meet.
RANK_PARTS = 64


def _score(a: str, left: str, right: str) -> str:
    """floor(10**6 * a * a / (left * right)) in decimals of up to 38 digits: exact up to a of 10**14 and products of 10**37."""
    d = lambda c, n: f"cast({c} as decimal({n},0))"
    return f"({d(1000000, 7)} * {d(a, 14)} * {d(a, 14)}) div ({d(left, 18)} * {d(right, 18)})"


def collocations(docs: DataFrame, least: int = 10, absorbed: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two and three words in docs (lang, text) with `least` occurrences.

    Texts lose A-Z to a-z and are split at `[.,;:!?\\x0A-\\x0D]` into pieces, these at blanks and tabs into words. Each
    task deals its documents to shards by language and lays the words of a shard on a line of positions, on which a free
    one parts pieces. A word's bitmap holds its positions in blocks of eight, empty blocks left out. A phrase's bitmap,
    shifted by one and AND-ed with a word's, is the longer phrase's; popcounts are summed over shards. As no phrase is
    more frequent than its parts, only words with `least` occurrences in all shards are extended, and only such pairs
    again; which these are goes to all tasks as a filter of fixed size that lets none of them be missed.

    l and r are the occurrences of the parts of the cut with the lowest score (the first of equals). A phrase within a
    longer one that makes up `absorbed` percent of it is left out.

    Null texts are empty and give nothing, null languages count as `und`; long texts are shards of their own, hashed in
    slices; repeated rows count each; other columns are not looked at; an empty table gives an empty result. Words are
    told apart by 64-bit hashes.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null and text <> ''")
    spark = docs.sparkSession
    with arrow_rows(spark, DOCS_AT_ONCE):
        bitmaps = written(shards(rows, shard_bytes))
    words = bitmaps.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("h")).agg(F.sum("w.counts").alias("f"))
    words = written(words)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    one = words.filter(F.col("f") >= least)
    frequent = _filter(one, F.col("h"))
    with arrow_rows(spark, SHARDS_AT_ONCE):
        two = written(pairs(bitmaps, frequent).filter(F.col("f") >= least))
    frequent_pairs = _filter(two, pair_key("u", "v"))
    with arrow_rows(spark, SHARDS_AT_ONCE):
        three = written(triples(bitmaps, frequent, frequent_pairs).filter(F.col("f") >= least))
    frequent.unpersist()
    frequent_pairs.unpersist()

    f1 = lambda h, f: one.select(F.col("h").alias(h), F.col("f").alias(f))
    f2 = lambda u, v, f: two.select(F.col("u").alias(u), F.col("v").alias(v), F.col("f").alias(f))
    long_ = three.join(f1("u", "l1"), "u").join(f2("v", "w", "r1"), ["v", "w"]).join(f2("u", "v", "l2"), ["u", "v"]).join(f1("w", "r2"), "w")
    long_ = long_.withColumns({"s1": F.expr(_score("f", "l1", "r1")), "s2": F.expr(_score("f", "l2", "r2"))})
    long_ = long_.select("u", "v", "w", "f", F.expr("if(s1 <= s2, l1, l2)").alias("l"), F.expr("if(s1 <= s2, r1, r2)").alias("r"), F.least("s1", "s2").alias("score"))
    # pairs within a triple that makes up `absorbed` percent of them
    inner = three.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("p"), "f")
    most = inner.groupBy(F.col("p.u").alias("u"), F.col("p.v").alias("v")).agg(F.max("f").alias("longer"))
    short = two.join(most, ["u", "v"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("f") * absorbed, F.lit(True)))
    short = short.join(f1("u", "l"), "u").join(f1("v", "r"), "v").select("u", "v", F.lit(None).cast("long").alias("w"), "f", "l", "r", F.expr(_score("f", "l", "r")).alias("score"))
    spelled = lambda h, word: one.select(F.col("h").alias(h), F.col("word").alias(word))
    found = long_.unionByName(short).join(one.select(F.col("h").alias("u"), "lang", F.col("word").alias("wu")), "u").join(spelled("v", "wv"), "v").join(spelled("w", "ww"), "w", "left")
    return found.join(totals, "lang").select("lang", F.concat_ws(" ", "wu", "wv", "ww").alias("phrase"), F.col("f").alias("a"), "l", "r", "n", "score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first `top` phrases of each language by score and a, both descending, and the phrase's bytes, with their rank.

    A language's phrases are ranked in parts first, so no task gets more than RANK_PARTS * top of them.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.drop("place").withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return best(collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")), 2000)


OP13_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), long_runs AS (SELECT lang, w FROM runs WHERE len(w) > 0),
grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM (
    SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM long_runs, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)
), f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS pl, array_to_string(list_slice(w, c + 1, k), ' ') AS pr
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM cand)
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = pl AND x.k = c JOIN f y ON y.lang = cuts.lang AND y.phrase = pr AND y.k = cuts.k - c
), lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored) WHERE o = 1
), inner_ AS (
  SELECT lang, array_to_string(list_slice(w, 1, 2), ' ') AS phrase, a AS longer FROM cand WHERE k = 3
  UNION ALL SELECT lang, array_to_string(list_slice(w, 2, 3), ' '), a FROM cand WHERE k = 3
), most AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL),
kept AS (
  SELECT lowest.lang, lowest.phrase, a, l, r, score FROM lowest LEFT JOIN most ON most.lang = lowest.lang AND most.phrase = lowest.phrase AND lowest.k = 2
  WHERE longer IS NULL OR 100 * longer < 50 * a
), ranked AS (SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals ON totals.lang = kept.lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
