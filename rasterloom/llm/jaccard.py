"""N-gram Jaccard join over a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, merged, mix, raw_bytes, shingle_hashes, signed, text_slices, word_hashes, written

#: Words of a shingle, and the least share of common shingles, in percent.
SHINGLE, PERCENT = 5, 80
#: A token counted more often than this within blocks is hot. The HOTTEST most frequent of these come last in the order of tokens.
HOT, HOTTEST = 64, 100_000
#: Shingles of a block of documents within which a task counts repeated tokens (16 MB of hashes).
BLOCK = 1 << 21
#: Members of a group (its row of the matrix is bounded by it).
GROUP_SIZE = 64


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    return np.unique(shingle_hashes(words, size))


def places(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Where each token stands in hot (sorted), -1 where it does not."""
    if not len(hot):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return np.where(hot[at] == tokens, at, -1)


def prefix(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set's sorted tokens, those in hot (sorted) after all others, by rank if given.

    All tokens of all sets stand in this one order, so two sets of similarity 0.8 always have a token of their prefixes
    in common, whatever hot holds.
    """
    n = len(tokens)
    if n and len(hot):
        at = places(tokens, hot)
        late = at >= 0
        last = tokens[late]
        tokens = np.concatenate([tokens[~late], last if rank is None else last[np.argsort(rank[at[late]])]])
    return tokens[: n - (n * PERCENT + 99) // 100 + 1] if n else tokens


def hottest(counts: DataFrame) -> np.ndarray:
    """Sorted tokens of the HOTTEST most frequent rows of counts (tok, df) over HOT."""
    return ranked_hottest(counts)[0]


def ranked_hottest(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, rank): as hottest, with each token's rank from the less frequent to the most frequent one."""
    rows = counts.filter(F.col("df") > HOT).orderBy(F.desc("df"), "tok").limit(HOTTEST).select("tok").toArrow()
    tokens = rows.column("tok").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - 1 - order).astype(np.int64)


def set_of_text(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    return shingle_set(word_hashes(data, np.array([0, len(data)]))[0])


def set_id(tokens: np.ndarray) -> np.ndarray:
    """64 bits that stand for a set."""
    sums = np.array([tokens.sum(dtype=np.uint64), mix(tokens).sum(dtype=np.uint64)])
    return mix(sums[:1] + np.uint64(len(tokens)) * sums[1:])[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < PERCENT * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[place] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _row_sets(batches) -> Iterator[tuple]:
    """(batch, row, set, bytes) of each row of Arrow batches with a column text."""
    for batch in batches:
        column = batch.column("text")
        for a, b in text_slices(column):
            data, ends = raw_bytes(column.slice(a, b - a))
            hashes, _, _, first = word_hashes(data, ends)
            for i in range(b - a):
                yield batch, a + i, shingle_set(hashes[first[i] : first[i + 1]]), data[ends[i] : ends[i + 1]]


def _by_batch(batches) -> Iterator[tuple]:
    """(batch, sets): the sets of each batch's rows, in slices of bounded size."""
    for batch in batches:
        column = batch.column("text")
        for a, b in text_slices(column):
            part = batch.slice(a, b - a)
            yield part, [s for _, _, s, _ in _row_sets([part])]


def _class(tokens: np.ndarray) -> int | None:
    return int(set_id(tokens).astype(np.int64)) if len(tokens) else None


def _counted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, cid, n) of all documents, cid null for an empty set, and rows (tok, c): tokens that c > 1 sets of a block have."""
    kind = docs.schema["doc_id"].dataType

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        ids = to_arrow_type(kind)

        def block(sets: dict):
            tok, c = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            tok, c = tok[c > 1], c[c > 1]
            none = [pa.nulls(len(tok), t) for t in (ids, pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(signed(tok)), pa.array(c.astype(np.int64))], names=["doc_id", "cid", "n", "tok", "c"])

        held: dict[int, np.ndarray] = {}
        size = 0
        for part, sets in _by_batch(batches):
            cids = [_class(s) for s in sets]
            none = [pa.nulls(len(sets), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(ids), pa.array(cids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *none], names=["doc_id", "cid", "n", "tok", "c"])
            for k, s in zip(cids, sets, strict=True):
                if k is not None and k not in held:
                    held[k] = s
                    size += len(s)
                    if size >= BLOCK:
                        yield block(held)
                        held, size = {}, 0
        yield block(held)

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, cid long, n long, tok long, c long")


def _prefixes(docs: DataFrame, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(cid, n, cold, warm) of each row with a set: its prefix, the tokens that are not hot and those that are."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for _, sets in _by_batch(batches):
            cid, n, cold, warm = [], [], [], []
            for s in sets:
                if len(s):
                    first = prefix(s, hot, rank)
                    late = places(first, hot) >= 0
                    cid.append(_class(s))
                    n.append(len(s))
                    cold.append(signed(first[~late]))
                    warm.append(signed(first[late]))
            arrays = [pa.array(cid, pa.int64()), pa.array(n, pa.int32()), pa.array(cold, pa.list_(pa.int64())), pa.array(warm, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["cid", "n", "cold", "warm"])

    return docs.select("text").mapInArrow(run, "cid long, n int, cold array<long>, warm array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    """(cid, n, z) of each row with a set: the text, compressed."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [(_class(s), len(s), packer.compress(raw.tobytes())) for _, _, s, raw in _row_sets([batch]) if len(s)]
            cid, n, z = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(n, pa.int32()), pa.array(z, pa.binary())], names=["cid", "n", "z"])

    return docs.select("text").mapInArrow(run, "cid long, n int, z binary")


def _sizes_fit(n, n0, n1):
    """Whether a set of n tokens can be similar to one of n0 to n1."""
    return (F.col(n) * 100 >= F.col(n0) * PERCENT) & (F.col(n1) * 100 >= F.col(n) * PERCENT)


def _rest_fits(rest, other, n, m):
    """Whether sets of n and m tokens can be similar whose first common token leaves `rest` and `other` tokens, itself included."""
    return F.least(F.col(rest), F.col(other)) * (100 + PERCENT) >= (F.col(n) + F.col(m)) * PERCENT


def _count_fits(common, rest, other, n, m):
    """Whether sets of n and m tokens can be similar that have `common` of their first tokens in common and leave `rest` and `other` after these.

    What else they have in common lies behind the first tokens of the set whose first tokens end earlier in the order.
    """
    return (F.col(common) + F.greatest(F.col(rest), F.col(other))) * (100 + PERCENT) >= (F.col(n) + F.col(m)) * PERCENT


def _shared(rows: DataFrame, hot: bool) -> DataFrame:
    """The rows (tok, cid, n, i, q) whose token another class of fitting size has too; of hot tokens only where places allow a similar pair.

    A class that holds the token first in common with another one needs an overlap of 0.8 / 1.8 (a + b) from there on.
    Tokens that are not hot are moved once, for counting and for the join; hot ones are counted map-side before.
    """
    rows = rows if hot else rows.repartition("tok")
    rest = F.col("n") - F.col("i")
    ends = rows.groupBy("tok").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(rest).alias("most"), F.max("q").alias("q1"))
    # q1 is asked for so that counting and join read the same columns, and so the same shuffle
    ends = ends.filter("c0 < c1 and q1 >= 0")
    joined = rows.join(ends, "tok").withColumn("rest", rest).filter(_sizes_fit("n", "n0", "n1"))
    return (joined.filter(_rest_fits("rest", "most", "n", "n0")) if hot else joined).select("tok", "cid", "n", "i", "q")


def _unpacked(value: bytes, cache: dict, key: int) -> np.ndarray:
    import zstandard

    if key not in cache:
        if len(cache) > 64:
            cache.clear()
        cache[key] = set_of_text(zstandard.ZstdDecompressor().decompress(value))
    return cache[key]


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact comparison of all their shingles."""
    side = texts.select(F.col("cid").alias("a"), F.col("z").alias("za"), F.col("n").alias("na"))
    other = texts.select(F.col("cid").alias("b"), F.col("z").alias("zb"), F.col("n").alias("nb"))
    fits = (F.col("na") * 100 >= F.col("nb") * PERCENT) & (F.col("nb") * 100 >= F.col("na") * PERCENT)

    def run(batches) -> Iterator:
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            a, b, za, zb = (batch.column(c) for c in ("a", "b", "za", "zb"))
            ka, kb = a.to_pylist(), b.to_pylist()
            keep = [similar(_unpacked(za[i].as_py(), cache, ka[i]), _unpacked(zb[i].as_py(), cache, kb[i])) for i in range(len(ka))]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side, "a").join(other, "b").filter(fits).select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _within_bound(queries: DataFrame) -> DataFrame:
    """(cid, gid) of the rows (cid, gid, z, union) whose group's union holds enough of the query's shingles."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            cid, gid = batch.column("cid"), batch.column("gid")
            keep = []
            for k, z, u in zip(cid.to_pylist(), batch.column("z"), batch.column("union"), strict=True):
                q, union = _unpacked(z.as_py(), cache, k), np.frombuffer(u.as_py(), dtype=np.uint64)
                place = np.minimum(np.searchsorted(union, q), len(union) - 1)
                keep.append(100 * int((union[place] == q).sum()) >= PERCENT * len(q))
            yield pa.RecordBatch.from_arrays([cid, gid], names=["cid", "gid"]).filter(pa.array(keep, pa.bool_()))

    return queries.select("cid", "gid", "z", "union").mapInArrow(run, "cid long, gid long")


def _ends(pairs: DataFrame) -> DataFrame:
    """(cid): the classes of pairs (a, b), once."""
    return written(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())


def _unions(members: DataFrame) -> DataFrame:
    """(gid, union): the matrix row of each group, all its members' shingle hashes, sorted."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for gid, zs in zip(batch.column("gid"), batch.column("zs"), strict=True):
                union = np.unique(np.concatenate([set_of_text(unpack(z.as_py())) for z in zs]))
                yield pa.RecordBatch.from_arrays([pa.array([gid.as_py()], pa.int64()), pa.array([union.tobytes()], pa.binary())], names=["gid", "union"])

    return members.groupBy("gid").agg(F.collect_list("z").alias("zs")).mapInArrow(run, "gid long, union binary")


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id and text).

    Words are white-space separated after A-Z became lower case; a document's set holds its distinct runs of SHINGLE
    words (the whole sequence if shorter). Sets link if they share PERCENT percent of their union; component_id is the
    least doc_id that links lead to. Null or empty texts link with nothing; a null doc_id belongs to its component but
    names none; repeated rows come back each. An empty table gives an empty result.

    1. Equal sets become one class, by a 64-bit id of the set.
    2. Prefixes: each class has the first n - ceil(0.8 n) + 1 tokens of its set in one order of all tokens (hot ones last,
       the hottest at the very end, others by hash), so two similar sets always share a token there. Hot tokens are those
       that recur within blocks of documents; which tokens count as hot changes the work, never the result.
    3. Groups: of each shared token, all classes are compared with the plainest one (the fewest tokens before the hot
       ones, then the least id); the links' components, cut to GROUP_SIZE members, are the groups of similar documents.
       A group of copies costs one comparison each.
    4. Token-group matrix: a token within only one component needs no more work. The first common token of a similar
       pair stands early enough in both for the rest to hold the overlap, and tokens in common among the first ones
       (hot ones left out) with all that stand behind must reach it; only such pairs of class and group count. The class
       is then bounded by its overlap with the group's token union; only groups that qualify are opened, and their
       members compared exactly.

    No link is missed up to clashes of 64-bit hashes. Rows of hot tokens are counted map-side and joined by plain shuffles,
    which adaptive execution splits. Texts move only for classes that are to be compared.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    found = written(_counted(docs))
    base = found.filter("n is not null").select("doc_id", "cid", "n")
    hot, rank = ranked_hottest(found.filter("tok is not null").groupBy("tok").agg(F.sum("c").alias("df")))
    classes = written(_prefixes(docs, hot, rank).groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "cold", "warm")]))
    rows = classes.withColumn("q", F.size("cold"))
    cold = _shared(rows.select("cid", "n", "q", F.posexplode("cold").alias("i", "tok")), False)
    warm = _shared(rows.select("cid", "n", "q", F.posexplode("warm").alias("i", "tok")).withColumn("i", F.col("i") + F.col("q")), True)
    probe = written(cold.unionByName(warm).withColumn("rest", F.col("n") - F.col("i")))

    def texts(wanted: DataFrame) -> DataFrame:
        return cut(_texts(docs).join(wanted, "cid").groupBy("cid").agg(F.first("n").alias("n"), F.first("z").alias("z")))

    # a prefix that reaches the hot tokens is the plainer the fewer others stand before
    whole = F.expr(f"n - (n * {PERCENT} + 99) div 100 + 1")
    plain = F.when(F.col("q") < whole, F.col("q") / F.col("n") - 1).otherwise(0.0)
    lead = probe.groupBy("tok").agg(F.min(F.struct(plain.alias("plain"), F.col("cid").alias("b"), F.col("n").alias("m"), F.col("q").alias("p"), F.col("rest").alias("other"))).alias("lead"))
    pairs = probe.join(lead, "tok").select("*", "lead.*").filter(F.col("cid") != F.col("b")).filter(_sizes_fit("n", "m", "m"))
    pairs = pairs.groupBy("cid", "b", "n", "m", (F.col("n") - F.col("q")).alias("behind"), (F.col("m") - F.col("p")).alias("after"))
    pairs = pairs.agg(F.count_if(F.col("i") < F.col("q")).alias("common"), F.max(_rest_fits("rest", "other", "n", "m")).alias("fits"))
    pairs = written(pairs.filter("fits").filter(_count_fits("common", "behind", "after", "n", "m")).select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct())
    comps = connected_components(_links(pairs, texts(_ends(pairs))))

    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    label = comps.join(written(sizes), "comp").select(F.col("id").alias("cid"), "comp", "size")
    part = F.pmod(F.col("cid"), F.expr(f"(size + {GROUP_SIZE - 1}) div {GROUP_SIZE}"))
    gid = F.when(F.col("size").isNull(), F.col("cid")).otherwise(F.xxhash64("comp", part))
    classes = written(probe.select("cid").distinct())
    named = written(classes.join(label, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"), gid.alias("gid"), F.col("size").isNotNull().alias("many")))

    in_comp = written(probe.join(named, "cid"))
    wide = in_comp.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("tok")
    behind = F.col("n") - F.col("q")
    open_ = written(in_comp.join(written(wide), "tok").select("tok", "cid", "comp", "gid", "many", "n", "rest", behind.alias("behind"), (F.col("i") < F.col("q")).alias("cold")))
    matrix = open_.groupBy("tok", "gid", F.col("comp").alias("gcomp"), F.col("many").alias("gmany"))
    matrix = written(matrix.agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("rest").alias("grest"), F.max("behind").alias("gbehind")))
    # n0 and n1 are of the members with this token
    near = open_.drop("gid", "many").join(matrix, "tok").filter(F.col("comp") > F.col("gcomp")).filter(_sizes_fit("n", "n0", "n1"))
    near = near.groupBy("cid", "gid", "gmany", "n", "behind").agg(
        F.count_if("cold").alias("common"), F.max(_rest_fits("rest", "grest", "n", "n0")).alias("fits"), F.min("n0").alias("n0"), F.max("gbehind").alias("gbehind")
    )
    near = written(near.filter("fits").filter(_count_fits("common", "behind", "gbehind", "n", "n0")).select("cid", "gid", "gmany"))
    members = written(named.filter("many").select(F.col("cid").alias("b"), "gid").join(near.filter("gmany").select("gid").distinct(), "gid"))
    single = near.filter("not gmany").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    asked = near.filter("gmany").select("cid", "gid")
    left = texts(written(_ends(single).unionByName(asked.select("cid")).unionByName(members.select(F.col("b").alias("cid"))).distinct()))
    if members.isEmpty():
        opened = single
    else:
        union = _unions(members.join(left.select(F.col("cid").alias("b"), "z"), "b").select("gid", "z"))
        qualify = written(_within_bound(asked.join(left, "cid").join(written(union), "gid")))
        opened = single.unionByName(qualify.join(members, "gid").select(F.col("cid").alias("a"), "b"))
    comps = merged(comps, _links(opened.distinct(), left))

    own = base.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    own = written(own.join(comps.select(F.col("id").alias("cid"), "comp"), "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"), "least"))
    first = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    named_comp = written(own.join(first, "comp").select("cid", "component_id"))
    return base.join(named_comp, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS t
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
