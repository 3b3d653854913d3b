"""Helpers shared by the text operators: checkpoints, vectorised hashing of words, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ONE = np.uint64(1)
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
RADIX = 0x9E3779B97F4A7C15
RADIX_INV = pow(RADIX, -1, 1 << 64)


# ---------------------------------------------------------------- checkpoints


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder from the session; make one only where none is set and one machine does everything."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="rasterloom-checkpoint-")
    sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: no lineage, no lost partition."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut, for the tables of an iteration: a Parquet table in the shared folder, in as few files as its size asks for.

    A checkpoint keeps the order, partitioning and constraints of its plan; from round to round these nest into each
    other and fill the driver. The tables go when the program ends.
    """
    spark = df.sparkSession
    path = _table_path(spark)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_path(spark: SparkSession) -> str:
    """A new path in the shared folder, gone when the program ends."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    top = f"{sc.getCheckpointDir()}/tables-{sc.applicationId}"
    if top not in _tops:
        _tops.add(top)
        atexit.register(_remove, sc, top)
    return f"{top}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df written once in buckets of key, as many as shuffles have partitions: joins and groups by key move only what they bring to it.

    For wide rows that several joins need; a checkpoint forgets how its rows are dealt, so that each join would move them
    again. The table is removed at the end, so what is made of it must be written within.
    """
    spark = df.sparkSession
    path, name = _table_path(spark), f"bucketed_{uuid.uuid4().hex}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    df.write.option("path", path).bucketBy(n, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark.sparkContext, path)


#: Buckets of a table that Spark allows.
MOST_BUCKETS = 100_000
#: Tables written within each `kept` that is being made, the innermost last.
_scratch: list[list[str]] = []


def kept(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns as a written table; the tables that were written on the way are removed then, as nothing reads them again, and so are the shuffles."""
    _scratch.append([])
    try:
        out = written(make())
    finally:
        paths = _scratch.pop()
    result = paths.pop()
    if _scratch:
        _scratch[-1].append(result)
    for path in paths:
        _remove(spark.sparkContext, path)
    # Spark removes the files of a shuffle once the driver has collected the plan that made it; the listeners' queue holds the last one until another comes
    spark.range(0).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within, rows go to Python in Arrow batches of n, for rows of many bytes; for actions alone, as plans are made late."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of one id up to which a list of ids is broadcast (8 MB of ids); a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def listed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids (one column, once each): filtered where they are read if the ids, counted first, are few enough."""
    ids = ids.select(key)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


_tops: set[str] = set()


def _remove(sc, top: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = sc._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- columns


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- vectorised hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(RADIX)) | ONE
#: Upper-case A-Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no white space: not in 0x20, 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:  # longer ones are not kept
            _powers[base] = have
    return have[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_slices(column, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow text column of about `most` bytes each; a longer text is a range of its own."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def raw_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text or binary column laid end to end, and where each row begins (one more entry for the end)."""
    rows = [b"" if v is None else (v.encode() if isinstance(v, str) else v) for v in column.to_pylist()]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int64)
    return np.frombuffer(b"".join(rows), dtype=np.uint8), ends


def word_hashes(data: np.ndarray, ends: np.ndarray, in_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of the rows: (hashes, first byte, end byte, index of each row's first word and one more).

    Words are runs of bytes that in_word allows, after A-Z became lower case; none crosses rows.
    """
    n = len(data)
    if not n:
        zero = np.zeros(0, dtype=np.int64)
        return np.zeros(0, np.uint64), zero, zero, np.zeros(len(ends), dtype=np.int64)
    low = LOWER[data]
    inside = in_word[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[1:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    stops[before] = inside[before]
    starts, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, last, np.zeros(len(ends), dtype=np.int64)
    value = BYTE[low]
    value[~inside] = 0
    value *= powers(RADIX, n)
    sums = np.add.reduceat(value, starts)
    hashes = mix(sums * powers(RADIX_INV, n)[starts] + (last - starts).astype(np.uint64))
    return hashes, starts, last, np.searchsorted(starts, ends)


#: Odd multipliers, one for each place in a shingle.
PLACE = mix(np.arange(1000, 1064, dtype=np.uint64)) | ONE


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter, and none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    k = min(size, n)
    total = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * PLACE[j]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours (van Herk: prefix and suffix minima of blocks)."""
    n = len(values)
    if n <= width:
        return values.min(keepdims=True) if n else values
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, dtype=values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def winnow(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some window of `width` places, the first of equals.

    Values count by their upper 32 bits; the lower ones hold the place. What a window picks depends on its values alone.
    """
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.int64)
    low = sliding_min((values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), width)
    picked = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (picked & np.uint64(0xFFFFFFFF)).astype(np.int64)


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find over undirected edges: (id, comp), comp the least id of the component.

    Each round hooks every node below its least neighbour, lets it point past that one, and replaces the edges by those
    between what the ends point at now, with the paths that are not yet flat. Only minima are grouped by node, so a node
    with very many edges is summed where they are read; the joins have plain shuffled inputs, which adaptive execution
    splits where one key is hot. A round is three written tables. Nodes without an edge do not appear.
    """
    cur = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    labels = None
    while True:
        ends = F.explode(F.array(F.struct(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("up")), F.struct(F.least("a", "b").alias("id"), F.least("a", "b").alias("up"))))
        hooked = written(cur.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.min("e.up").alias("up")))
        above = hooked.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        higher = hooked.select(F.col("id").alias("upper"), F.col("up").alias("highest"))
        parent = written(hooked.join(above, "up").join(higher, "upper").select("id", F.col("highest").alias("up")))
        if labels is None:
            labels = parent.withColumnRenamed("up", "comp")
        else:
            step = parent.select(F.col("id").alias("comp"), F.col("up").alias("next"))
            labels = labels.join(step, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
        to_a = parent.select(F.col("id").alias("a"), F.col("up").alias("ca"))
        to_b = parent.select(F.col("id").alias("b"), F.col("up").alias("cb"))
        moved = cur.join(to_a, "a").join(to_b, "b").select("ca", "cb")
        steep = parent.select(F.col("id").alias("ca"), F.col("up").alias("cb")).filter("ca <> cb")
        # a node that others point at and that points on itself
        steep = steep.join(parent.select(F.col("up").alias("ca")).distinct(), "ca", "left_semi").select("ca", "cb")
        cur = written(moved.union(steep).filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        if cur.isEmpty():
            return written(labels)
        labels = written(labels)


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (id, comp) after more links (a, b): only the components that these join are worked on."""
    a = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = connected_components(ends).select(F.col("id").alias("comp"), F.col("comp").alias("next"))
    moved = comps.join(new, "comp", "full").select(F.coalesce("id", "comp").alias("id"), F.coalesce("next", "comp").alias("comp"))
    return written(moved)
