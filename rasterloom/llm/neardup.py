"""Near duplicates among embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, ensure_checkpoint_dir, written

#: Trees; a pair at the threshold is missed by one of them with a change of about 0.02 for each split above its leaf.
TREES = 6
#: Vectors up to which a cell is a leaf, and of a block of a larger one.
LEAF = 1024
#: Half the width of the overlap of two cells, in deviations of the projected difference of a pair at the threshold.
SPILL = 0.5
#: A cell is split at its median if at most this share of it goes to either side, overlap included.
MOST_SIDE = 0.65
#: Directions beyond those that halving needs, for cells that some directions do not split.
SPARE = 5
#: Cells up to which their cuts are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_CELLS = 100_000
SEED = 12


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, some component not zero."""
    finite = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda e: e != 0), F.lit(False))


def _units(column) -> np.ndarray:
    """An Arrow column of vectors of one length as rows of length 1."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column.to_pylist()])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _projected(classes: DataFrame, trees: int, levels: int) -> DataFrame:
    """(cid, dim, tree, node, p): a row for each tree with the vector's places along the tree's directions, one for each level."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column("dim").to_numpy())
            for dim in np.unique(dims).tolist():
                if dim not in directions:
                    d = np.random.default_rng([SEED, dim]).standard_normal((dim, trees * levels))
                    directions[dim] = d / np.linalg.norm(d, axis=0)
                at = pa.array(np.flatnonzero(dims == dim))
                p = _units(batch.column("embedding").take(at)) @ directions[dim]
                n = len(at) * trees
                flat = pa.array(p.astype(np.float32).ravel())
                places = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * levels), flat)
                cids = np.repeat(batch.column("cid").take(at).to_numpy(), trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cids), pa.array(np.full(n, dim, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(at))), pa.array(np.ones(n, np.int64)), places],
                    names=["cid", "dim", "tree", "node", "p"],
                )

    return classes.select("cid", "dim", "embedding").mapInArrow(run, "cid long, dim int, tree int, node long, p array<float>")


def _leaves(classes: DataFrame, n: int, threshold: float, trees: int, leaf: int) -> DataFrame:
    """(cid, tree, leaf, size): the leaves of every tree; a vector near a cut is in several of one tree.

    All cells of a level are split at once, each at its own median along the level's direction, found by one grouped
    approximate quantile. A cell that the direction does not split, since most of it lies in the overlap, waits for the
    next one; what is still large after the last level is a large leaf.
    """
    levels = max(0, math.ceil(1.2 * math.log2(max(1, n / leaf)))) + SPARE
    cell = ["dim", "tree", "node"]
    active = written(_projected(classes, trees, levels))
    done = None
    margin = F.lit(SPILL * math.sqrt(2 - 2 * threshold)) / F.sqrt("dim")
    for level in range(levels + 1):
        at = F.element_at("p", level + 1) if level < levels else F.lit(None).cast("float")
        cuts = F.percentile_approx(at, [1 - MOST_SIDE, 0.5, MOST_SIDE], 200).alias("cut")
        cells = written(active.groupBy(cell).agg(F.count("*").alias("size"), cuts).withColumn("splits", F.coalesce((F.col("cut")[0] < F.col("cut")[1] - margin) & (F.col("cut")[2] > F.col("cut")[1] + margin), F.lit(False))))
        n_cells, n_large = cells.agg(F.count("*"), F.count_if(F.col("size") > leaf)).first()
        placed = active.join(F.broadcast(cells) if n_cells <= BROADCAST_CELLS else cells, cell)
        ended = placed.filter(F.col("size") <= leaf) if level < levels else placed
        ended = ended.select("cid", "tree", F.xxhash64("dim", "tree", "node", F.lit(level)).alias("leaf"), "size")
        done = ended if done is None else done.unionByName(ended)
        if not n_large or level == levels:
            return written(done)
        left, right = at <= F.col("cut")[1] + margin, at >= F.col("cut")[1] - margin
        sides = F.when(~F.col("splits"), F.array(F.col("node") * 2)).otherwise(F.filter(F.array(F.when(left, F.col("node") * 2), F.when(right, F.col("node") * 2 + 1)), lambda x: x.isNotNull()))
        active = written(placed.filter(F.col("size") > leaf).select("cid", "dim", "tree", F.explode(sides).alias("node"), "p"))


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of the threshold or more; what is close to it is summed exactly."""
    g = a @ b.T
    linked = g >= threshold
    for i, j in zip(*np.nonzero(np.abs(g - threshold) < 1e-12), strict=True):
        linked[i, j] = math.fsum((a[i] * b[j]).tolist()) >= threshold
    return linked


def _compare(threshold: float):
    """f(block pair of a leaf) -> (cid, n, other): links that no leaf with a smaller id shows, and a spanning forest of all links."""

    def run(table):
        import pyarrow as pa

        home = table.column("leaf")[0].as_py()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        cid, many, block = (table.column(c).to_numpy() for c in ("cid", "m", "block"))
        x = _units(table.column("embedding"))
        rows = np.flatnonzero(block == lo)
        cols = rows if lo == hi else np.flatnonzero(block == hi)
        linked = _linked(x[rows], x[cols], threshold)
        if lo == hi:
            np.fill_diagonal(linked, False)
        r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked, rows, cols = linked[np.ix_(r, c)], rows[r], cols[c]
        out_id, out_n, out_other = [], [], []
        if len(rows):
            # pairs that meet in a leaf with a smaller id are counted there
            lists = table.column("leaves").to_pylist()
            place: dict[int, int] = {}
            at = [[place.setdefault(v, len(place)) for v in lists[i] if v < home] for i in np.concatenate([rows, cols])]
            held = np.zeros((len(at), max(1, len(place))), dtype=np.float32)
            for i, have in enumerate(at):
                held[i, have] = 1
            new = linked & (held[: len(rows)] @ held[len(rows) :].T == 0)
            for ids, n in ((rows, new @ many[cols]), (cols, many[rows] @ new if lo != hi else np.zeros(len(cols), np.int64))):
                out_id.append(cid[ids][n > 0])
                out_n.append(n[n > 0])
                out_other.append(np.full(int((n > 0).sum()), -1, np.int64))
            # labels: least row that is reached
            up, down = np.arange(len(rows)), np.zeros(len(cols), np.int64)
            while True:
                down = np.where(linked, up[:, None], len(rows)).min(axis=0)
                next_ = np.minimum(up, np.where(linked, down[None, :], len(rows)).min(axis=1))
                if (next_ == up).all():
                    break
                up = next_
            for ids, root in ((rows, rows[up]), (cols, rows[down])):
                other = cid[root] != cid[ids]
                out_id.append(cid[ids][other])
                out_n.append(np.zeros(int(other.sum()), np.int64))
                out_other.append(cid[root][other])
        cols_ = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (out_id, out_n, out_other)]
        return pa.table([pa.array(v) for v in cols_], names=["cid", "n", "other"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding).

    Equal vectors are one class, compared once. Each of `trees` trees splits the classes by random directions at medians;
    what lies close to a cut goes to both sides. The vectors of a leaf are compared with each other by exact cosines; a
    leaf of more than `leaf` vectors, a dense cluster that cuts would tear apart, is compared block by block, so no task
    gets more than two blocks and nothing is left out. A pair is counted in the first of the leaves that hold both, and
    counts and a spanning forest of its links are all that leaves a task; pairs are not. So links are found once each,
    none below the threshold, and components come from the forests.

    Null, zero and empty vectors and those with null or non-finite components link with nothing; vectors of different
    lengths do not link. Repeated rows are vectors of their own and link with each other; of null ids the component's
    least other id is taken, or null; other columns are not looked at; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding")
    grouped = vectors.filter(usable(F.col("embedding"))).groupBy("embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("first"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), F.size("embedding").alias("dim"), "embedding", "m", "first"))
    leaves = _leaves(classes, classes.count(), threshold, trees, leaf)
    held = written(leaves.groupBy("cid").agg(F.collect_set("leaf").alias("leaves")))
    found = None
    for tree in range(trees):
        own = leaves.filter(F.col("tree") == tree).drop("tree").join(classes.select("cid", "embedding", "m"), "cid").join(held, "cid")
        blocks = F.ceil(F.col("size") / leaf).cast("int")
        own = own.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        own = own.select("leaf", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "cid", "m", "embedding", "leaves")
        part = written(own.groupBy("leaf", "lo", "hi").applyInArrow(_compare(threshold), "cid long, n long, other long"))
        found = part if found is None else found.unionByName(part)
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = connected_components(found.filter("other >= 0"), "cid", "other").select(F.col("id").alias("cid"), "comp")
    named = written(classes.join(comps, "cid", "left").join(links, "cid", "left").select("embedding", "first", F.coalesce("comp", "cid").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    out = vectors.join(named.join(least, "comp").select("embedding", "n_links", "component_id"), "embedding", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_near_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id
"""
