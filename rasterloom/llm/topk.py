"""Exact top-k inner products by the three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ensure_checkpoint_dir

#: Queries of one pass; what is broadcast is bounded by it, whatever the table's size.
QUERY_BLOCK = 8192
#: Rows scored at once: a block of scores takes QUERY_STEP * ROW_STEP * 8 bytes.
ROW_STEP, QUERY_STEP = 2048, 1024
LISTS = "qid long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 256.0, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double; rows that are null or hold null or non-finite components go."""
    x = F.transform(F.col(vec), lambda e: F.floor(e.cast("double") * F.lit(scale)))
    fine = F.forall(F.col(vec), lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return vectors.filter(F.col(vec).isNotNull() & F.col(vec_id).isNotNull()).filter(fine).select(F.col(vec_id).alias("vec_id"), x.alias("v"))


def _matrices(rows: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and vectors; vectors of unequal lengths have no inner product."""
    by: dict[int, list] = {}
    for i, v in rows:
        by.setdefault(len(v), []).append((i, v))
    return {n: (np.array([i for i, _ in x], dtype=np.int64), np.array([v for _, v in x], dtype=np.int64).reshape(len(x), n)) for n, x in by.items()}


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where every sum is below 2**53."""
    n = q.shape[1]
    if not n:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * n < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _blocks(batches, queries) -> Iterator[tuple]:
    """Query and row blocks of equal vector length: ids, scores over the first half of the dimensions, second halves, which are a query's own rows."""
    for batch in batches:
        rows = _matrices(list(zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True)))
        for n, (ids, x) in rows.items():
            if n not in queries:
                continue
            qids, q = queries[n]
            half = n // 2
            for r in range(0, len(ids), ROW_STEP):
                xi, xb = ids[r : r + ROW_STEP], x[r : r + ROW_STEP]
                for c in range(0, len(qids), QUERY_STEP):
                    qi, qb = qids[c : c + QUERY_STEP], q[c : c + QUERY_STEP]
                    yield qi, xi, _scores(qb[:, :half], xb[:, :half]), qb[:, half:], xb[:, half:], qi[:, None] == xi[None, :]


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    import pyarrow as pa

    cols = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else ([], [], []))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of `vectors` (vec_id, v) with the greatest inner product with each query: (query_id, rank, vec_id, score).

    The dimensions are cut into two halves, the lists over which the threshold is uniform.
    Phase 1: each task takes, for each query and half, the k rows with the greatest score over that half, and sends their
    full scores; the k-th best of these is a lower bound t of the query's k-th best score.
    Phase 2: t goes to all tasks. A row with a full score of t or more has t/2 or more over one half at least, so the
    rows with a half score of t/2 or more suffice.
    Phase 3: for these alone the other half is added, and rows of t or more are returned and ranked, ties to the smaller
    id. Both halves of a row lie in one task here, so phases 2 and 3 share a scan, and rows whose first half and the
    lengths of the second keep them below t for all queries of a block are passed over after half the work.

    Null ids or vectors, and vectors with null or non-finite components, go in `quantised`; empty vectors score 0 with
    each other; an empty table gives an empty result; other columns are not looked at.

    Queries are handled in blocks of about `query_block`, each against all rows; only one block of vectors and cutoffs is
    broadcast at a time. A query's own id is never its result. Repeated rows count each; a query id that occurs with
    several vectors counts once, with the least vector. Rows of another length than the query's are no candidates.
    Scores are 64-bit sums; components above 2**30 or so would exceed them.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    vectors = cut(vectors)
    queries = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # at most about query_block rows
        sent = spark.sparkContext.broadcast(_matrices([(r["vec_id"], r["v"]) for r in rows]))

        def lists(batches, sent=sent):
            best: dict[int, dict[tuple[int, int], int]] = {}
            for qi, xi, s1, q2, x2, own in _blocks(batches, sent.value):
                low, s2 = -np.iinfo(np.int64).max, _scores(q2, x2)  # its negative is a number too, so a query's own row comes last
                full = s1 + s2
                take = min(k, len(xi))
                for s in (s1, s2):
                    s = np.where(own, low, s)
                    top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                    for row, at in enumerate(top):
                        have = best.setdefault(int(qi[row]), {})
                        for j in at.tolist():
                            if not own[row, j]:
                                have[int(xi[j]), j] = int(full[row, j])
                        if len(have) > 8 * k:
                            best[int(qi[row])] = dict(sorted(have.items(), key=lambda e: -e[1])[:k])
            out = [(q, i, s) for q, have in best.items() for (i, _), s in sorted(have.items(), key=lambda e: -e[1])[:k]]
            a = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield _table([(a[:, 0], a[:, 1], a[:, 2])])

        # each task sends its own k best full scores among the listed rows: their k-th best over all is still a lower bound
        firsts = vectors.mapInArrow(lists, LISTS)
        floor = {r["qid"]: r["t"] for r in _kth(firsts, k).collect()}
        cutoffs = spark.sparkContext.broadcast(floor)

        def resolve(batches, sent=sent, cutoffs=cutoffs):
            low = np.iinfo(np.int64).min // 4
            parts = []
            for qi, xi, s1, q2, x2, own in _blocks(batches, sent.value):
                t = np.array([low if (v := cutoffs.value.get(int(q))) is None else v for q in qi], dtype=np.int64)[:, None]
                # no second half adds more than the product of the lengths; rows that this keeps below t for all queries end here
                reach = s1 + _lengths(q2)[:, None] * _lengths(x2)[None, :] * (1 + 1e-9) + 1
                open_ = (reach >= t) & ~own
                some = np.flatnonzero(open_.any(axis=0))
                if not len(some):
                    continue
                s1, s2, xi = s1[:, some], _scores(q2, x2[some]), xi[some]
                near = ((2 * s1 >= t) | (2 * s2 >= t)) & open_[:, some]
                r, c = np.nonzero(near)
                full = s1[r, c] + s2[r, c]
                keep = full >= t[r, 0]
                parts.append((qi[r[keep]], xi[c[keep]], full[keep]))
                if sum(len(p[0]) for p in parts) > 100_000:
                    yield _table(parts)
                    parts = []
            yield _table(parts)

        some = cut(vectors.mapInArrow(resolve, LISTS))
        found = some if found is None else found.unionByName(some)
        sent.unpersist()
        cutoffs.unpersist()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")


def _kth(lists: DataFrame, k: int) -> DataFrame:
    """(qid, t): the k-th best score of each query's lists, null if there are fewer."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    best = lists.withColumn("r", rank).filter(F.col("r") <= k)
    return best.groupBy("qid").agg(F.min(F.when(F.col("r") == k, F.col("score"))).alias("t"))


def op6_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
