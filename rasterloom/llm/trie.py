"""Prefix trie of conversations: a Cartesian tree over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, written

#: Turns of a conversation whose names are laid end to end as one key; longer conversations are named in rounds.
CHUNK = 256
#: Neighbours in one block of the search for smaller values.
BLOCK = 4096
#: Hex digits of a turn's name (128 bits) and of a chunk's.
TURN, NAME = 32, 16
#: Original turns that a rebuilt conversation may take from another one.
HEAD = 5


# ---------------------------------------------------------------- ranks and running sums


def numbered(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df in one global order: `rank` from 0, and `total_<c>`, the sum of c over all rows up to this one.

    Rows are dealt by range and sorted; each task counts its own, and what the tasks before it hold, a row a task, is
    added. So no group of equal keys is ever one task's.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    extra = ["part_", "rank", *[f"total_{c}" for c in sums]]

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, so_far = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in batches:
            cols = [pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))]
            for c in sums:
                run_ = np.cumsum(batch.column(c).to_numpy().astype(np.int64)) + so_far[c]
                so_far[c] = int(run_[-1]) if len(run_) else so_far[c]
                cols.append(pa.array(run_))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *extra])

    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ", ".join([*fields, *[f"{c} long" for c in extra]])))
    ends = local.groupBy("part_").agg(F.count("*").alias("rank"), *[F.max(F.struct("rank", f"total_{c}"))[f"total_{c}"].alias(f"total_{c}") for c in sums]).orderBy("part_").collect()  # one row a partition
    before, rows = {c: 0 for c in extra[1:]}, []
    for r in ends:
        rows.append((r["part_"], *before.values()))
        before = {c: v + r[c] for c, v in before.items()}
    names = ["part_", *[f"before_{c}" for c in extra[1:]]]
    offsets = df.sparkSession.createDataFrame(rows or [tuple([0] * len(names))], ", ".join(f"{c} long" for c in names))
    out = local.join(F.broadcast(offsets), "part_")
    return out.select(*[F.col(f"`{f.name}`") for f in df.schema.fields], *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in extra[1:]])


# ---------------------------------------------------------------- blocks: nearest smaller values, minima of ranges


def _block(pos: str, block: int) -> Column:
    return F.expr(f"{pos} div {block}L")


def _searched(sign: int):
    """f(values, queries) of a block: for each query (pos, v) the nearest value before pos (sign 1) or after it (-1) that is smaller than v, by a stack of rising values."""

    def run(values, queries):
        import pyarrow as pa

        vp, vv = values.column("pos").to_numpy() * sign, values.column("v").to_numpy()
        qp, qv = queries.column("pos").to_numpy() * sign, queries.column("v").to_numpy()
        order = np.argsort(vp)
        vp, vv = vp[order].tolist(), vv[order].tolist()
        at, below, none = np.zeros(len(qp), np.int64), np.zeros(len(qp), np.int64), np.ones(len(qp), bool)
        stack, held, k = [], [], 0
        for q in np.argsort(qp).tolist():
            while k < len(vp) and vp[k] < qp[q]:
                cut = bisect_left(stack, vv[k])
                stack[cut:], held[cut:] = [vv[k]], [vp[k]]
                k += 1
            j = bisect_left(stack, qv[q]) - 1
            if j >= 0:
                at[q], below[q], none[q] = held[j] * sign, stack[j], False
        return pa.table([queries.column("blk"), queries.column("pos"), queries.column("v"), pa.array(at, mask=none), pa.array(below, mask=none)], names=["blk", "pos", "v", "at", "below"])

    return run


def nearest_smaller(values: DataFrame, queries: DataFrame, sign: int, block: int = BLOCK) -> DataFrame:
    """(pos, v, at, below): for each distinct query (pos, v) the nearest place before pos (sign 1) or after it (-1) whose value `below` is smaller than v.

    values: (pos, v), positions from 0. Blocks of `block` neighbours are searched at once; what finds nothing in its own
    block asks the blocks' minima, by the same search one level up, for the nearest block that has a smaller value, and
    looks it up there.
    """
    values = values.withColumn("blk", _block("pos", block))
    queries = queries.select("pos", "v").distinct()
    kind = "blk long, pos long, v long, at long, below long"
    find = lambda q: values.groupBy("blk").cogroup(q.groupBy("blk")).applyInArrow(_searched(sign), kind)
    found = written(find(queries.withColumn("blk", _block("pos", block))))
    missed = found.filter("at is null")
    minima = written(values.groupBy(F.col("blk").alias("pos")).agg(F.min("v").alias("v")))
    if missed.isEmpty() or minima.count() == 1:
        return found.drop("blk")
    up = written(nearest_smaller(minima, missed.select(F.col("blk").alias("pos"), "v"), sign, block).select(F.col("pos").alias("blk"), "v", F.col("at").alias("to")))
    edge = F.expr(f"(blk + 1) * {block}L" if sign == 1 else f"blk * {block}L - 1").alias("pos")
    down = find(up.filter("to is not null").select(F.col("to").alias("blk"), "v").distinct().select("blk", edge, "v"))
    answers = up.join(down.select(F.col("blk").alias("to"), "v", "at", "below"), ["to", "v"], "left").select("blk", "v", "at", "below")
    return found.filter("at is not null").drop("blk").unionByName(missed.drop("at", "below").join(answers, ["blk", "v"]).drop("blk"))


def _least(values, ranges):
    """Minimum of each range (lo, hi) of a block, by minima over powers of two."""
    import pyarrow as pa

    pos, v = values.column("pos").to_numpy(), values.column("v").to_numpy()
    order = np.argsort(pos)
    v = v[order]
    lo, hi = ranges.column("lo").to_numpy(), ranges.column("hi").to_numpy()
    out = np.zeros(len(lo), np.int64)
    if len(lo):
        a, n = lo - pos.min(), hi - lo + 1
        power = np.frexp(n.astype(np.float64))[1] - 1
        for k in range(int(power.max()) + 1):
            here = power == k
            out[here] = np.minimum(v[a[here]], v[a[here] + n[here] - (1 << k)])
            v = np.minimum(v[: len(v) - (1 << k)], v[1 << k :]) if len(v) > 1 << k else v
    return pa.table([ranges.column("lo"), ranges.column("hi"), pa.array(out)], names=["lo", "hi", "v"])


def range_minima(values: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lo, hi, v): the least value of each distinct range of places; values (pos, v) have all places from 0.

    A range beyond its block is the end of one block, whole blocks, whose minima are ranges one level up, and the
    begin of another.
    """
    values = values.withColumn("blk", _block("pos", block))
    ranges = written(ranges.select("lo", "hi").distinct().withColumns({"b": _block("lo", block), "e": _block("hi", block)}))
    ends = F.when(F.col("b") == F.col("e"), F.array(F.struct(F.col("b").alias("blk"), "lo", "hi"))).otherwise(
        F.array(F.struct(F.col("b").alias("blk"), "lo", F.expr(f"(b + 1) * {block}L - 1").alias("hi")), F.struct(F.col("e").alias("blk"), F.expr(f"e * {block}L").alias("lo"), "hi"))
    )
    pieces = ranges.select("lo", "hi", F.explode(ends).alias("p"))
    asked = pieces.select("p.*").distinct()
    least = values.groupBy("blk").cogroup(asked.groupBy("blk")).applyInArrow(_least, "lo long, hi long, v long")
    parts = pieces.join(least.select(F.struct("lo", "hi").alias("at"), "v"), F.struct("p.lo", "p.hi") == F.col("at")).select("lo", "hi", "v")
    wide = ranges.filter("e > b + 1")
    if not wide.isEmpty():
        minima = written(values.groupBy(F.col("blk").alias("pos")).agg(F.min("v").alias("v")))
        inner = wide.select("lo", "hi", F.expr("b + 1").alias("x"), F.expr("e - 1").alias("y"))
        up = range_minima(minima, inner.select(F.col("x").alias("lo"), F.col("y").alias("hi")), block)
        parts = parts.unionByName(inner.join(up.select(F.col("lo").alias("x"), F.col("hi").alias("y"), "v"), ["x", "y"]).select("lo", "hi", "v"))
    return parts.groupBy("lo", "hi").agg(F.min("v").alias("v"))


# ---------------------------------------------------------------- conversations


def steps(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, sym, chars, cum) of turns (conv_id, turn, role, text), in order of turn, null first.

    sym is 128 bits of SHA-256 of role and text, null ones empty; chars the text's code points, cum their sum up to this
    turn. Turns of one number are in order of role and sym; repeated rows are turns each. Rows without conv_id belong to
    no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sym = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, TURN)
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), sym.alias("sym"), F.length(text).cast("long").alias("chars"))
    placed = numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sym")], ("chars",))
    first = placed.groupBy("conv_id").agg(F.min("rank").alias("r0"), F.min(F.col("total_chars") - F.col("chars")).alias("c0"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("r0") + 1).alias("pos"), "sym", "chars", (F.col("total_chars") - F.col("c0")).alias("cum"))


def rebuilt(own: DataFrame, base: Column, share: Column) -> tuple[DataFrame, DataFrame]:
    """Steps of all conversations with their first turns taken from others, and (conv_id, m), the turns of each.

    base and share, over conv_id: whose first turns, and how many (HEAD at most; all if there are fewer).
    """
    heads = written(own.filter(F.col("pos") <= HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sym", "chars", "cum"))).alias("head")))
    plan = own.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"base": base, "h": share})
    plan = plan.join(heads.withColumnRenamed("head", "own"), "conv_id").join(heads.select(F.col("conv_id").alias("base"), "head"), "base", "left")
    plan = plan.withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)"))
    last = lambda a: F.coalesce(F.try_element_at(F.col(a), F.greatest(F.size(a), F.lit(1)))["cum"], F.lit(0).cast("long"))
    plan = plan.withColumn("own", F.slice("own", F.lit(1), F.col("h"))).withColumns({"take": F.size("head"), "after": last("head"), "cut": last("own")})
    plan = written(plan.select("conv_id", "n", "h", "take", "head", "after", "cut"))
    rest = own.join(plan.select("conv_id", "h", "take", "after", "cut"), "conv_id").filter("pos > h")
    rest = rest.select("conv_id", F.expr("pos - h + take").alias("pos"), "sym", "chars", F.expr("cum - cut + after").alias("cum"))
    taken = plan.select("conv_id", F.explode("head").alias("s")).select("conv_id", "s.*")
    return written(rest.unionByName(taken)), plan.select("conv_id", F.expr("take + greatest(n - h, 0)").alias("m"))


# ---------------------------------------------------------------- sorted conversations and their common prefixes


def _common(width: int):
    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            n = min(len(x), len(y))
            if x[:n] == y[:n]:
                out.append(n // width)
            else:
                out.append(next(i for i in range(0, n, width) if x[i : i + width] != y[i : i + width]) // width)
        return pd.Series(out, dtype="int64")

    return run


def sorted_prefixes(walk: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, m, rank, lcp): conversations (conv_id, m) in order of their steps, and the turns each shares with the one before; -1 for the first.

    Turns of a chunk are laid end to end as its key. While a conversation has several chunks, the distinct keys are
    numbered in their order and these names take the turns' place; a common prefix is then found from the top down. Whole
    chunks count as full there, also the last of two equal conversations, hence the bound by m.
    """
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]), "").alias("key")
    at = F.expr(f"(pos - 1) div {chunk}L").alias("pos")
    keys = written(walk.groupBy("conv_id", at).agg(key).unionByName(convs.filter("m = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("key"))))
    names: list[DataFrame] = []
    while (keys.agg(F.max("pos")).first()[0] or 0) > 0:
        ranks = numbered(keys.select("key").distinct(), [F.col("key")])
        names.append(written(ranks.select("key", F.lpad(F.lower(F.hex("rank")), NAME, "0").alias("name"))))
        named = keys.join(names[-1], "key").select("conv_id", F.expr("pos + 1").alias("pos"), F.col("name").alias("sym"))
        keys = written(named.groupBy("conv_id", at).agg(key))
    placed = written(numbered(keys.select("conv_id", "key"), [F.col("key"), F.col("conv_id")]))
    both = placed.join(placed.select((F.col("rank") + 1).alias("rank"), F.col("key").alias("prev")), "rank").select("rank", "key", "prev")
    lcp = None
    for level in range(len(names), -1, -1):
        width = NAME if level else TURN
        both = both.withColumn("q", _common(width)("key", "prev"))
        both = written(both.withColumn("lcp", F.col("q") * (chunk**level) + (F.col("sofar") if "sofar" in both.columns else F.lit(0))))
        if not level:
            lcp = both.select("rank", "lcp") if lcp is None else lcp.unionByName(both.select("rank", "lcp"))
            break
        part = lambda c: F.substring(F.col(c), (F.col("q") * NAME + 1).cast("int"), F.lit(NAME))  # noqa: B023, E731
        both = both.withColumns({"x": part("key"), "y": part("prev")})
        ended = both.filter("x = '' or y = ''").select("rank", "lcp")
        lcp = ended if lcp is None else lcp.unionByName(ended)
        below = names[level - 1]
        both = both.filter("x <> '' and y <> ''").select("rank", F.col("lcp").alias("sofar"), "x", "y")
        both = both.join(below.select(F.col("name").alias("x"), "key"), "x").join(below.select(F.col("name").alias("y"), F.col("key").alias("prev")), "y").select("rank", "key", "prev", "sofar")
    return written(placed.drop("key").join(convs, "conv_id").join(lcp, "rank", "left").withColumn("lcp", F.coalesce(F.when(F.col("lcp").isNotNull(), F.least("lcp", "m")), F.lit(-1).cast("long"))))


# ---------------------------------------------------------------- the trie


def _digests(ends: DataFrame) -> DataFrame:
    """(lo, depth, n_ends, ends_sha256) of (lo, depth, conv_id): a hash runs over a node's ids as they come, sorted, so none is held as a whole."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        open_, n, h = None, 0, None
        names = ["lo", "depth", "n_ends", "ends_sha256"]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.string() if i == 3 else pa.int64()) for i in range(4)], names=names)
        for batch in batches:
            done = []
            for lo, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("lo", "depth", "conv_id")), strict=True):
                if (lo, depth) != open_:
                    if open_:
                        done.append((*open_, n, h.hexdigest()))
                    open_, n, h = (lo, depth), 0, hashlib.sha256()
                h.update(f"{',' if n else ''}{conv}".encode())
                n += 1
            yield table(done)
        if open_:
            yield table([(*open_, n, h.hexdigest())])

    rows = ends.select("lo", "depth", "conv_id").repartition("lo", "depth").sortWithinPartitions("lo", "depth", "conv_id")
    return rows.mapInArrow(run, "lo long, depth long, n_ends long, ends_sha256 string")


def prefix_trie(walk: DataFrame, convs: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """All nodes of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    walk: (conv_id, pos from 1, sym, chars, cum), see `steps`; convs: (conv_id, m), every conversation and its turns.
    Conversations are sorted and get the common prefix with their neighbour (the LCP array). For each place the nearest
    smaller values on both sides, found in blocks and by the blocks' minima, bound an interval of the Cartesian tree; equal
    intervals are merged. A node between an interval and its parent, or below all intervals, is a turn of the interval's
    first conversation, so missing depths are that conversation's rows. What a node sums over its subtree is a difference
    of running sums at the ends of its interval, and its least id a minimum over it.

    Conversations without turns are members of the root; one with very many turns is named in chunks, and its rows are
    dealt by place. Equal conversations end at one node, whose ids are hashed one after the other as they are read, which
    one task does for one node. An empty table gives no node.
    """
    ensure_checkpoint_dir(walk.sparkSession)
    placed = sorted_prefixes(walk, convs, chunk)
    lcps = placed.select(F.col("rank").alias("pos"), F.col("lcp").alias("v"))
    inner = lcps.filter("pos > 0")
    left = nearest_smaller(lcps, inner, 1, block).select("pos", F.col("at").alias("lo"), F.col("below").alias("dl"))
    right = nearest_smaller(lcps, inner, -1, block).select("pos", "v", F.col("at").alias("end"), F.coalesce("below", F.lit(-1).cast("long")).alias("dr"))
    n = placed.count()
    cells = left.join(right, "pos").select("pos", "lo", (F.coalesce("end", F.lit(n).cast("long")) - 1).alias("hi"), F.col("v").alias("depth"), F.greatest("dl", "dr").alias("above"), F.expr("if(dl >= dr, lo, end)").alias("up"))
    cells = written(cells)

    # running sums over the sorted conversations
    shared = written(walk.join(placed.select("conv_id", "rank", "lcp"), "conv_id").filter("pos >= lcp").select("conv_id", "rank", "pos", "chars", "cum", "lcp"))
    same = shared.filter("pos = lcp").select("rank", F.col("cum").alias("same"))
    next_ = placed.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("next"))
    lines = placed.join(same, "rank", "left").join(next_, "rank", "left").select("rank", "conv_id", "m", "lcp", F.coalesce("next", F.lit(-1).cast("long")).alias("next"), F.coalesce("same", F.lit(0).cast("long")).alias("same"))
    lines = lines.withColumn("leaf", F.expr("if(next < m, 1L, 0L)")).withColumnRenamed("rank", "r")
    sums = written(numbered(lines, [F.col("r")], ("same", "leaf")).drop("rank").withColumnRenamed("r", "rank"))

    # intervals
    merged = cells.groupBy("lo", "hi", "depth", "above", "up").agg(F.count("*").alias("marks"))
    least = range_minima(placed.select(F.col("rank").alias("pos"), F.col("conv_id").alias("v")), cells.select("lo", "hi"), block)
    at_lo = sums.select(F.col("rank").alias("lo"), F.col("total_same").alias("s0"), (F.col("total_leaf") - F.col("leaf")).alias("l0"))
    at_hi = sums.select(F.col("rank").alias("hi"), F.col("total_same").alias("s1"), F.col("total_leaf").alias("l1"))
    merged = written(merged.join(least.withColumnRenamed("v", "conv_id"), ["lo", "hi"]).join(at_lo, "lo").join(at_hi, "hi"))
    owner = written(cells.select("pos", "lo", "hi", "depth").join(merged.select("lo", "hi", "depth", F.col("conv_id").alias("owner")), ["lo", "hi", "depth"]).select(F.col("pos").alias("up"), "owner"))
    merged = merged.join(owner, "up", "left")
    spans = merged.withColumn("bucket", F.explode(F.expr(f"sequence((above + 1) div {chunk}L, depth div {chunk}L)"))).withColumnRenamed("conv_id", "least").withColumnRenamed("depth", "bottom")

    # nodes: what a conversation adds to the one before it, and the root
    root = placed.filter("rank = 0").select("conv_id", F.col("rank").alias("lo"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"))
    nodes = shared.filter("pos > lcp").select("conv_id", F.col("rank").alias("lo"), F.col("pos").alias("depth"), (F.col("cum") - F.col("chars")).alias("before")).unionByName(root)
    nodes = nodes.withColumn("bucket", F.expr(f"depth div {chunk}L"))
    a, b = nodes.alias("a"), spans.alias("b")
    joined = a.join(b, (F.col("a.lo") == F.col("b.lo")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.depth") > F.col("b.above")) & (F.col("a.depth") <= F.col("b.bottom")), "left")
    joined = written(joined.select("a.conv_id", "a.lo", "a.depth", "a.before", "b.hi", "b.bottom", "b.above", "b.marks", "b.least", "b.owner", F.expr("l1 - l0").alias("leaves"), F.expr("s1 - s0").alias("same")))

    # where conversations end: at the node of the equal one before, or at one of their own
    starts = cells.select(F.col("pos").alias("rank"), "lo")
    ends = placed.join(starts, "rank", "left").select(F.expr("if(lcp = m, lo, rank)").alias("lo"), F.col("m").alias("depth"), "conv_id")
    digests = _digests(ends)

    many = joined.filter("hi is not null").join(digests, ["lo", "depth"], "left").select(
        F.col("least").alias("conv_id"), "depth", F.expr("if(depth = 0, null, if(depth = above + 1, owner, least))").alias("parent_conv_id"), F.expr("hi - lo + 1").alias("n_convs"),
        F.expr("if(depth = bottom, marks, 0L) + 1 - coalesce(n_ends, 0L)").alias("n_children"), F.col("leaves").alias("n_leaves"), F.expr("same - (hi - lo) * before").alias("saved_tokens"), "ends_sha256",
    )
    one = joined.filter("hi is null").join(sums.select(F.col("rank").alias("lo"), "lcp", "next"), "lo").withColumn("up", F.expr("if(lcp >= next, lo, lo + 1)"))
    one = one.drop("owner").join(owner, "up", "left").join(digests, ["lo", "depth"], "left").select(
        "conv_id", "depth", F.expr("if(depth = 0, null, if(depth = greatest(lcp, next) + 1, owner, conv_id))").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.expr("1 - coalesce(n_ends, 0L)").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256",
    )
    return many.unionByName(one).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    own = written(steps(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie(*rebuilt(own, F.col("conv_id") - F.col("conv_id") % 100, share.cast("int")))


#: Bytes of the id go through the checksum bit by bit; a node is known by the names of its turns, laid end to end.
OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), b AS (
  SELECT conv_id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda crc, d: list_reduce(list_concat([xor(crc, d)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))) AS crc
  FROM (SELECT DISTINCT conv_id FROM t)
), c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, CAST(4294967295 AS BIGINT)) % 6 AS h FROM b),
k AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(k.n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN k ON k.conv_id = c.base
), p AS (
  SELECT conv_id, pos AS depth, length(text) AS chars, string_agg(sha256(concat(octet_length(encode(role)), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), m AS (SELECT conv_id, max(depth) AS m FROM p GROUP BY 1),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY 1, 2),
f AS (SELECT substr(path, 1, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM p JOIN m ON m.conv_id = p.conv_id AND m.m = p.depth GROUP BY 1),
s AS (
  SELECT n.path, count(*) FILTER (f.path IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.chars) AS saved FROM n JOIN n d ON d.depth >= n.depth AND substr(d.path, 1, length(n.path)) = n.path LEFT JOIN f ON f.path = d.path GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(f.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN f ON f.path = n.path LEFT JOIN e ON e.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = substr(n.path, 1, length(n.path) - 64)
"""
