"""The prefix trie against a brute-force version, with blocks and chunks so small that every level of them is used."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    """rows: (conv_id, turn, role, text), in the order that ties have."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32], text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(node), -1 if not node else members[node[:-1]][0], len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def conversations(seed, n=160, most=9):
    rng = random.Random(seed)
    texts = ["", "a", "b", "héllo", "long " * 40, None]
    rows = []
    for c in rng.sample(range(-250, 900), n):
        for turn in range(rng.choice([1, 1, 2, 3, rng.randint(1, most)])):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(texts)))
    script = [(t, "user", f"turn {t % 3}") for t in range(9)]
    for c in range(1000, 1060):
        rows += [(c, *s) for s in script[: rng.choice([6, 7, 8, 9])]]
    rows += rows[:5]
    rows.append((None, 0, "user", "of no conversation"))
    rng.shuffle(rows)
    return rows


def found(spark, rows, **kw):
    own = trie.written(trie.steps(spark.createDataFrame(rows, SCHEMA)))
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    out = trie.prefix_trie(*trie.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 100, share), **kw)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.select(cols).collect())


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"chunk": 3, "block": 4}), (3, {"chunk": 2, "block": 2})])
def test_trie(spark, seed, kw):
    rows = conversations(seed)
    assert found(spark, rows, **kw) == brute_force(rows)


def test_long_conversation_and_copies(spark):
    """One conversation of very many turns, conversations that leave it at falling depths, and a large group of copies."""
    turns = [("user", str(t)) for t in range(700)]
    rows = [(0, t, *x) for t, x in enumerate(turns)]
    for k in range(1, 12):
        rows += [(100 * k, t, *x) for t, x in enumerate(turns[: 650 - 50 * k])] + [(100 * k, 700, "user", f"~{k}")]
    rows += [(c, t, "user", "same") for c in range(2000, 2300) for t in range(7)]
    assert found(spark, rows, chunk=16, block=32) == brute_force(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    assert found(spark, [(3, None, None, None)]) == brute_force([(3, None, None, None)])


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = trie.op11_prefix_trie(spark, sf_dir)
    assert dict(out.dtypes) == {"ends_sha256": "string"} | dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint")
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())
    assert got == brute_force(rows)
