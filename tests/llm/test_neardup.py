"""Near duplicates among vectors against brute force: dense clusters, copies, odd rows, small leaves."""

import math

import numpy as np
import pytest

from rasterloom.llm import neardup

from fixtures import components

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, threshold=0.95):
    units = []
    for _, v, *_ in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        units.append(None if x is None else x / abs(x).max() / np.linalg.norm(x / abs(x).max()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and math.fsum(units[i] * units[j]) >= threshold]
    comp = components(links, range(len(rows)))
    least, n = {}, [0] * len(rows)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return sorted(repr((r[0], n[i], least.get(comp[i]), r[0] == least.get(comp[i]))) for i, r in enumerate(rows))


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(150)]
    for k in range(40):  # chains of near copies round 40 centres
        centre = rng.standard_normal(16)
        rows += [(1000 + 10 * k + j, (centre + 0.15 * rng.standard_normal(16)).tolist(), k) for j in range(4)]
    dense = rng.standard_normal(16)  # a cluster that no cut parts
    rows += [(3000 + j, (dense + 0.02 * rng.standard_normal(16)).tolist(), 9) for j in range(120)]
    copy = rng.standard_normal(16).tolist()
    rows += [(5000 + j, copy, 1) for j in range(60)] + [(5100, [3 * x for x in copy], 1)]
    return rows


@pytest.mark.parametrize("leaf", [1024, 24])
def test_against_brute_force(spark, leaf):
    rows = vectors(4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=leaf).collect()
    want = brute_force(rows)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.1], 0), (9, [1.0, 0.0, 0.0], 0), (7, [1.0, 0.0], 1), (None, [1.0, 0.01], 0), (None, [0.0, -1.0], 0), (10, [1e200, 1e190], 0), (11, [-0.0, 5.0], 0), (12, [0.0, 5.0], 0)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [r.replace("None, False", "None, True") for r in brute_force(rows)]
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall(spark, sf_dir):
    """Pairs right at the threshold in 64 dimensions, small leaves: at least 0.99 of the links are found, and no other."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((600, 64))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.952 * base + math.sqrt(1 - 0.952**2) * off
    rows = [(2 * i, base[i].tolist(), 0) for i in range(600)] + [(2 * i + 1, near[i].tolist(), 0) for i in range(600)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=64).collect()
    assert {r.n_links for r in got} <= {0, 1}
    assert sum(r.n_links for r in got) >= 0.99 * 1200
