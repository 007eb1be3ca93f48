from __future__ import annotations

import numpy as np
import pytest

from quire.llm import embedding_dedup as E


def data():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 40, 150)] + rng.normal(size=(150, 16)) * rng.uniform(0, 0.25, (150, 1))
    hot = base[0] + rng.normal(size=(200, 16)) * 0.02
    return np.concatenate([base, near, hot, base[:5]])


def brute(x, t):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    link = (u @ u.T >= t) & ~np.eye(len(x), dtype=bool)
    return link.sum(1), E._joined(np.arange(len(x)), *np.nonzero(link))


@pytest.mark.parametrize(("tile", "group"), [(8192, 512), (32, 512), (32, 3)])
def test_links_and_components(spark, monkeypatch, tile, group):
    monkeypatch.setattr(E, "GROUP", group)
    x = data()
    count, label = brute(x, 0.9)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] + [0.0] * 15)]
    odd += [(1008, [1e200, -3e200, 5e199]), (1009, [1e-200, -3e-200, 5e-201])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "'l' as label").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(v, tile=tile, pivots=8).collect()}
    want = {i: (int(count[i]), int(label[i]), int(label[i]) == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i, _ in odd} | {1005: (1, 1005, True), 1006: (1, 1005, False), 1008: (1, 1008, True), 1009: (1, 1008, False)}
    assert got == want


def test_bound_holds_for_every_pair():
    x = data()
    u = x / np.sqrt((x * x).sum(1))[:, None]
    q, s, e = E.quantised(u)
    off = np.abs(u @ u.T - E.product(q, q) * s[:, None] * s[None])
    assert (off <= e[:, None] + (1 + e[:, None]) * e[None]).all()


def test_repeated_ids_null_ids_and_no_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in E.near_duplicates(v).collect())
    assert got == [(0, 2, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert E.near_duplicates(v.limit(0)).count() == 0
