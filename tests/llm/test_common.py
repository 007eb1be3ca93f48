from __future__ import annotations

import random
from types import SimpleNamespace

import pytest

from quire.llm import common as C


def test_no_machine_local_folder_on_a_cluster():
    none = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: none))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        C.Scratch(spark, "x")


def test_the_folder_that_the_session_names(spark):
    assert C.Scratch(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("limit", [0, 2, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_is_a_join(spark, limit, how):
    rng = random.Random(1)
    keys = [rng.choice([1, 1, 1, 1, 2, 3, 4, None]) for _ in range(60)]
    big = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    small = spark.createDataFrame([(k, f"v{k}", sum(x == k for x in keys)) for k in (1, 2, 3, 9)], "k long, v string, n long")
    got = sorted((r.id, r.k or 0, r.v or "") for r in C.join_hot(big, small, "k", "n", limit, how).collect())
    known = {1: "v1", 2: "v2", 3: "v3"}
    assert got == sorted((i, k or 0, known.get(k, "")) for i, k in enumerate(keys) if how == "left" or k in known)


@pytest.mark.parametrize("limit", [3, 10**9])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "hot_limit", lambda rows: limit)
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, None), (None, 7), (8, 8)]
    low = {}

    def find(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in C.components(df, C.Scratch(spark, "cc")).collect()}
    assert got == {n: find(n) for n in low}


def test_hot_keys_are_few():
    assert C.hot_limit(10) == 1000 and 10**12 / C.hot_limit(10**12) <= 100_000
