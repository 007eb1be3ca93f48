from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quire.llm import ngram_join as J


def brute(rows, n, num, den):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    low_ = {i: i for i, _ in rows if i is not None}

    def find(x):
        while low_[x] != x:
            x = low_[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                low_[max(x, y)] = min(x, y)
    return sorted((i or -1, len(s), -1 if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(300)]
    base = [[rng.choice(v) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    shared = [rng.choice(v) for _ in range(50)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 14)):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(v)
            texts.append(" ".join(t))
    texts += [" ".join([rng.choice(v) for _ in range(20)] + shared) for _ in range(20)] + ["A b c", "a B\tc", "a b", "", None, " \n ", "x " * 3000, "X " * 3000]
    rows = [(i * 3 % 401, t) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0]), rows[0], (rows[0][0], texts[-1])]


@pytest.mark.parametrize(("n", "num", "den", "most"), [(4, 85, 100, J.LIST), (5, 80, 100, 4), (1, 50, 100, 6)])
def test_components(spark, n, num, den, most):
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'z' as token").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in J.jaccard_components(docs, n, num, den, most=most).collect())
    assert got == [(-1 if i == -1 else i, s, c) for i, s, c in sorted((-1 if i is None else i, s, c) for i, s, c in _plain(rows, n, num, den))]


def _plain(rows, n, num, den):
    out = brute([(None if i is None else i + 1, t) for i, t in rows], n, num, den)
    return [(None if i == -1 else i - 1, s, -1 if c == -1 else c - 1) for i, s, c in out]


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (set(rng.integers(0, 30, rng.integers(1, 25)).tolist()) for _ in range(2))
        a, b = sorted(x), sorted(y)
        both = len(x & y)
        if both and 100 * both >= 70 * len(x | y):
            g = min(x & y)
            i, j = a.index(g), b.index(g)
            assert J.compatible(np.array(len(a)), np.array(i), np.array(len(b)), np.array(j), 70, 100)
            assert i <= len(a) - -(-70 * len(a) // 100) and j <= len(b) - -(-70 * len(b) // 100)


@pytest.mark.parametrize("kinds", [130, 12])
def test_long_lists_give_the_pairs_of_short_ones(kinds):
    rng = np.random.default_rng(2)
    k = 130
    size, pos, label = rng.integers(20, 40, k), rng.integers(0, 5, k), rng.permutation(k) % kinds
    want = {(i, j) for i in range(k) for j in range(i + 1, k) if label[i] != label[j] and J.compatible(size[i], pos[i], size[j], pos[j], 85, 100)}
    got = [(min(a, b), max(a, b)) for x, y in J.pairs_within(np.array([0]), np.array([k]), size, pos, label, 85, 100) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_alive_entries_have_a_partner():
    rng = np.random.default_rng(3)
    for k in (3, 9, 24, 25, 60):
        for _ in range(60):
            pos = np.sort(rng.integers(0, 9, k))
            size = rng.integers(10, 60, k)
            got = J.alive(np.array([0]), np.array([k]), size, pos, 85, 100)
            want = [i > 0 and any(j not in (0, i) and J.compatible(size[i], pos[i], size[j], pos[j], 85, 100) for j in range(k)) for i in range(k)]
            assert got.tolist() == want


def test_near_copies_are_not_gone_through_by_pairs():
    import time

    k = 100_000
    size, pos = np.full(k, 300), np.zeros(k, np.int64)
    began = time.perf_counter()
    assert J.alive(np.array([0]), np.array([k]), size, pos, 85, 100).sum() == k - 1
    label = np.where(np.arange(k) < 3, np.arange(k), 7)
    pairs = sum(len(a) for a, _ in J.pairs_within(np.array([0]), np.array([k]), size, pos, label, 85, 100))
    assert pairs == 3 * (k - 3) + 3 and time.perf_counter() - began < 10


def test_answers_from_answers_are_right():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y, z = (set(rng.integers(0, 40, rng.integers(5, 40)).tolist()) for _ in range(3))
        ox, oy, both = len(x & z), len(y & z), len(x & y)
        assert ox + oy - len(z) <= both <= min(ox, oy) + min(len(x) - ox, len(y) - oy)


def test_a_hot_group_of_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(2500)] + [(5000 + i, " ".join(w if rng.random() > 0.02 else "x%d" % rng.randrange(9) for w in base)) for i in range(300)] + [(9000, None), (9001, "")]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, most=100).drop("n_found").collect()))
    small = [r for r in rows if r[0] == 0 or r[0] >= 2500]
    want = {i: (s, c) for i, s, c in _plain(small, 4, 85, 100)}
    assert got == sorted((i, *want[0 if i < 2500 else i]) for i, _ in rows)


def test_no_rows(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
