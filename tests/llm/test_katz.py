from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import katz as K

ROWS = [(1, "The cat sat on the mat"), (2, "the cat  ate the rat"), (3, ""), (4, None), (5, "A dog sat on a mat\tÉté"), (6, "the cat sat on the mat"), (7, "the rat sat"), (None, "the cat"), (8, "unseen words here"), (2, "the cat  ate the rat"), (9, "x " * 4000 + "end")]


def split(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    return [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if w] + [None] for _, t in rows]


def level(counts, after, d, lower):
    """P(w | h) of one level, from the counts of (h, w), the followers of h and the lower level."""
    full = lambda c: d[c - 1] if c <= len(d) else 1.0

    def p(h, w):
        total = sum(counts[h, x] for x in after[h])
        if not total:
            return lower(h, w)
        kept = sum(full(counts[h, x]) * counts[h, x] for x in after[h])
        den = total + (1 if total - kept <= 1e-12 else 0)
        if counts[h, w]:
            return full(counts[h, w]) * counts[h, w] / den
        return (1 - kept / den) / (1 - sum(lower(h, x) for x in after[h])) * lower(h, w)

    return p


def model(rows, held, k, order):
    tokens = split(rows)
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    after, after2 = collections.defaultdict(set), collections.defaultdict(set)
    for (i, _), ws in zip(rows, tokens, strict=True):
        if not held(i):
            for l, h, w in zip([None, "<s>", *ws], ["<s>", *ws], ws, strict=False):
                uni[w] += 1
                bi[h, w] += 1
                after[h].add(w)
                if h != "<s>":
                    tri[(l, h), w] += 1
                    after2[l, h].add(w)
    n, v = sum(uni.values()), len(uni)
    kinds = lambda c: [float(sum(x == r for x in c.values())) for r in range(1, k + 2)]
    low_ = K.Lower.of(kinds(uni), n, v, k)
    p1 = lambda h, w: float(low_.p(np.array([uni[w]]))[0])
    p2 = level(bi, after, K.discounts(kinds(bi), k), p1)
    p3 = level(tri, after2, K.discounts(kinds(tri), k), lambda h, w: p2(h[1], w))
    return tokens, uni, n, v, lambda l, h, w: p2(h, w) if order == 2 or h == "<s>" else p3((l, h), w)


def log10(p, ws):
    return sum(math.log10(p(l, h, w)) for l, h, w in zip([None, "<s>", *ws], ["<s>", *ws], ws, strict=False))


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize(("hot", "per_bucket"), [(1_500_000, 3_000_000), (3, 10)])
def test_scores_are_those_of_brute_force(spark, hot, per_bucket, order):
    held = lambda i: i in (7, 8)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(3)
    m = K.katz(docs, F.col("doc_id").isin(7, 8), hot=hot, bucket_tokens=per_bucket, order=order)
    tokens, uni, n, v, p = model(ROWS, held, 5, order)
    want = []
    for (i, _), ws in zip(ROWS, tokens, strict=True):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        want.append((-1 if i is None else i, held(i), len(ws), sum(uni[w] > 0 for w in ws), n, round(base, 4), round(log10(p, ws), 4)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in m.scores.collect()]
    assert sorted(got) == sorted(want)
    assert {r.word: r.c for r in m.unigrams.where("c > 0").collect()} == {w: c for w, c in uni.items() if w}


def stored(m, k):
    """P(w | l, h) from a model's tables alone; words are their numbers."""
    uni = {r.number: r.c for r in m.unigrams.collect()}
    tables = []
    for rows in (m.bigrams.collect(), m.trigrams.collect()):
        counts, weights, after = collections.Counter(), {}, collections.defaultdict(set)
        for r in rows:
            own = [c if "before" not in r else (b, c) for b, c in zip(r.before if "before" in r else r.context, r.context, strict=True)]
            at = 0
            for h, a, n in zip(own, r.backoff, r.followers, strict=True):
                weights[h] = a
                for w, c in zip(r.word[at : at + n], r.c[at : at + n], strict=True):
                    assert (h, w) not in counts
                    counts[h, w] = c
                    after[h].add(w)
                at += n
        tables.append((counts, weights, after, K.discounts([float(sum(x == r for x in counts.values())) for r in range(1, k + 2)], k)))
    ends = sum(c for (_, w), c in tables[0][0].items() if w == K.END)
    p1 = lambda w: float(m.lower.p(np.array([ends if w == K.END else uni.get(w, 0)]))[0])

    def p(i, l, h, w):
        counts, weights, after, d = tables[i]
        key = (l, h) if i else h
        lower = (lambda x: p(0, l, h, x)) if i else p1
        if key not in weights:
            return lower(w)
        full = lambda c: d[c - 1] if c <= len(d) else 1.0
        total, kept = sum(counts[key, x] for x in after[key]), sum(full(counts[key, x]) * counts[key, x] for x in after[key])
        den = total + (1 if total - kept <= 1e-12 else 0)
        if counts[key, w]:
            return full(counts[key, w]) * counts[key, w] / den
        weight = weights[key]
        if weight != weight:
            (one,) = after[key]
            weight = (1 - kept / den) / (1 - lower(one))
        return weight * lower(w)

    return p


@pytest.mark.parametrize("hot", [1_500_000, 3])
def test_stored_tables_give_the_scores(spark, hot):
    rows = [r for r in ROWS if r[0] is not None]
    m = K.katz(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id").isin(7, 8), hot=hot, bucket_tokens=20)
    number, p = {r.word: r.number for r in m.unigrams.collect()}, stored(m, 5)
    got = sorted((r.doc_id, round(r.score, 4)) for r in m.scores.collect())
    want = []
    for (i, _), ws in zip(rows, split(rows), strict=True):
        ids = [K.END if w is None else number[w] for w in ws]
        steps = zip([None, K.START, *ids], [K.START, *ids], ids, strict=False)
        want.append((i, round(sum(math.log10(p(int(h != K.START), l, h, w)) for l, h, w in steps), 4)))
    assert got == sorted(want)


def test_every_context_adds_up_to_one(spark):
    rows = [r for r in ROWS if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, uni, _, _, p = model(rows, lambda i: False, 5, 3)
    m = K.katz(docs, F.lit(False))
    assert len([a for r in m.bigrams.collect() for a in r.backoff]) == len({h for h in uni if h}) + 1  # every word, and the start
    for l, h in ((None, "<s>"), ("<s>", "the"), ("the", "cat"), ("x", "x"), ("on", "the"), ("never", "cat")):
        unknown = p(l, h, "never seen")
        assert abs(sum(p(l, h, w) for w in uni) + unknown - 1) < 1e-9


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert K.katz(empty, F.lit(False)).scores.count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert K.katz(one, F.lit(True)).scores.head().train_tokens == 0


def test_discounts_fall_back():
    assert len(K.discounts([0.0] * 6, 5)) == 0
    assert len(K.discounts([10.0, 3.0, 1.0, 0.0, 0.0, 0.0], 5)) <= 2
    d = K.discounts([1000.0, 400.0, 200.0, 120.0, 80.0, 55.0], 5)
    assert len(d) == 5 and ((d > 0) & (d < 1)).all()


def test_packed_tables_open_again():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (1, 1), (5, 40), (300, 900)):
        pairs = np.unique(rng.integers(0, 40, (n, 2)), axis=0) if n else np.zeros((0, 2), np.int64)
        pairs = pairs[rng.permutation(len(pairs))]
        own, word = (rng.integers(0, len(pairs), m), rng.integers(0, 1 << 40, m)) if n else (np.zeros(0, np.int64),) * 2
        own, word = (x[np.unique(np.c_[own, word], axis=0, return_index=True)[1]] for x in (own, word))
        c = rng.integers(1, 3, len(own))
        seen = np.bincount(own, c, len(pairs))
        weight = np.where(seen == 1, np.nan, rng.random(len(pairs)))
        before, ctx, alpha, followers, got, count = K._opened(K._table(pairs[:, 0], pairs[:, 1], weight, own, word, c))
        end = np.cumsum(followers)
        opened = {(b, x): (a, sorted(zip(got[e - f : e].tolist(), count[e - f : e].tolist()))) for b, x, a, f, e in zip(before.tolist(), ctx.tolist(), alpha.tolist(), followers.tolist(), end.tolist())}
        want = {(b, x): (w, sorted((int(word[i]), int(c[i])) for i in np.flatnonzero(own == k))) for k, (b, x, w) in enumerate(zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), weight.tolist()))}
        assert opened.keys() == want.keys()
        assert all(opened[k][1] == want[k][1] and (opened[k][0] == want[k][0] or np.isnan(want[k][0]) and np.isnan(opened[k][0])) for k in want)
