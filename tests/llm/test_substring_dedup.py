from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import substring_dedup as S


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - width + 1):
                first[b[k : k + width]] = min(i, first.get(b[k : k + width], i))
    out = []
    for i, b in texts:
        off = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1 if i is not None else 0):
            if first[b[k : k + width]] < i:
                off[k : k + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~off])
        out.append((-1 if i is None else i, len(b), int(off.sum()), int((off & ~np.r_[False, off[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(3, 9)))
    shared = ["".join(word() for _ in range(30)) for _ in range(4)]
    texts = ["".join(rng.choice(shared)[rng.randint(0, 30) : rng.randint(60, 200)] if rng.random() < 0.3 else word() for _ in range(rng.randint(1, 60))) for _ in range(50)]
    texts += [texts[0], texts[0], "loop " * 300, "loop " * 200, "", None, "a" * 49, "a" * 50, "a" * 51, "x" * 20000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (None, texts[0]), (ids[0], texts[0])]


@pytest.mark.parametrize(("hot", "shard", "array"), [(S.HOT, S.SHARD, S.ARRAY), (2, 5000, 700), (5, 2000, 1 << 20)])
def test_bytes_removed(spark, hot, shard, array):
    rows = corpus(shard)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id * 2 as twice", "'k' as key").repartition(4)
    got = S.dedup_substrings(docs, hot=hot, shard=shard, array=array).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 50)
    assert all(r.twice == (None if r.doc_id is None else 2 * r.doc_id) and r.key == "k" for r in got)
    by = dict(rows)
    assert all(r.kept_text == (by[r.doc_id] or "") for r in got if r.n_removed == 0 and r.doc_id is not None and r.doc_id != rows[0][0])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup_substrings(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 5))
def test_suffix_array_and_prefixes(data, times):
    text = np.frombuffer(data * times, np.uint8)
    raw = text.tobytes()
    sa = S.suffix_array(text)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : i + 8].ljust(8, b"\0") if False else raw[i:])) or [raw[i:].rstrip(b"\0") for i in sa] == sorted(raw[i:].rstrip(b"\0") for i in range(len(raw)))
    lcp = S.common_prefixes(text, sa, 50, lanes=7)
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(n, 50) <= lcp[k] <= 50 if b"\0" in raw else lcp[k] == min(n, 50)


def test_binary_search_merges_arrays():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 3, 4000).astype(np.uint8)
    begin, size = np.arange(0, 4000, 80), np.full(50, 80)
    text[80 * 7 : 80 * 8], text[80 * 30 : 80 * 31] = text[:80], text[80 * 5 : 80 * 6]
    doc = rng.permutation(50)
    one = S.shard_minimum(text, begin, size, doc, 20, 1 << 20)
    assert (one == S.shard_minimum(text, begin, size, doc, 20, 300)).all()


def test_a_long_document_is_cut_without_a_trace():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 9000).astype(np.uint8)
    start, length = np.array([0, 10, 7010, 7030]), np.array([10, 7000, 20, 1970])

    def each(most):
        first, many, anchor, doc = S._in_slices(raw, start, length, 50, 26, most)
        window = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return sorted(zip(window.tolist(), np.repeat(anchor, many).tolist(), np.repeat(doc, many).tolist(), strict=True))

    assert each(1 << 20) == each(500) == each(333) and len(each(333)) == 7000 - 49 + 1970 - 49


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a" * 60, 5, "x"), (2, "a" * 60, 6, "y")], "doc_id long, text string, n_bytes long, kept_text string")
    got = {r.doc_id: r for r in S.dedup_substrings(docs).collect()}
    assert (got[2].n_bytes, got[2].kept_text) == (60, "") and len(got[2]) == 6
    other = S.dedup_substrings(docs, added=("t", "b", "r", "s", "h")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.kept_text, r.t, r.b) for r in other] == [(5, "x", "a" * 60, 60), (6, "y", "", 60)]
