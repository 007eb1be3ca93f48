from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import quality as Q
from quire.llm.common import Scratch, utf8


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioutnsrl") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    good = lambda: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 14))).capitalize() for _ in range(12))
    junk = [lambda: "BUY NOW!! " * 60, lambda: " | ".join(rng.choice(vocabulary) for _ in range(150)), lambda: " ".join(rng.choice(vocabulary) + "###" for _ in range(120))]
    return [(i, good() if i % 4 else rng.choice(junk)(), int(i % 4 > 0)) for i in range(400)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, ""), (1001, None), (None, "text without id"), (1, rows[1][1]), (1002, "wort " * 50000)], "doc_id long, text string").withColumn("label", F.lit("clash")).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 0), (3, None), (2, 7)], "doc_id long, quality int")
    out = Q.quality_scores(docs, labels, F.col("doc_id") % 3 != 1, Scratch(spark, "t")).collect()
    assert len(out) == 405 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.doc_id is not None and r.doc_id % 3 == 1 and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_one_class_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.score for r in Q.quality_scores(docs, labels, F.lit(True), Scratch(spark, "t")).collect()] == [1.0, 1.0]
    assert [r.score for r in Q.quality_scores(docs, labels.limit(0), F.lit(True), Scratch(spark, "t")).collect()] == [0.5, 0.5]
    assert Q.quality_scores(docs.limit(0), labels, F.lit(True), Scratch(spark, "t")).count() == 0


def test_log_densities_are_those_of_the_formula():
    rng = np.random.default_rng(0)
    d = len(Q.NAMES)
    data = {k: rng.normal(k, 1 + k, (500, d)) for k in (0, 1)}
    m = Q.Discriminant.fit({k: (float(len(x)), x.sum(0), x.T @ x) for k, x in data.items()}, 0.1, 1e-4)
    pooled = sum(np.cov(x.T, bias=True) * len(x) for x in data.values()) / 1000
    x, want = rng.normal(0, 1, (20, d)), []
    for k, y in data.items():
        c = 0.9 * np.cov(y.T, bias=True) + 0.1 * np.diag(np.diag(pooled))
        diff = x - y.mean(0)
        want.append(np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-(want[1] - want[0]) / d)))


def brute(text):
    low = text.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))
    split = lambda x: [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
    ws, raw = split(low), text.encode()
    lines = [tuple(x) for x in (split(line) for line in low.split("\n")) if x]
    n, pairs = len(ws), list(zip(ws, ws[1:], strict=False))
    count = lambda chars: sum(b in chars for b in raw)
    foreign = sum(b >= 0xC0 for b in raw)
    letters, chars = count(range(65, 91)) + count(range(97, 123)) + foreign, len(text)
    rate = lambda a, b: math.sqrt(a / max(b, 1))
    return [
        math.log1p(n),
        math.log1p(sum(map(len, ws)) / max(n, 1)),
        rate(len(set(ws)), n) * math.log1p(n) ** 0.5,
        rate(len(set(pairs)), len(pairs)),
        rate(sum(a == b for a, b in pairs), len(pairs)),
        rate(count(range(65, 91)), letters),
        rate(count(range(48, 58)), chars),
        rate(count(b"|"), chars),
        rate(count(b".,;:?'\"-()"), chars),
        rate(count(b"#$%&*+/<=>@[\\]^_`{}~"), chars),
        rate(count(b"!"), chars),
        rate(foreign, letters),
        math.log1p(n / max(len(lines), 1)),
        rate(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / (sum(w[-1:] in b".!?" for w in ws) + 1)),
        rate(sum(len(w) > 24 for w in ws), n),
    ]


def test_statistics_are_those_of_brute_force():
    rng = random.Random(8)
    alphabet = ["a", "B", "word", "Word", "é", "ß", "漢字", "7", "!", "|", "x.", "#", " ", "  ", "\n", "\n", "\t", "the the", "q" * 30, "end?\nend?\n"]
    texts = ["", " \n ", "a", "\n", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    got = Q.statistics(*utf8(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute(t)), t
