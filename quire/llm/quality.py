"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

Each class is a normal distribution of the statistics. Its covariance is shrunk
towards the diagonal of the pooled variances, factorised once (Cholesky), and
the factor is shipped to the tasks. The score is the logistic of the difference
of the two log densities (Mahalanobis distance and log determinant) plus the
log prior odds, divided by the number of statistics, which keeps the order and
the threshold of 0.5 and avoids scores that saturate.

Statistics come from the text alone. Labels are joined to the statistics, never
to the texts, and each class is summed up per task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, grouped_batches, utf8, word_hashes, words

NAMES = ("words", "word_length", "distinct", "distinct_pairs", "adjacent", "upper", "digit", "bar", "mark", "symbol", "exclaim", "foreign", "line_words", "line_repeat", "sentence", "long_word")
_CLASS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "bar": b"|",
    "mark": b".,;:?'\"-()",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "exclaim": b"!",
}


def _rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.sqrt(part / np.maximum(whole, 1))


def statistics(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document; an empty text has zeros."""
    d = len(start)
    if not d:
        return np.zeros((0, len(NAMES)))
    low, s, n, doc = words(raw, start, length)
    h = word_hashes(low, s, n)
    count = np.bincount(doc, minlength=d)
    upto = np.append(0, np.cumsum(count))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[start + length] - total[start]

    table = {}
    for k, chars in _CLASS.items():
        member = np.zeros(256, np.uint8)
        member[list(chars)] = 1
        table[k] = per_doc(member[raw])
    foreign = per_doc(raw >= 0xC0)  # first bytes of characters beyond ASCII
    letters = table["upper"] + table["lower"] + foreign
    chars = per_doc((raw & 0xC0) != 0x80)

    def distinct(key: np.ndarray, own: np.ndarray) -> np.ndarray:
        mixed = key ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        o = np.argsort(mixed)
        k = mixed[o]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        return np.bincount(own[o[new]], minlength=d)

    together = doc[1:] == doc[:-1]
    pair = (h[1:] * np.uint64(31) + h[:-1])[together]
    own = doc[1:][together]
    pairs = np.bincount(own, minlength=d)
    adjacent = np.bincount(own, (h[1:] == h[:-1])[together], d)
    # lines, told apart by the sum of their words' hashes in order
    line_end = np.cumsum(raw == 10)
    line = line_end[s] if len(s) else np.zeros(0, np.int64)
    begins = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | ~together]) if len(s) else np.zeros(0, np.int64)
    place = np.arange(len(s)) - np.repeat(begins, np.diff(np.r_[begins, len(s)])) if len(s) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(h * (place * 2 + 1).astype(np.uint64), begins) if len(begins) else np.zeros(0, np.uint64)
    lines = np.bincount(doc[begins], minlength=d)
    line_kinds = distinct(line_hash, doc[begins])
    sentences = np.bincount(doc, np.isin(low[s + n - 1], list(b".!?")), d) if len(s) else np.zeros(d)
    word_chars = np.bincount(doc, n, d)
    cols = [
        np.log1p(count),
        np.log1p(word_chars / np.maximum(count, 1)),
        _rate(distinct(h, doc), count) * np.log1p(count) ** 0.5,
        _rate(distinct(pair, own), pairs),
        _rate(adjacent, pairs),
        _rate(table["upper"], letters),
        _rate(table["digit"], chars),
        _rate(table["bar"], chars),
        _rate(table["mark"], chars),
        _rate(table["symbol"], chars),
        _rate(table["exclaim"], chars),
        _rate(foreign, letters),
        np.log1p(count / np.maximum(lines, 1)),
        _rate(lines - line_kinds, lines),
        np.log1p(count / (sentences + 1)),
        _rate(np.bincount(doc, n > 24, d), count),
    ]
    assert upto[-1] == len(s)
    return np.stack(cols, 1)


@dataclass
class Discriminant:
    """Per class (0, 1): log prior less half the log determinant, mean, inverse of the Cholesky factor."""

    const: list[float]
    mean: list[np.ndarray]
    whiten: list[np.ndarray]

    @staticmethod
    def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, floor: float) -> Discriminant | float:
        """sums: class -> (rows, sum, sum of outer products). With one class only, its label; with none, 0.5."""
        sums = {k: v for k, v in sums.items() if v[0] > 0}
        if len(sums) < 2:
            return float(next(iter(sums))) if sums else 0.5
        total = sum(v[0] for v in sums.values())
        mean = {k: v[1] / v[0] for k, v in sums.items()}
        cov = {k: v[2] / v[0] - np.outer(mean[k], mean[k]) for k, v in sums.items()}
        pooled = sum(cov[k] * sums[k][0] for k in sums) / total
        target = np.diag(np.maximum(np.diag(pooled), floor))
        const, whiten = [], []
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - shrink) * cov[k] + shrink * target)
            const.append(float(np.log(sums[k][0] / total) - np.log(np.diag(factor)).sum()))
            whiten.append(np.linalg.inv(factor))
        return Discriminant(const, [mean[0], mean[1]], whiten)

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for c, m, w in zip(self.const, self.mean, self.whiten, strict=True)]
        z = (density[1] - density[0]) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _sums(batches):
    d = len(NAMES)
    total = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False)
        x = np.asarray(b.column(1).flatten()).reshape(-1, d)
        for k, t in total.items():
            own = x[y == k]
            t[0] += len(own)
            t[1] += own.sum(0)
            t[2] += own.T @ own
    rows = [(k, float(t[0]), t[1].tolist(), t[2].reshape(-1).tolist()) for k, t in total.items() if t[0]]
    if rows:
        label, n, x, xx = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(n), pa.array(x), pa.array(xx)], names=["label", "n", "x", "xx"])


def _added(key, group):
    add = lambda c: np.sum(np.array(group.column(c).to_pylist()), 0).tolist()
    return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "n": [float(add("n"))], "x": [add("x")], "xx": [add("xx")]})


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, scratch: Scratch, id_: str = "doc_id", text: str = "text", label: str = "quality", shrink: float = 0.05, floor: float = 1e-4) -> DataFrame:
    """(doc_id, row, score, predicted) for each document; row is the 64-bit hash of the row's text (null as empty), on which the score alone depends.

    train says, by the id, which labelled rows teach. Labels other than 0 and 1
    and ids that are null or have no document teach nothing; a row of labels that
    occurs twice counts twice. A null text is empty; it has a score as any other.
    With one class only, its label is the score; without labels, 0.5. Other
    columns are ignored. Repeated rows get a score each.
    """
    d = len(NAMES)

    def measure(batches):
        for t in grouped_batches(batches, "text", 4 << 20):
            x = statistics(*utf8(t.column("text")))
            flat = pa.array(x.reshape(-1))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("row").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32)), flat)], names=["doc_id", "row", "x"])

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), text_key(F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    seen = scratch.write(rows.mapInArrow(measure, "doc_id long, row long, x array<double>"), "statistics")
    known = labels.select(F.col(id_).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(train)
    sums = seen.join(known, "doc_id").select("label", "x").mapInArrow(_sums, "label int, n double, x array<double>, xx array<double>")
    sums = sums.groupBy("label").applyInArrow(_added, "label int, n double, x array<double>, xx array<double>").collect()
    model = Discriminant.fit({r["label"]: (r["n"], np.array(r["x"]), np.array(r["xx"]).reshape(d, d)) for r in sums}, shrink, floor)

    def score(batches):
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, d)
            p = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "row", "score", "predicted"])

    return seen.mapInArrow(score, "doc_id long, row long, score double, predicted int")


def not_fold(mod: int = 3, rest: int = 1, id_: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_).cast("string").cast("binary")), F.lit(mod)) != rest, F.lit(True))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels, not_fold(), Scratch(spark, "quality"))
    return out.select("doc_id", (~not_fold()).alias("held_out"), "score", "predicted")
