"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, stored in partitioned tables.

The model recurses trigram -> bigram -> unigram -> uniform. A token w after the
context h, whose shorter form is h', costs

    P(w | h) = d_r * r / c(h)             r = c(h, w) > 0   (d_r = 1 above k)
             = alpha(h) * P(w | h')       else

    P(w)     = d_c * c(w) / N             c(w) > 0
             = what the discounts leave   else (all unknown words are one event)

with c(h) the sum of c(h, w) over all w. alpha(h) is (1 - sum of the first line
over the seen w) / (1 - sum of P(w | h') over the seen w), so the probabilities
after each context add up to one. Where nothing is discounted (every follower
occurs more than k times), the denominator is c(h) + 1 instead of c(h), which
leaves 1 / (c(h) + 1); a context that training never saw has alpha 1. A text's
first token has the start alone as its context.

How it runs: texts become blocks of word numbers; each distinct word of a block
goes once to its hash bucket, which counts it and returns a number; each token
then goes once, as one of the sorted triples of its block, to the bucket of the
word before it. That bucket has all that follows and precedes this word, so it
counts pairs and triples, settles the weights of both levels and scores. A word
with more than `hot` occurrences is spread over as many buckets as it needs, by
the word before; the counts of its pairs are added up over these buckets, in
parts by follower, and sent back. Words are told apart by a 64-bit hash of their
bytes. Texts are read twice, so that numbers needn't be kept on disk.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, block_number, grouped_batches, lean_memory, mixed, pack, unpack, utf8, word_hashes, words

END, START, FIRST = 0, 1, 2  # numbers of the end token, the start context and the first word
#: Scores are added up in units of 2**-28, so that no order of additions changes a result.
UNIT = float(1 << 28)


def discounts(n: list[float], k: int) -> np.ndarray:
    """d_1..d_k from n[r - 1] = number of events seen r times; fewer when Good-Turing gives none within (0, 1)."""
    for k in range(k, 0, -1):
        if len(n) > k and all(x > 0 for x in n[: k + 1]):
            r = np.arange(1, k + 1)
            c = np.array(n[: k + 1], float)
            most = (k + 1) * c[k] / c[0]
            if most != 1:
                d = ((r + 1) * c[1:] / (r * c[:-1]) - most) / (1 - most)
                if ((d > 0) & (d < 1)).all():
                    return d
    return np.zeros(0)


@dataclass
class Lower:
    """The unigram level: all that P(w) needs besides c(w)."""

    total: float
    known: float
    d: np.ndarray
    over: float

    @staticmethod
    def of(n: list[float], total: float, known: float, k: int) -> Lower:
        d = discounts(n, k)
        left = float(sum((1 - d[i]) * (i + 1) * n[i] for i in range(len(d))))
        spare = 1.0 if left <= 0 else 0.0
        return Lower(total, known, d, (left + spare) / (total + spare) if total + spare else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.ones(len(self.d) + 2)
        d[1 : len(self.d) + 1] = self.d
        # without discounts one occurrence more is assumed, which the unknown words get
        denominator = self.total + (0.0 if len(self.d) else 1.0)
        return np.where(c > 0, d[np.minimum(c, len(self.d) + 1)] * c / max(denominator, 1.0), self.over)


# ---------------------------------------------------------------- 1. blocks

_BLOCKS = "kind int, block long, bucket int, train long, tokens long, payload binary"


def _to_blocks(id_: str, text: str, held: str, buckets: int, vocabulary: bool):
    """Blocks of texts: for the vocabulary, their distinct words by bucket; else their numbers."""

    def run(batches):
        for serial, t in enumerate(grouped_batches(batches, text)):
            block = block_number(serial)
            low, s, n, doc = words(*utf8(t.column(text)))
            out = np.asarray(t.column(held).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), bool)
            h = word_hashes(low, s, n)
            code, uniq = pd.factorize(h)
            size = np.bincount(code, minlength=len(uniq))
            order = np.argsort(-size, kind="stable")
            local = np.empty(len(uniq), np.int64)
            local[order] = np.arange(len(uniq))
            seq = local[code]
            uniq = uniq[order]
            part = (uniq % np.uint64(buckets)).astype(np.int32)
            if not vocabulary:
                ids = t.column(id_).combine_chunks().cast(pa.int64())
                null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
                per_doc = np.bincount(doc, minlength=t.num_rows)
                body = pack(seq.astype(np.uint32), part, per_doc.astype(np.uint32), out.astype(np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null.astype(np.uint8))
                yield from _rows([(0, block, 0, 0, 0, body)], _BLOCKS_ARROW)
                continue
            rows = [(0, block, block % buckets, int((~out).sum()), len(seq) + t.num_rows, None)]
            train = np.bincount(seq, weights=~out[doc], minlength=len(uniq)).astype(np.int64)
            first = np.zeros(len(uniq), np.int64)
            first[seq[::-1]] = np.arange(len(seq))[::-1]
            ws, wn = s[first], n[first]
            where = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[where], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = where[cuts[b] : cuts[b + 1]]
                m = wn[mine]
                at = np.repeat(ws[mine] - np.cumsum(m) + m, m) + np.arange(m.sum())
                rows.append((1, block, b, 0, 0, pack(m.astype(np.uint32), train[mine], low[at].tobytes())))
            yield from _rows(rows, _BLOCKS_ARROW)

    return run


_BLOCKS_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("train", pa.int64()), ("tokens", pa.int64()), ("payload", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)] if rows else []


# ---------------------------------------------------------------- 2. vocabulary


def _vocabulary(k: int, buckets: int):
    schema = _vocab_arrow(k)

    def run(key, group):
        lean_memory()
        bucket = key[0].as_py()
        got = [(b, *unpack(p)) for b, p in zip(group.column("block").to_pylist(), group.column("payload").to_pylist(), strict=True) if p is not None]
        sums = [sum(group.column(c).to_pylist()) for c in ("train", "tokens")]
        n = np.concatenate([x[1] for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        c = np.concatenate([x[2] for x in got]) if got else np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(x[3] for x in got), np.uint8)
        s = np.cumsum(n) - n
        code, uniq = pd.factorize(word_hashes(raw, s, n))
        total = np.bincount(code, weights=c, minlength=len(uniq)).astype(np.int64)
        order = np.lexsort((uniq, -total))
        place = np.empty(len(uniq), np.int64)
        place[order] = np.arange(len(uniq))
        number = FIRST + place * buckets + bucket
        first = np.zeros(len(uniq), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        w = [raw[s[i] : s[i] + n[i]].tobytes().decode("utf-8", "replace") for i in first[order].tolist()]
        kinds = [int((total == r).sum()) for r in range(1, k + 2)]
        rows = [(0, 0, int(total.sum()), int((total > 0).sum()), *sums, kinds, w, number[order].tolist(), total[order].tolist(), None)]
        at = 0
        for block, m, _, _ in got:
            mine = code[at : at + len(m)]
            at += len(m)
            rows.append((1, block, 0, 0, 0, 0, None, None, None, None, pack(np.array([bucket]), number[mine], total[mine])))
        return pa.Table.from_batches(_rows(rows, schema), schema)

    return run


def _vocab_arrow(k: int) -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("train", pa.int64()), ("tokens", pa.int64()), ("n_r", pa.list_(pa.int64())), ("word", pa.list_(pa.string())), ("number", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())), ("payload", pa.binary())])


_VOCAB = "kind int, block long, n long, v long, train long, tokens long, n_r array<long>, word array<string>, number array<long>, c array<long>, payload binary"


# ---------------------------------------------------------------- 3. tokens to the buckets of their contexts


def _bucket(g1: np.ndarray, g2: np.ndarray, c1: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    sub = np.zeros(len(g1), np.uint64)
    big = np.flatnonzero(c1 > hot)
    if len(big):
        ways = -(-c1[big] // hot)
        sub[big] = mixed(g2[big].astype(np.uint64)) % ways.astype(np.uint64)
    return (mixed(g1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub) % np.uint64(buckets)).astype(np.int64)


def _places(g1: int, c1: int, hot: int, buckets: int) -> list[int]:
    """All buckets over which a hot context is spread."""
    ways = -(-c1 // hot)
    sub = np.arange(ways, dtype=np.uint64)
    return np.unique(mixed(np.full(ways, g1, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub) % np.uint64(buckets)).tolist()


_TOKENS = "bucket int, kind int, block long, payload binary"
_TOKENS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def _to_tokens(low: Lower, n_train: int, hot: int, buckets: int, order: int):
    def run(key, group):
        lean_memory()
        block = key[0].as_py()
        kinds, bodies = group.column("kind").to_pylist(), group.column("payload").to_pylist()
        seq, part, per_doc, out, ids, null = unpack(next(p for q, p in zip(kinds, bodies, strict=True) if not q))
        number, count = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        where = np.argsort(part, kind="stable")
        ordered = part[where]
        for q, p in zip(kinds, bodies, strict=True):
            if q:
                b, gid, c = unpack(p)
                lo, hi = np.searchsorted(ordered, [b[0], b[0] + 1])
                if hi - lo != len(gid):
                    raise ValueError("a block was read twice with different words")
                number[where[lo:hi]], count[where[lo:hi]] = gid, c
        per_doc = per_doc.astype(np.int64)
        d = len(per_doc)
        size = per_doc + 1
        stop = np.cumsum(size)
        total = int(stop[-1]) if d else 0
        g2, c2 = np.full(total, END, np.int64), np.full(total, n_train, np.int64)
        is_word = np.ones(total, bool)
        is_word[stop - 1] = False
        g2[is_word], c2[is_word] = number[seq], count[seq]
        g1, c1 = np.full(total, START, np.int64), np.full(total, n_train, np.int64)
        begins = np.zeros(total, bool)
        begins[stop - size] = True
        later = np.flatnonzero(~begins)
        g1[later], c1[later] = g2[later - 1], c2[later - 1]
        doc = np.repeat(np.arange(d), size)
        base = np.bincount(doc, np.log10((c2 + 1) / (low.total + low.known + 1)), d)
        known = np.bincount(doc, c2 > 0, d).astype(np.int64)
        rows = [(block % buckets, 0, block, pack(ids, null, out, size, known, base))]
        # the word before the context; the start has none, and is spread by what follows it
        left = np.full(total, START, np.int64)
        if order > 2:
            left[later] = g1[later - 1]
        q = _bucket(g1, np.where(g1 == START, g2, left) if order > 2 else g2, c1, hot, buckets)
        if max(g1.max(initial=0), g2.max(initial=0)) < 1 << 32:
            o = np.argsort(left.astype(np.uint32), kind="stable") if order > 2 else np.arange(total)
            o = o[np.argsort((g1.astype(np.uint64) << np.uint64(32) | g2.astype(np.uint64))[o], kind="stable")]
        else:
            o = np.lexsort((left, g2, g1))
        qs = q[o].astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        o = o[np.argsort(qs, kind="stable")]
        q, g1, g2, left, c1, c2, doc = q[o], g1[o], g2[o], left[o], c1[o], c2[o], doc[o]
        train = out[doc] == 0
        cuts = np.searchsorted(q, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[b], cuts[b + 1]
            a1, a2, al = g1[i:j], g2[i:j], left[i:j]
            pair = np.r_[True, (a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])]
            p = np.flatnonzero(pair)
            t = np.flatnonzero(pair | np.r_[True, al[1:] != al[:-1]])
            m = np.diff(np.r_[t, j - i])
            mt = np.add.reduceat(train[i:j].astype(np.int64), t)
            p1 = a1[p]
            h = np.flatnonzero(np.r_[True, p1[1:] != p1[:-1]])
            triples = np.diff(np.searchsorted(t, np.r_[p, j - i]))
            # followers rise within a context: steps instead of numbers
            step = np.diff(a2[p], prepend=0)
            step[h] = a2[p][h]
            _, one = np.unique(a2[p], return_index=True)  # the count of each follower goes once
            body = pack(np.diff(p1[h], prepend=0), np.diff(np.r_[h, len(p)]).astype(np.uint32), c1[i:j][p[h]], step, c2[i:j][p[one]], triples.astype(np.uint32), al[t], m.astype(np.uint32), mt.astype(np.uint32), doc[i:j].astype(np.uint32))
            rows.append((b, 1, block, body))
        return pa.Table.from_batches(_rows(rows, _TOKENS_ARROW), _TOKENS_ARROW)

    return run


# ---------------------------------------------------------------- 4. counts, sums of hot contexts, scores


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of small numbers: the first ones, the second ones, and which each row is."""
    key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    o = np.argsort(key)
    key = key[o]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.empty(len(key), np.int64)
    at[o] = np.cumsum(new) - 1
    key = key[new]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), at


class _Bucket:
    """The pairs and triples of a bucket: distinct ones sorted by context, and where those of each block went."""

    def __init__(self, group: pa.Table, low: Lower, hot: int, order: int):
        self.base, self.parts, self.hot = [], [], hot
        ctx, fol, c1, each, c2, seen, left, pair, size, pairs = [], [], [], [], [], [], [], [], [], 0
        for kind, block, p in zip(group.column("kind").to_pylist(), group.column("block").to_pylist(), group.column("payload").to_pylist(), strict=True):
            if not kind:
                self.base.append((block, p))
                continue
            step, runs, k1, up, k2, n, al, m, mt, doc = unpack(p)
            ctx.append(np.repeat(np.cumsum(step), runs))
            c1.append(np.repeat(k1, runs))
            upto = np.cumsum(up)
            begin = np.cumsum(runs.astype(np.int64)) - runs
            fol.append(upto - np.repeat(upto[begin] - up[begin], runs))
            each.append(np.unique(fol[-1]))
            c2.append(k2)
            pair.append(np.repeat(np.arange(pairs, pairs + len(up)), n))
            pairs += len(up)
            left.append(al)
            seen.append(mt)
            size.append(len(al))
            self.parts.append((block, m, doc))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        l1, self.ctx = pd.factorize(cat(ctx))
        l2, u2 = pd.factorize(cat(fol))
        self.own, fol, at = _distinct(l1, l2)
        self.fol = u2[fol]
        count = np.zeros(len(u2), np.int64)
        count[pd.Index(u2).get_indexer(cat(each))] = cat(c2)
        self.c2 = count[fol]
        self.p1 = low.p(self.c2)
        self.c1 = np.zeros(len(self.ctx), np.int64)
        self.c1[l1] = cat(c1)
        l3, u3 = pd.factorize(cat(left))
        self.pair, left, self.at = _distinct(at[cat(pair)], l3)
        self.left = u3[left]
        self.r3 = np.bincount(self.at, cat(seen), len(self.pair)).astype(np.int64)
        self.r = np.bincount(self.pair, self.r3, len(self.own)).astype(np.int64)
        self.code = left
        self.deep = self.ctx[self.own[self.pair]] != START if len(self.pair) and order > 2 else np.zeros(len(self.pair), bool)
        self.cut = np.cumsum(size)

    def deep_contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of triples (the pair's, and the word before), and which each triple has."""
        mid, _, own = _distinct(self.own[self.pair], self.code)
        before = np.zeros(len(mid), np.int64)
        before[own] = self.left
        return mid, before, own

    def hot_contexts(self) -> list[int]:
        return np.flatnonzero(self.c1 > self.hot).tolist()

    def parts_of(self, i: int):
        """(part, pairs by follower) of a hot context."""
        lo, hi = np.searchsorted(self.own, [i, i + 1])
        ways = -(-int(self.c1[i]) // self.hot)
        order = lo + np.argsort(self.fol[lo:hi])
        part = self.fol[order] % ways
        for q in np.unique(part).tolist():
            yield q, order[part == q]


def _sums(r: np.ndarray, lower: np.ndarray, own: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of each context: followers seen 1..k times, occurrences of more frequent ones, sum of the lower level's P over the seen."""
    cols = [np.bincount(own, r == i, n) for i in range(1, k + 1)]
    cols.append(np.bincount(own, np.where(r > k, r, 0), n))
    cols.append(np.bincount(own, np.where(r > 0, lower, 0), n))
    return np.stack(cols, 1) if n else np.zeros((0, k + 2))


def _kinds(r: np.ndarray, k: int) -> list[float]:
    """How many counts are 1..k + 1 (and a zero, to be as long as sums)."""
    return [float((r == i).sum()) for i in range(1, k + 2)] + [0.0]


_FACTS = "ctx long, part int, bucket int, c1 long, s array<double>, payload binary"
_FACTS_ARROW = pa.schema([("ctx", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("c1", pa.int64()), ("s", pa.list_(pa.float64())), ("payload", pa.binary())])
PAIRS, TRIPLES = -1, -2  # instead of a context: the counts of counts


def _counts(low: Lower, k: int, hot: int, order: int):
    def run(key, group):
        lean_memory()
        b, bucket = _Bucket(group, low, hot, order), key[0].as_py()
        cold = b.c1[b.own] <= hot if len(b.own) else np.zeros(0, bool)
        rows = [(PAIRS, 0, -1, 0, _kinds(b.r[cold], k), None), (TRIPLES, 0, -1, 0, _kinds(b.r3[b.deep], k), None)]
        for i in b.hot_contexts():
            rows += [(int(b.ctx[i]), q, bucket, int(b.c1[i]), None, pack(np.diff(b.fol[own], prepend=0), b.r[own], b.c2[own])) for q, own in b.parts_of(i)]
        return pa.Table.from_batches(_rows(rows, _FACTS_ARROW), _FACTS_ARROW)

    return run


def _totals(low: Lower, k: int):
    """Of a part of a hot context's pairs: counts over all buckets, sent back to each; sums; counts of counts."""

    def run(key, group):
        lean_memory()
        ctx, part = key[0].as_py(), key[1].as_py()
        if ctx < 0:
            total = np.sum(np.array(group.column("s").to_pylist()), 0)
            return pa.Table.from_batches(_rows([(ctx, 0, -1, 0, total.tolist(), None)], _FACTS_ARROW), _FACTS_ARROW)
        got = sorted(zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True))
        got = [(bucket, *unpack(p)) for bucket, p in got]
        fol = np.concatenate([np.cumsum(x[1]) for x in got])
        uniq, first, at = np.unique(fol, return_index=True, return_inverse=True)
        r = np.bincount(at, np.concatenate([x[2] for x in got]), len(uniq)).astype(np.int64)
        p1 = low.p(np.concatenate([x[3] for x in got])[first])
        c1 = max(group.column("c1").to_pylist())
        rows = [(ctx, part, -1, c1, _sums(r, p1, np.zeros(len(r), np.int64), 1, k)[0].tolist(), None), (PAIRS, 0, -1, 0, _kinds(r, k), None)]
        mine = np.zeros(len(fol), np.uint8)
        mine[first] = 1  # a pair is stored by the first bucket that has it
        lo = 0
        for bucket, step, _, _ in got:
            hi = lo + len(step)
            rows.append((ctx, part, bucket, c1, None, pack(r[at[lo:hi]], mine[lo:hi])))
            lo = hi
        return pa.Table.from_batches(_rows(rows, _FACTS_ARROW), _FACTS_ARROW)

    return run


_SCORED = "kind int, block long, payload binary"
_SCORED_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def backoff_weights(sums: np.ndarray, c1: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: the denominator of its seen followers, and alpha."""
    full = np.ones(k)
    full[: len(d)] = d
    r = np.arange(1, k + 1)
    kept = sums[:, :k] @ (full * r) + sums[:, k]
    freed = sums[:, :k] @ ((1 - full) * r)
    den = c1 + np.where(freed <= 0, 1.0, 0.0)
    alpha = np.where(c1 > 0, (1 - kept / np.maximum(den, 1)) / np.maximum(1 - sums[:, k + 1], 1e-300), 1.0)
    return den, alpha


def _level(r: np.ndarray, own: np.ndarray, sums: np.ndarray, c: np.ndarray, d: np.ndarray, lower: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """P of each event of a level, from that of the lower one, and alpha of each context."""
    den, alpha = backoff_weights(sums, c, d, k)
    full = np.ones(k + 2)
    full[1 : len(d) + 1] = d
    return np.where(r > 0, full[np.minimum(r, k + 1)] * r / np.maximum(den[own], 1), alpha[own] * lower), alpha


_GRAMS = "bucket long, before array<long>, context array<long>, backoff array<double>, followers array<int>, word array<long>, c array<long>"


def _rises(runs: np.ndarray) -> np.ndarray:
    """Where the runs of these lengths begin."""
    return (np.cumsum(runs) - runs)[runs > 0]


def _steps(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Numbers that rise within runs, as steps; each run begins with its first number."""
    step = np.diff(x, prepend=0)
    step[begin] = x[begin]
    return step


def _summed(step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    upto = np.cumsum(step)
    return upto - np.repeat(upto[begin] - step[begin], np.diff(np.r_[begin, len(step)]))


def _table(before: np.ndarray, ctx: np.ndarray, weight: np.ndarray, own: np.ndarray, word: np.ndarray, c: np.ndarray) -> bytes:
    """A packed table of contexts (before, ctx) and their followers (own: of which context): all rise, and are kept as steps.

    Weights that are NaN are left out.
    """
    rank = np.lexsort((before, ctx))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    own = place[own]
    o = np.lexsort((word, own))
    followers = np.bincount(own, minlength=len(ctx))
    ctx, before, weight = ctx[rank], before[rank], weight[rank]
    new = np.flatnonzero(np.diff(ctx, prepend=-1))
    return pack(_steps(before, new), np.diff(ctx, prepend=0), weight[~np.isnan(weight)], followers.astype(np.int32), _steps(word[o], _rises(followers)), c[o])


def _opened(payload: bytes) -> tuple[np.ndarray, ...]:
    """before, context, backoff (NaN where it was left out: after contexts seen once), followers, word, c."""
    step, up, weight, followers, word, c = unpack(payload)
    ctx = np.cumsum(up)
    if len(weight) < len(ctx):
        seen = np.bincount(np.repeat(np.arange(len(ctx)), followers), c, len(ctx))
        full = np.full(len(ctx), np.nan)
        full[seen != 1] = weight
        weight = full
    return _summed(step, np.flatnonzero(np.diff(ctx, prepend=-1))), ctx, weight, followers, _summed(word, _rises(followers.astype(np.int64))), c


def _open(batches):
    """The packed tables of buckets as arrays."""
    for b in batches:
        for bucket, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(one(x, t) for x, t in zip(_opened(payload), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()), strict=True))], names=["bucket", "before", "context", "backoff", "followers", "word", "c"])


def _scores(low: Lower, k: int, hot: int, order: int):
    def run(key, group, facts):
        lean_memory()
        bucket = key[0].as_py()
        b = _Bucket(group, low, hot, order)
        n2 = n3 = np.zeros(k + 2)
        spread, answers = {}, {}
        for ctx, part, sums, payload in zip(*(facts.column(c).to_pylist() for c in ("ctx", "part", "s", "payload")), strict=True):
            if payload is not None:
                answers[ctx, part] = payload
            elif ctx == PAIRS:
                n2 = np.array(sums)
            elif ctx == TRIPLES:
                n3 = np.array(sums)
            else:
                spread[ctx] = sums
        mine = np.ones(len(b.own), bool)
        s = _sums(b.r, b.p1, b.own, len(b.ctx), k)
        for i in b.hot_contexts():
            ctx = int(b.ctx[i])
            s[i] = spread[ctx]
            for part, own in b.parts_of(i):
                total, first = unpack(answers[ctx, part])
                b.r[own], mine[own] = total, first.astype(bool)
        p2, alpha = _level(b.r, b.own, s, b.c1, discounts(n2[: k + 1].tolist(), k), b.p1, k)
        lower = p2[b.pair]
        mid, before, own3 = b.deep_contexts()
        n = len(mid)
        c3 = np.bincount(own3, b.r3, n).astype(np.int64)
        p3, alpha3 = _level(b.r3, own3, _sums(b.r3, lower, own3, n, k), c3, discounts(n3[: k + 1].tolist(), k), lower, k)
        units = np.rint(np.log10(np.maximum(np.where(b.deep, p3, lower), 1e-300)) * UNIT)
        rows = [(0, block, payload) for block, payload in b.base]
        lo = 0
        for (block, m, doc), hi in zip(b.parts, b.cut.tolist(), strict=True):
            value = np.repeat(units[b.at[lo:hi]], m)
            lo = hi
            total = np.bincount(doc, value)
            has = np.flatnonzero(np.bincount(doc))
            rows.append((1, block, pack(np.diff(has, prepend=0).astype(np.uint32), total[has].astype(np.int64))))
        known = np.flatnonzero((b.r > 0) & mine)
        rows.append((2, bucket, _table(np.zeros(len(b.ctx), np.int64), b.ctx, alpha, b.own[known], b.fol[known], b.r[known])))
        known = np.flatnonzero((b.r3 > 0) & b.deep)
        some = np.flatnonzero(np.bincount(own3[known], minlength=n))
        renumbered = np.zeros(n, np.int64)
        renumbered[some] = np.arange(len(some))
        # a context seen once has the weight that its one follower leaves, which needn't be stored
        weight = np.where(c3[some] > 1, alpha3[some], np.nan)
        rows.append((3, bucket, _table(before[some], b.ctx[mid[some]], weight, renumbered[own3[known]], b.fol[b.pair[known]], b.r3[known])))
        return pa.Table.from_batches(_rows(rows, _SCORED_ARROW), _SCORED_ARROW)

    return run


def _finish(n_train: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key, group):
        total = None
        for kind, p in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True):
            if not kind:
                ids, null, out, size, known, base = unpack(p)
                total = np.zeros(len(ids), np.int64)
        for kind, p in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True):
            if kind:
                step, units = unpack(p)
                total[np.cumsum(step)] += units
        return pa.table([pa.array(ids, mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(size.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(base), pa.array(total / UNIT)], schema=schema)

    return run


@dataclass
class KatzModel:
    """Tables of a trained model; each may be empty.

    unigrams(word, number, c); bigrams(bucket, context, backoff, followers, word, c)
    and trigrams, with `before` (the word before the context), hold arrays (stored
    packed, a row for each bucket in a folder for each level): the followers of
    context[i] are the next followers[i] entries of word and c, all as numbers. A trigram context seen once has NaN as its backoff: it is
    (1 - d_1) / (1 - P) of its follower, or by d_1 = 1 as for any context without
    discounts. scores: a row for each input row.
    """

    scores: DataFrame
    unigrams: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame
    lower: Lower | None


def katz(docs: DataFrame, held_out: Column, id_: str = "doc_id", text: str = "text", k: int = 5, hot: int = 1_500_000, bucket_tokens: int = 1_500_000, order: int = 3) -> KatzModel:
    """Trains on the rows whose held_out isn't true and scores all rows.

    A null text is empty (its one token is the end); a null id stays null;
    repeated rows count, and are scored, each for itself; other columns are
    ignored, whatever their names. No rows: empty tables.
    k: largest count that is discounted. hot: occurrences above which a context
    is spread. bucket_tokens: tokens that a task holds at once. order: 2 or 3.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"), held_out.alias("held"))
    # buckets of words grow with the splits of the input
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    seen = rows.mapInArrow(_to_blocks("id", "text", "held", wide, True), _BLOCKS).repartition(wide, "bucket")
    vocab = scratch.write(seen.groupBy("bucket").applyInArrow(_vocabulary(k, wide), _VOCAB), "vocabulary", "kind")
    zero = F.lit(0)
    counts = vocab.where("kind = 0").agg(*(F.coalesce(F.sum(c), zero) for c in ("n", "v", "train", "tokens")), *(F.coalesce(F.sum(F.col("n_r")[i]), zero) for i in range(k + 1))).head()
    train, tokens = int(counts[2]), int(counts[3])
    n_r = [float(x) for x in counts[4:]]
    if 0 < train <= k + 1:
        n_r[train - 1] += 1  # the end token
    low = Lower.of(n_r, float(counts[0] + train), float(counts[1] + (train > 0)), k)
    many = max(spark.sparkContext.defaultParallelism, -(-tokens // bucket_tokens), 1)
    blocks = rows.mapInArrow(_to_blocks("id", "text", "held", wide, False), _BLOCKS)
    both = blocks.select("kind", "block", "payload").unionAll(vocab.where("kind = 1").select(F.lit(1).alias("kind"), "block", "payload"))
    pairs = both.repartition(wide, "block").groupBy("block").applyInArrow(_to_tokens(low, train, hot, many, order), _TOKENS)
    pairs = pairs.repartition(many, "bucket")
    stats = pairs.groupBy("bucket").applyInArrow(_counts(low, k, hot, order), _FACTS).repartition(wide, "ctx", "part")
    stats = stats.groupBy("ctx", "part").applyInArrow(_totals(low, k), _FACTS)
    sums = stats.where("bucket = -1").groupBy("ctx").agg(F.max("c1").alias("c1"), F.array(*(F.sum(F.col("s")[i]) for i in range(k + 2))).alias("s"))

    def places(batches):
        for b in batches:
            ctx, c1, s = (b.column(i).to_pylist() for i in range(3))
            out = [(x, 0, q, n, y, None) for x, n, y in zip(ctx, c1, s, strict=True) for q in (range(many) if x < 0 else _places(x, n, hot, many))]
            yield from _rows(out, _FACTS_ARROW)

    facts = sums.mapInArrow(places, _FACTS).unionAll(stats.where("bucket >= 0"))
    scored = pairs.groupBy("bucket").cogroup(facts.repartition(many, "bucket").groupBy("bucket")).applyInArrow(_scores(low, k, hot, order), _SCORED)
    scored = scratch.write(scored, "scored", "kind")
    scores = scored.where("kind < 2").select("kind", "block", "payload").repartition(wide, "block").groupBy("block").applyInArrow(_finish(int(low.total)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    unigrams = vocab.where("kind = 0").select(F.explode(F.arrays_zip("word", "number", "c")).alias("x")).select("x.word", "x.number", "x.c")
    grams = lambda kind: scored.where(F.col("kind") == kind).select("block", "payload").mapInArrow(_open, _GRAMS)
    return KatzModel(scores, unigrams, grams(2).drop("before"), grams(3), low)


def held_by_crc(id_: str = "doc_id", mod: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def crc(x: object) -> int:
    return zlib.crc32(str(x).encode())


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; trained on those whose crc32(doc_id) mod 7 is not 2."""
    return katz(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_by_crc()).scores
