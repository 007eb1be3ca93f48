"""Exact Jaccard self join of word n-gram sets, with skipping by set relations.

A set is known by a 64-bit fingerprint; equal sets are one node from the start.
The join follows the prefix principle: under one order of all n-grams (rarer
first, by a sketch of their counts; any order is right) two sets that link share
an n-gram among the first |x| - ceil(t|x|) + 1 of each. One inverted list per
n-gram holds (size, position, set).

Block skipping: the entries of a list fall into blocks of equal size and
position. If an n-gram is the first that two sets share, their overlap is at
most what is left from there in either, so a pair of blocks whose bound misses
the threshold is skipped without looking at its sets. Blocks are told apart by
component too, and pairs within a component are settled, so a list is never run
through pair by pair for its near copies.

Answers from answers: a list is first compared with one set only, its pivot: the
one with the smallest position, which has the fewest n-grams of its own and so is
nearest to what a group of near copies has in common. Sets that link
with it are one component. Of the rest, the overlaps o(x), o(y) of two sets with
a pivot of size z bound that of each other:

    o(x) + o(y) - z <= |x and y| <= min(o(x), o(y)) + min(|x| - o(x), |y| - o(y))

so what is known of one set answers most pairs of a set close to it, as links or
as none; only pairs between the bounds are compared. A group of many near copies
costs a star, not all its pairs, and no link between different components is lost.

A list that the counts of n-grams say may be long is dealt into parts, each with a
pivot of its own; pairs of different parts meet in cells of two parts at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, grouped_batches, hot_limit, join_hot, lean_memory, mixed, pack, partitions_for, unpack, utf8, word_hashes, words

#: Buckets of the sketch of n-gram counts, whose levels are sent to every task: 2 MB, whatever the input.
SKETCH_BITS = 21
_CHUNKS = 64
#: Partners of a set that share a key when pairs are verified.
PARTNERS = 32
#: Requests for sets that may be broadcast (20 bytes each); beyond that the sets are shuffled to them.
ASKED = 1_000_000
#: Pivots that a list gets in each round between the first and the last.
PIVOTS = (8,)
#: Entries of a list, or of a part of one, that a task holds.
LIST = 1 << 17
#: Entries of lists that a task holds in all.
ENTRIES = 500_000
_B = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams, grouped by document; the document of each; and the sets' sizes.

    A document of fewer than n words has its whole sequence as one; one without words has none.
    """
    low, s, m, doc = words(raw, start, length)
    h = word_hashes(low, s, m)
    d = len(start)
    count = np.bincount(doc, minlength=d)
    key, own = [], []
    if len(h) >= n:
        full = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
        acc = np.zeros(len(full), np.uint64)
        for k in range(n):
            acc = acc * _B + h[full + k]
        key.append(mixed(acc + np.uint64(n)))
        own.append(doc[full])
    first = np.cumsum(count) - count
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        acc = np.zeros(len(short), np.uint64)
        for i in range(k):
            acc = acc * _B + h[first[short] + i]
        key.append(mixed(acc + np.uint64(k)))
        own.append(short)
    key = np.concatenate(key) if key else np.zeros(0, np.uint64)
    own = np.concatenate(own) if own else np.zeros(0, np.int64)
    o = np.argsort(key)
    o = o[np.argsort(own[o].astype(np.uint16 if d < 1 << 16 else np.uint32), kind="stable")]
    key, own = key[o], own[o]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    return key, own, np.bincount(own, minlength=d)


def fingerprints(key: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set (meaningless for an empty one)."""
    total = np.append(np.uint64(0), np.cumsum(mixed(key ^ _B), dtype=np.uint64))
    end = np.cumsum(size)
    return mixed(total[end] - total[end - size] + size.astype(np.uint64)).view(np.int64)


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b whose Jaccard similarity is num / den or more."""
    return -(-num * (a + b) // (num + den))


def compatible(s1, p1, s2, p2, num: int, den: int):
    """Can sets of these sizes, that share their first n-gram at these positions, reach the threshold?"""
    return (np.minimum(s1 - p1, s2 - p2) >= needed(s1, s2, num, den)) & (den * np.minimum(s1, s2) >= num * np.maximum(s1, s2))


# ---------------------------------------------------------------- inverted lists


def _lists(token: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray):
    """Entries sorted by token, position and node, each once; starts and lengths of the lists with two or more."""
    o = np.lexsort((node, pos, token))
    token, node, size, pos = token[o], node[o], size[o], pos[o]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    o = o[new]
    token, node, size, pos = token[new], node[new], size[new], pos[new]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    many = np.diff(np.r_[begin, len(token)])
    keep = many > 1
    return o, token, node, size, pos, begin[keep], many[keep]


def _dealt(token: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """A key for a part of a list; the list's own where all parts are 0."""
    key = token.view(np.uint64)
    for p in parts:
        key = np.where(p > 0, mixed(key ^ (p.astype(np.uint64) * _B)), key)
    return key.view(np.int64)


def pairs_within(begin: np.ndarray, many: np.ndarray, size: np.ndarray, pos: np.ndarray, label: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries of one list with different labels that pass the bounds; short lists together."""
    for k in np.unique(many).tolist():
        own = begin[many == k]
        if k <= 48:
            i, j = np.triu_indices(k, 1)
            for lo in range(0, len(own), max(1, 2_000_000 // len(i))):
                part = own[lo : lo + max(1, 2_000_000 // len(i)), None]
                a, b = (part + i).reshape(-1), (part + j).reshape(-1)
                ok = (label[a] != label[b]) & compatible(size[a], pos[a], size[b], pos[b], num, den)
                yield a[ok], b[ok]
            continue
        for at in own.tolist():
            # blocks of equal size, position and label; pairs of blocks are skipped as a whole
            s, p, c = size[at : at + k], pos[at : at + k], label[at : at + k]
            order = np.lexsort((c, p, s))
            s, p, c = s[order], p[order], c[order]
            cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (c[1:] != c[:-1])])
            end = np.r_[cut[1:], len(s)]
            bs, bp, bc = s[cut], p[cut], c[cut]
            top = np.searchsorted(bs, bs * den // num, "right")  # larger sets than that don't link
            for x in range(len(cut)):
                y = np.arange(x + 1, top[x])
                y = y[(bc[y] != bc[x]) & compatible(bs[x], bp[x], bs[y], bp[y], num, den)]
                if not len(y):
                    continue
                left = order[cut[x] : end[x]]
                right = np.concatenate([order[cut[v] : end[v]] for v in y.tolist()]) if len(y) < end[y].sum() - cut[y].sum() else order[cut[y]]
                for lo in range(0, len(left), max(1, 1_000_000 // len(right))):
                    part = left[lo : lo + max(1, 1_000_000 // len(right))]
                    yield np.repeat(part, len(right)) + at, np.tile(right, len(part)) + at


def alive(begin: np.ndarray, many: np.ndarray, size: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """Flags of the entries that have a compatible one in their list besides its first entry; no pairs are gone through in long lists."""
    flag = np.zeros(len(size), bool)
    for k in np.unique(many).tolist():
        own = begin[many == k] + 1
        if k < 3:
            continue
        if k <= 24:
            i, j = np.triu_indices(k - 1, 1)
            for lo in range(0, len(own), max(1, 2_000_000 // len(i))):
                part = own[lo : lo + max(1, 2_000_000 // len(i)), None]
                a, b = (part + i).reshape(-1), (part + j).reshape(-1)
                ok = compatible(size[a], pos[a], size[b], pos[b], num, den)
                flag[a[ok]] = flag[b[ok]] = True
            continue
        for at in own.tolist():
            s, p = size[at : at + k - 1], pos[at : at + k - 1]
            order = np.lexsort((p, s))
            s, p = s[order], p[order]
            cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            end = np.r_[cut[1:], len(s)]
            bs, least = s[cut], p[cut]  # the smallest position of each size leaves the most
            lo, hi = np.searchsorted(bs, -(-num * bs // den)), np.searchsorted(bs, bs * den // num, "right")
            for x in range(len(cut)):
                y = np.arange(lo[x], hi[x])
                y = y[y != x]
                need = needed(bs[x], bs[y], num, den)
                need = need[bs[y] - least[y] >= need]
                most = bs[x] - need.min() if len(need) else -1
                inner = bs[x] - needed(bs[x], bs[x], num, den)
                good = p[cut[x] : end[x]] <= most
                if end[x] - cut[x] > 1:
                    # another of the same size: the first one, or for it the second
                    with_first = p[cut[x] : end[x]] <= inner
                    with_first[0] = p[cut[x] + 1] <= inner
                    good |= with_first
                flag[at + order[cut[x] : end[x]][good]] = True
    return flag


_MADE = "kind int, token long, a long, b long, size int, pos int"
_MADE_ARROW = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])


def _table(batches, n: int) -> list[np.ndarray]:
    cols = [[] for _ in range(n)]
    for b in batches:
        for c, x in zip(cols, b.columns, strict=True):
            c.append(x.to_numpy(zero_copy_only=False))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]


def _stars(num: int, den: int):
    """kind 0: pairs (pivot a, b); kind 1: entries (pivot a, set b) of lists where pairs without the pivot may link."""

    def run(batches):
        lean_memory()
        token, part, node, size, pos = _table(batches, 5)
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        o, key, node, size, pos, begin, many = _lists(_dealt(token, part), node, size, pos)
        token, part = token[o], part[o]
        at = np.repeat(begin, many - 1)
        other = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(many - 1) - (many - 1), many - 1)
        ok = compatible(size[at], pos[at], size[other], pos[other], num, den)
        a, b = node[at[ok]], node[other[ok]]
        o = np.lexsort((b, a))
        a, b = a[o], b[o]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield from _made(0, np.zeros(int(new.sum()), np.int64), a[new], b[new], None, None)
        # of a list in parts, all entries have pairs still to come
        live = np.flatnonzero(alive(begin, many, size, pos, num, den) | (part > 0))
        pivot = node[np.searchsorted(key, key[live])]
        yield from _made(1, token[live], pivot, node[live], size[live], pos[live])

    return run


def _made(kind, token, a, b, size, pos):
    for lo in range(0, len(a), 50_000):
        c = slice(lo, lo + 50_000)
        n = len(a[c])
        zero = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(token[c]), pa.array(a[c]), pa.array(b[c]), zero if size is None else pa.array(size[c].astype(np.int32)), zero if pos is None else pa.array(pos[c].astype(np.int32))], schema=_MADE_ARROW)


_REST = "a long, b long, sure boolean"


def _rest(num: int, den: int, pivots: int | None):
    """Pairs of a list (or cell: of its two parts) in different components that the bounds don't rule out; sure ones are links by them.

    With pivots, only pairs with one of that many sets of the list: the first
    of the components other than its largest. Without, all.
    """

    def run(batches):
        lean_memory()
        token, part, cell, node, size, pos, label, pivot, both, psize = _table(batches, 10)
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        # entries of a cell lie in either of its parts: part is the entry's own, cell both
        o, _, node, size, pos, begin, many = _lists(_dealt(token, cell), node, size, pos)
        part, cell, label, pivot, both, psize = (x[o] for x in (part, cell, label, pivot, both, psize))
        if pivots:
            found = _pivot_pairs(begin, many, node, size, pos, label, num, den, pivots)
        else:
            found = pairs_within(begin, many, size, pos, label, num, den)
        for i, j in found:
            # in a cell of two parts (the even ones), only pairs between them
            ok = (label[i] != label[j]) & ((cell[i] % 2 == 0) | (part[i] != part[j]))
            i, j = i[ok], j[ok]
            need = needed(size[i], size[j], num, den)
            known = (pivot[i] == pivot[j]) & (both[i] >= 0) & (both[j] >= 0)
            most = np.minimum(both[i], both[j]) + np.minimum(size[i] - both[i], size[j] - both[j])
            ok = ~known | (most >= need)
            sure = (known & (both[i] + both[j] - psize[i] >= need))[ok]
            i, j = i[ok], j[ok]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            o = np.lexsort((~sure, b, a))
            a, b, sure = a[o], b[o], sure[o]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, sure = a[new], b[new], sure[new]
            for lo in range(0, len(a), 50_000):
                c = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[c]), pa.array(b[c]), pa.array(sure[c])], names=["a", "b", "sure"])

    return run


def _pivot_pairs(begin, many, node, size, pos, label, num, den, pivots):
    left, right, held = [], [], 0
    for at, k in zip(begin.tolist(), many.tolist(), strict=True):
        kinds, first, count = np.unique(label[at : at + k], return_index=True, return_counts=True)
        if len(kinds) < 2:
            continue
        others = np.sort(np.delete(first, count.argmax()))[:pivots]  # entries are sorted by position
        i, j = np.repeat(others, k) + at, np.tile(np.arange(at, at + k), len(others))
        ok = compatible(size[i], pos[i], size[j], pos[j], num, den)
        left.append(i[ok])
        right.append(j[ok])
        held += len(left[-1])
        if held > 500_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


# ---------------------------------------------------------------- verification


def _overlaps(batches):
    """Overlap of each pair (a, b): rows come by key (a, salt), a's set first and then those of its partners."""
    lean_memory()
    rows, held, x = [], None, None
    for batch in batches:
        for a, salt, node, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            y = np.cumsum(unpack(payload)[0])
            if a == node:
                held, x = (a, salt), y
                continue
            if held != (a, salt):
                raise ValueError("a pair came without its first set")
            both = np.sort(np.concatenate([x, y]))
            rows.append((a, node, len(x), len(y), int((both[1:] == both[:-1]).sum())))
        if len(rows) > 10_000:
            yield _pairs(rows)
            rows = []
    if rows:
        yield _pairs(rows)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "sa", "sb", "both"])


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, sa, sb, both) of distinct pairs (a table).

    A set is spread over a key for each PARTNERS partners, so a popular pivot is
    no hot key. Each partner's set travels once for each pair, a's once for each key.
    """
    ways = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("ways"), F.count("*").alias("n"))
    salted = join_hot(pairs, ways, "a", "n", hot_limit(pairs.count())).select("a", F.pmod(F.xxhash64("b"), "ways").cast("int").alias("salt"), "b")
    asked = salted.select("a", "salt", F.col("b").alias("node")).unionAll(salted.select("a", "salt", F.col("a").alias("node")).distinct())
    asked = scratch.write(asked, f"{name}-asked")
    few = asked.count() <= ASKED
    rows = sets.join(F.broadcast(asked) if few else asked, "node").select("a", "salt", "node", "payload")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("node") != F.col("a"))
    return scratch.write(dealt.mapInArrow(_overlaps, "a long, b long, sa long, sb long, both long"), name)


# ---------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_: str = "doc_id", text: str = "text", scratch: Scratch | None = None, most: int = LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_found), a row for each document.

    Sets of distinct word n-grams link when den * |x and y| >= num * |x or y|;
    component_id is the smallest id reachable. n_found counts the links of a
    document's set that the join had to find to know the components; it isn't the
    number of all its links, for which near copies would have to be compared pair by pair. Equal sets always share a component. Null or blank
    texts have an empty set, which links with nothing. A document without an id
    gets its size and no component. Repeated rows give a row each; an id that
    occurs with several texts links as each of them. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    bits = SKETCH_BITS
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def measure(batches):
        sketch = np.zeros(1 << bits, np.uint32)
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary())])
        any_ = False
        for t in grouped_batches(batches, "text"):
            any_ = True
            key, own, size = shingle_sets(*utf8(t.column("text")), n)
            node = fingerprints(key, own, size)
            sketch += np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            k = t.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), t.column("id").combine_chunks(), pa.array(size), pa.array(node, mask=size == 0), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        if any_:
            per = (1 << bits) // _CHUNKS
            for c in range(_CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([c], pa.int32()), pa.array([pack(sketch[c * per : (c + 1) * per])], pa.binary())], schema=schema)

    seen = scratch.write(rows.mapInArrow(measure, "kind int, doc_id long, n long, node long, chunk int, payload binary"), "sets", "kind")

    def level(key, group):
        total = sum(unpack(p)[0].astype(np.int64) for p in group.column("payload").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([np.floor(2 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    levels = {r["chunk"]: bytes(r["payload"]) for r in seen.where("kind = 1").select("chunk", "payload").groupBy("chunk").applyInArrow(level, "chunk int, payload binary").collect()}
    levels = spark.sparkContext.broadcast(b"".join(levels.get(c, bytes((1 << bits) // _CHUNKS)) for c in range(_CHUNKS)))

    def prefixes(batches):
        rank = np.frombuffer(levels.value, np.uint8)
        for t in grouped_batches(batches, "text"):
            key, own, size = shingle_sets(*utf8(t.column("text")), n)
            node = fingerprints(key, own, size)
            _, first = np.unique(node, return_index=True)
            use = np.zeros(len(node), bool)
            use[first] = True
            mine = use[own]
            key, own = key[mine], own[mine]
            order = (rank[(key >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (key >> np.uint64(8))
            o = np.argsort(order)
            o = o[np.argsort(own[o].astype(np.uint16 if len(size) < 1 << 16 else np.uint32), kind="stable")]
            key, own = key[o], own[o]
            kept = np.where(use, size, 0)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(kept) - kept, kept)
            s = size[own]
            head = np.flatnonzero(pos <= s - (-(-num * s // den)))
            # the largest count of the n-gram's level: lists that may be longer are dealt into parts
            longest = 2.0 ** ((rank.astype(float) + 1) / 2)
            ways = np.ceil(longest / most).astype(np.int64)[(key[head] >> np.uint64(64 - bits)).astype(np.int64)]
            part = np.where(ways > 1, 1 + (mixed(node[own[head]].view(np.uint64) ^ key[head]) % np.maximum(ways, 1).astype(np.uint64)).astype(np.int64), 0)
            for lo in range(0, len(head), 50_000):
                i = head[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[i].view(np.int64)), pa.array(part[lo : lo + 50_000].astype(np.int32)), pa.array(node[own[i]]), pa.array(s[i].astype(np.int32)), pa.array(pos[i].astype(np.int32))], names=["token", "part", "node", "size", "pos"])

    n_docs, n_entries = seen.where("kind = 0").agg(F.count("*"), F.coalesce(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1")), F.lit(0))).head()
    entries = rows.where("id is not null").mapInArrow(prefixes, "token long, part int, node long, size int, pos int")
    made = scratch.write(entries.repartition(max(wide, partitions_for(spark, float(n_entries), ENTRIES)), "token", "part").mapInArrow(_stars(num, den), _MADE), "stars", "kind")
    pairs = scratch.write(made.where("kind = 0").select("a", "b").distinct(), "pairs")
    open_ = made.where("kind = 1")
    # the smallest id of each set, and of those that are compared, or may be, the sets themselves
    least_ids = scratch.write(seen.where("kind = 0 and doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "nodes")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(open_.select("b")).distinct()
    texts = scratch.write(least_ids.join(nodes, "node", "left_semi").select(F.col("low").alias("id")).distinct(), "texts")
    few = texts.count() <= 2_000_000  # 16 MB of numbers
    wanted = rows.join(F.broadcast(texts) if few else texts, "id", "left_semi")

    def payloads(batches):
        for t in grouped_batches(batches, "text", 1 << 20):
            key, own, size = shingle_sets(*utf8(t.column("text")), n)
            node = fingerprints(key, own, size)
            has = np.flatnonzero(size)
            end = np.cumsum(size)
            body = [pack(np.diff(np.sort(key[end[i] - size[i] : end[i]]), prepend=np.uint64(0))) for i in has.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(body, pa.binary())], names=["node", "payload"])

    sets = scratch.write(wanted.select("text").mapInArrow(payloads, "node long, payload binary"), "payloads")
    near = F.expr(f"{den} * both >= {num} * (sa + sb - both)")
    tested = _verified(pairs, sets, scratch, "tested0")
    known = tested.select("a", F.col("b").alias("node"), F.col("sa").alias("psize"), "both").dropDuplicates(["a", "node"])
    own = F.col("a") == F.col("node")
    lists = open_.select("token", "a", F.col("b").alias("node"), "size", "pos").join(known, ["a", "node"], "left")
    lists = lists.select("token", F.col("a").alias("pivot"), "node", "size", "pos", F.when(own, F.col("size")).otherwise(F.coalesce("both", F.lit(-1))).cast("long").alias("both"), F.when(own, F.col("size")).otherwise(F.coalesce("psize", F.lit(0))).cast("long").alias("psize"))
    lists = scratch.write(lists, "lists")
    links = scratch.write(tested.where(near).select("a", "b"), "links0")
    # lists that still hold more than one component: first some more pivots each, then whatever is left
    for step, more in enumerate((*PIVOTS, None), 1):
        stars = components(links, scratch, f"star{step}")
        lab = scratch.write(lists.drop("label").join(stars, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), f"labelled{step}")
        mixed_lists = lab.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / most).alias("ways")).where("lo <> hi").select("token", "ways")
        lists = scratch.write(lab.join(mixed_lists, "token"), f"lists{step}")
        n_lists = lists.count()
        if not n_lists:
            break
        # of a long list, pivots take one part after the other; at the end all pairs of parts meet, odd cells hold two
        part = F.pmod(F.xxhash64("node", F.lit(step)), "ways").cast("int")
        dealt = lists.withColumn("part", F.when(F.col("ways") > 1, part).otherwise(0))
        if more:
            dealt = dealt.withColumn("cell", F.when(F.col("ways") > 1, (F.col("part") + 1) * 2).otherwise(0))
        else:
            other = F.explode(F.when(F.col("ways") > 1, F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
            dealt = dealt.withColumn("other", other)
            cell = (F.least("part", "other") * F.col("ways") + F.greatest("part", "other") + 1) * 2 + F.when(F.col("part") == F.col("other"), 0).otherwise(1)
            dealt = dealt.withColumn("cell", F.when(F.col("ways") > 1, cell).otherwise(0))
        dealt = dealt.select("token", "part", F.col("cell").cast("long").alias("cell"), "node", "size", "pos", "label", "pivot", "both", "psize")
        found = dealt.repartition(max(wide, partitions_for(spark, n_lists, ENTRIES)), "token", "cell").mapInArrow(_rest(num, den, more), _REST)
        found = scratch.write(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), f"found{step}")
        rest = found.where("not sure").select("a", "b").join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        fresh = _verified(scratch.write(rest, f"rest{step}"), sets, scratch, f"tested{step}")
        tested = tested.unionAll(fresh)
        links = links.unionAll(found.where("sure").select("a", "b")).unionAll(fresh.where(near).select("a", "b"))
        lists = lists.drop("ways")
    links = scratch.write(links.distinct(), "links")
    parts = components(links, scratch, "all")
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("n_found"))
    known = seen.where("kind = 0").select("doc_id", "n", "node")
    # the smallest id of each component; an id with several texts joins their components
    least = scratch.write(least_ids.join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "least")
    low = least.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("sets"))
    with_low = join_hot(least, low, "label", "sets", hot_limit(n_docs))
    final = scratch.write(with_low.join(degree, "node", "left").select("node", "component_id", "copies", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found")), "final")
    out = join_hot(known, final, "node", "copies", hot_limit(n_docs), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; sets of 4-word n-grams link at a Jaccard similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100).drop("n_found")
