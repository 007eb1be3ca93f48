"""Exact substring dedup: every byte covered by a string of `width` bytes that also starts in an earlier document.

Earlier means a smaller id. Strings that occur in no other document must not
cost a sort, so the work is split by anchors: the anchor of a window of `width`
bytes is its smallest hashed gram of `gram` bytes (leftmost on ties). Equal
windows have equal anchors, so

1. each block of texts sends the anchors' hashes (32 bits, sorted, compressed)
   to ranges of hashes, which answer which of them occur in more than one
   document;
2. the windows of such anchors, as the bytes around each anchor, go to the shard
   of the anchor's full hash. All windows equal to a window are in its shard.
   Windows of very frequent anchors go one by one, to the shard of their own
   hash. Equal strings of a block go once, with their smallest document;
3. a shard sorts its text by a suffix array (Larsson-Sadakane doubling in
   numpy), takes common prefixes (Kasai, many
   lanes at a time) and so finds the smallest document of each window. A shard
   over its size is cut into several suffix arrays, whose sorted windows are
   merged by binary search;
4. the answers meet the block again, which removes what is covered.

Hashes only bring strings together and merge equal strings (128 bits);
matching itself compares bytes.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, block_number, grouped_batches, lean_memory, mixed, pack, partitions_for, unpack, utf8

BLOCK = 4 << 20
#: Bytes of a shard, and of one suffix array.
SHARD = 3 << 20
ARRAY = 3 << 20
#: Bytes of text whose anchors are taken at once; longer documents are cut there, with the windows across the cut.
SLICE = 1 << 20
#: Bytes of text whose blocks, flags or strings a task opens in all.
TASK = 8 << 20
#: Documents above which the windows of an anchor travel one by one.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers (a sort is several times faster here than np.unique's hash table)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


# ---------------------------------------------------------------- anchors


def loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw (seven or more bytes must follow the last one read)."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", np.ascontiguousarray(raw), 0, (1,))


def span_hash(raw: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of `size` (eight or more) bytes at the given places, eight bytes at a time; the last eight may overlap."""
    eight = loads(raw)
    h = np.full(len(at), seed * 2 + 1, np.uint64)
    for o in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h ^= eight[at + o]
        h *= np.uint64(_BASE)
        h ^= h >> np.uint64(29)
    return mixed(h)


def runs(raw: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, how many, where the anchor's gram starts, and the document."""
    n, span = len(raw), width - gram + 1
    long = length >= width
    if n < width or not long.any():
        return (np.zeros(0, np.int64),) * 4
    parts, k = {1: _BYTE[raw]}, 1
    while 2 * k <= gram:  # hashes of 2**k bytes by doubling
        parts[2 * k] = parts[k][:-k] * _power(k) + parts[k][k:]
        k *= 2
    v, done = None, 0
    for k in sorted(parts, reverse=True):
        if gram - done >= k:
            piece = parts[k][done : done + n - gram + 1]
            v = piece if v is None else v * _power(k) + piece
            done += k
    del parts
    v = mixed(v)
    bits = np.uint64((2 * SLICE).bit_length())  # the same for every slice, so that equal windows have equal anchors
    v = (v >> bits << bits) | np.arange(len(v), dtype=np.uint64)
    k = 1
    while 2 * k <= span:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    if span > k:
        v = np.minimum(v[: len(v) - (span - k)], v[span - k :])
    at = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    del v
    edge = np.zeros(n + 2, np.int8)
    edge[start[long]] += 1
    np.add.at(edge, (start + length - width + 1)[long], -1)
    ok = np.cumsum(edge[: n - width + 1], dtype=np.int8) > 0
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    stop = ok.copy()
    stop[:-1] &= new[1:] | ~ok[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(stop) - first + 1, at[first], owners(first, start + length)


def owners(at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The document of each of the rising places, by where the documents end."""
    return np.repeat(np.arange(len(end)), np.diff(np.searchsorted(at, end, "left"), prepend=0))


# ---------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text in the order of all that follows (Larsson-Sadakane).

    The first sort takes eight bytes; then the groups of equal ones, and only
    they, are sorted by the rank of the place that lies as far on as is settled,
    until no two are equal (Kasai's step needs the whole order).
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = loads(padded)[:n].byteswap()
    sa = np.argsort(key)
    k = key[sa]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    del key, k
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        own = sa[slots]
        key = rank[own].astype(np.uint64) << np.uint64(32) | (rank[np.minimum(own + h, n)] + 1).astype(np.uint64)
        o = np.argsort(key)
        key, own = key[o], own[o]
        sa[slots] = own
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """Of each place in the array the bytes (up to cap) that it shares with the one before (Kasai).

    The text is cut into lanes that go on side by side; each lane keeps what the
    prefix of the last place, less one, has already settled.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    padded = np.zeros(n + cap + 8, np.uint8)
    padded[:n] = text
    eight = loads(padded)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    lanes = min(lanes, n)
    step = -(-n // lanes)
    base = np.arange(0, n, step)
    held = np.zeros(len(base), np.int64)
    for t in range(step):
        i = base + t
        live = i < n
        i = np.minimum(i, n - 1)
        p = place[i]
        j = sa[np.maximum(p - 1, 0)]
        held = np.where(live & (p > 0), np.maximum(held - 1, 0), 0)
        todo = np.flatnonzero(live & (p > 0))
        while len(todo):
            at = held[todo]
            x = eight[i[todo] + at] ^ eight[j[todo] + at]
            same = x == 0
            held[todo] = np.minimum(at + np.where(same, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3), cap)
            todo = todo[same & (held[todo] < cap)]
        lcp[p[live]] = held[live]
    lcp[0] = 0
    return lcp


def least_in_groups(text: np.ndarray, at: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by one suffix array: their order, the number of each's group of equals, the groups' smallest documents."""
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, width)
    number = np.full(len(text), -1, np.int64)
    number[at] = np.arange(len(at))
    slots = np.flatnonzero(number[sa] >= 0)
    order = number[sa[slots]]
    new = np.ones(len(slots), bool)
    if len(slots) > 1:
        # between two windows the smallest prefix on the way
        way = np.minimum.reduceat(lcp, slots[:-1] + 1) if slots[-1] == len(sa) - 1 else np.minimum.reduceat(lcp, np.append(slots[:-1] + 1, slots[-1] + 1))[:-1]
        new[1:] = way < width
    group = np.cumsum(new) - 1
    return order, group, np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)


def _rows_of(text: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Windows as whole numbers that compare as their bytes do, eight at a time (the last eight overlap)."""
    eight = loads(text)
    offs = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    return [eight[at + o].byteswap() for o in offs]


def lower_bound(hay: list[np.ndarray], needles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of windows in sorted ones, all at once: where each belongs, and whether it is there."""
    n, m = len(hay[0]), len(needles[0])
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) >> 1
        less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for h, x in zip(hay, needles, strict=True):
            a, b = h[mid], x[open_]
            less |= equal & (a < b)
            equal &= a == b
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    at = np.minimum(lo, max(n - 1, 0))
    found = lo < n
    for h, x in zip(hay, needles, strict=True):
        found = found & (h[at] == x) if n else found
    return lo, found


def shard_minimum(text: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int, array: int = ARRAY) -> np.ndarray:
    """The smallest document of each window of the strings (at begin, of size bytes, in doc) of a shard.

    Strings are dealt to suffix arrays of about `array` bytes; each array's
    distinct windows are looked up in every other's by binary search.
    """
    many = size - width + 1
    upto = np.cumsum(size)
    own = ((upto - size) // array).astype(np.int64)
    least = np.zeros(int(many.sum()), np.int64)
    out_at = np.cumsum(many) - many
    done = []
    for a in np.unique(own).tolist():
        i = np.flatnonzero(own == a)
        n, m = size[i], many[i]
        local = np.cumsum(n) - n
        piece = text[np.repeat(begin[i] - local, n) + np.arange(int(n.sum()))]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        at = np.repeat(local, m) + inner
        order, group, low = least_in_groups(piece, at, np.repeat(doc[i], m), width)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        done.append([np.repeat(out_at[i], m) + inner, order, group, low, None, (piece, at[order[first]])])
    if len(done) > 1:
        for d in done:
            d[4] = _rows_of(*d[5], width)
        for x in range(len(done)):
            for y in range(x + 1, len(done)):
                where, found = lower_bound(done[y][4], done[x][4])
                i, j = np.flatnonzero(found), where[found]
                low = np.minimum(done[x][3][i], done[y][3][j])
                done[x][3][i] = done[y][3][j] = low
    for place, order, group, low, _, _ in done:
        least[place[order]] = low[group]
    return least


# ---------------------------------------------------------------- steps


_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())])


def _others(t: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t.combine_chunks())
    return out.getvalue()


def _to_blocks(id_: str, text: str, width: int, gram: int):
    def run(batches):
        lean_memory()
        for serial, t in enumerate(grouped_batches(batches, text, BLOCK)):
            raw, start, length = utf8(t.column(text))
            ids = t.column(id_).combine_chunks().cast(pa.int64())
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            first, many, anchor, doc = _in_slices(raw, start, length, width, gram)
            if null.any():
                keep = ~null[doc]
                first, many, anchor = first[keep], many[keep], anchor[keep]
            gap = np.diff(first, prepend=0)
            payload = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), length.astype(np.int64), raw.tobytes(), _others(t.drop_columns([text])), gap.astype(np.uint32), many.astype(np.uint8), (anchor - first).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([block_number(serial)]), pa.array([len(raw)]), pa.array([payload], pa.binary())], schema=_BLOCKS_ARROW)

    return run


def _in_slices(raw, start, length, width, gram, most: int = SLICE):
    """runs() of some documents at a time: its arrays take sixty bytes for each byte of text. A longer document is cut."""
    out, lo = [], 0
    end = start + length
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + most, "right")))
        base = start[lo]
        if hi > lo + 1 or length[lo] <= most:
            f, m, a, d = runs(raw[base : end[hi - 1]], start[lo:hi] - base, length[lo:hi], width, gram)
            out.append((f + base, m, a + base, d + lo))
        else:
            for at in range(0, int(length[lo]), most):
                piece = raw[base + at : min(base + at + most + width - 1, end[lo])]
                f, m, a, d = runs(piece, np.zeros(1, np.int64), np.array([len(piece)]), width, gram)
                out.append((f + base + at, m, a + base + at, d + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


class Block:
    def __init__(self, payload: bytes, width: int, gram: int):
        self.ids, self.length, raw, self.others, gap, many, off = unpack(payload)
        self.raw = np.frombuffer(raw, np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.first = np.cumsum(gap.astype(np.int64))
        self.many = many.astype(np.int64)
        self.off = off.astype(np.int64)
        self.doc = owners(self.first, self.start + self.length)
        self.hash = span_hash(self.raw, self.first + self.off, gram)
        self.width, self.gram = width, gram

    def short(self) -> np.ndarray:
        return (self.hash >> np.uint64(32)).astype(np.uint32)

    def strings(self, flags: np.ndarray, shards: int) -> None:
        """Strings to send: of runs whose anchors other documents have, each distinct one of the block once.

        Sets where they start, their sizes, the gram's offset (255: a window on its
        own), shard, smallest document, and of every occurrence its string.
        """
        short = self.short()
        order = np.argsort(short)
        short = short[order]
        flag = np.zeros(len(short), np.uint8)
        if len(short):
            flag[order] = flags[np.cumsum(np.r_[False, short[1:] != short[:-1]])]
        warm, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        m = self.many[hot]
        each = np.repeat(self.first[hot], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        at = np.concatenate([self.first[warm], each])
        many = np.concatenate([self.many[warm], np.ones(len(each), np.int64)])
        off = np.concatenate([self.off[warm], np.full(len(each), 255)])
        doc = np.concatenate([self.doc[warm], np.repeat(self.doc[hot], m)])
        head = span_hash(self.raw, at, self.width)
        tail = span_hash(self.raw, at + many - 1, self.width, 1)
        key = np.concatenate([self.hash[warm], mixed(head[len(warm) :])])
        low = self.ids[doc]
        o = np.lexsort((low, many, tail, head))
        new = np.ones(len(o), bool)
        new[1:] = (head[o][1:] != head[o][:-1]) | (tail[o][1:] != tail[o][:-1]) | (many[o][1:] != many[o][:-1])
        lead = o[new]
        shard = (key[lead] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        string = np.empty(len(o), np.int64)
        string[o] = np.cumsum(new) - 1
        back = np.empty(len(lead), np.int64)
        back[order] = np.arange(len(lead))
        lead = lead[order]
        self.shard, self.lead_at, self.lead_many, self.lead_off, self.lead_low = shard[order], at[lead], many[lead], off[lead], low[lead]
        self.at, self.n, self.of_doc, self.string = at, many, doc, back[string]


_PART_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
_PART = "key long, block long, payload binary"


def _parts(rows: list[tuple]) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PART_ARROW, strict=True)], schema=_PART_ARROW)] if rows else []


def _anchors(width: int, gram: int, ranges: int):
    def run(batches):
        lean_memory()
        for batch in batches:
            for block, _, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(payload, width, gram)
                pair = b.short().astype(np.uint64) << np.uint64(32) | b.doc.astype(np.uint64)
                each = distinct(pair) >> np.uint64(32)
                kind = distinct(each)
                docs = np.diff(np.append(np.searchsorted(each, kind), len(each)))
                cut = np.searchsorted(kind * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                yield from _parts([(r, block, pack(np.diff(kind[cut[r] : cut[r + 1]].astype(np.int64), prepend=0).astype(np.uint32), np.minimum(docs[cut[r] : cut[r + 1]], 65535).astype(np.uint16))) for r in np.flatnonzero(np.diff(cut)).tolist()])

    return run


def _answers(hot: int):
    """Of a range of hashes: 0 for those in one document, 1 for more, 2 for very many."""

    def run(key, group):
        lean_memory()
        got = [unpack(p) for p in group.column("payload").to_pylist()]
        kinds = [np.cumsum(k.astype(np.int64)) for k, _ in got]
        every = np.concatenate(kinds)
        uniq = distinct(every)
        inverse = np.searchsorted(uniq, every)
        total = np.bincount(inverse, np.concatenate([n for _, n in got]), len(uniq))
        flag = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
        rows, at = [], 0
        for block, k in zip(group.column("block").to_pylist(), kinds, strict=True):
            rows.append((key[0].as_py(), block, pack(flag[inverse[at : at + len(k)]])))
            at += len(k)
        return pa.Table.from_batches(_parts(rows), _PART_ARROW)

    return run


def _opened(group: pa.Table, width: int, gram: int, shards: int) -> Block:
    """A block with its flags: the row with key -1 and the answers of the ranges, in order."""
    rows = sorted(zip(group.column("key").to_pylist(), group.column("payload").to_pylist(), strict=True), key=lambda r: r[0])
    b = Block(rows[0][1], width, gram)
    b.strings(np.concatenate([unpack(p)[0] for _, p in rows[1:]]) if len(rows) > 1 else np.zeros(0, np.uint8), shards)
    return b


def _to_shards(width: int, gram: int, shards: int):
    def run(key, group):
        lean_memory()
        b = _opened(group, width, gram, shards)
        cut = np.searchsorted(b.shard, np.arange(shards + 1))
        rows = []
        for q in np.flatnonzero(np.diff(cut)).tolist():
            c = slice(cut[q], cut[q + 1])
            n = b.lead_many[c] + width - 1
            text = b.raw[np.repeat(b.lead_at[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            rows.append((q, key[0].as_py(), pack(b.lead_many[c].astype(np.uint8), b.lead_off[c].astype(np.uint8), b.lead_low[c], text.tobytes())))
        return pa.Table.from_batches(_parts(rows), _PART_ARROW)

    return run


def _in_shard(width: int, gram: int, array: int):
    def run(key, group):
        lean_memory()
        got = [unpack(p) for p in group.column("payload").to_pylist()]
        many = np.concatenate([g[0] for g in got]).astype(np.int64)
        off = np.concatenate([g[1] for g in got]).astype(np.int64)
        low = np.concatenate([g[2] for g in got])
        text = np.frombuffer(b"".join(g[3] for g in got), np.uint8)
        size = many + width - 1
        begin = np.cumsum(size) - size
        # equal strings of several blocks are one, with the smallest document
        head, tail = span_hash(text, begin, width), span_hash(text, begin + many - 1, width, 1)
        o = np.lexsort((many, tail, head))
        new = np.ones(len(o), bool)
        new[1:] = (head[o][1:] != head[o][:-1]) | (tail[o][1:] != tail[o][:-1]) | (many[o][1:] != many[o][:-1])
        lead = o[new]
        string = np.empty(len(o), np.int64)
        string[o] = np.cumsum(new) - 1
        least = np.minimum.reduceat(low[o], np.flatnonzero(new))
        # a string alone with its anchor has no other windows to meet
        alone = off[lead] == 255
        anchor = np.where(alone, head[lead], span_hash(text, begin[lead] + np.where(alone, 0, off[lead]), gram))
        in_order = np.sort(anchor)
        meet = np.searchsorted(in_order, anchor, "right") - np.searchsorted(in_order, anchor, "left") > 1
        m = many[lead]
        at = np.cumsum(m) - m
        answer = np.repeat(least, m)
        if meet.any():
            i = np.flatnonzero(meet)
            got_least = shard_minimum(text, begin[lead[i]], size[lead[i]], least[i], width, array)
            inner = np.repeat(at[i], m[i]) + np.arange(int(m[i].sum())) - np.repeat(np.cumsum(m[i]) - m[i], m[i])
            answer[inner] = got_least
        rows, done = [], 0
        for block, g in zip(group.column("block").to_pylist(), got, strict=True):
            own = string[done : done + len(g[0])]
            done += len(g[0])
            n = m[own]
            value = answer[np.repeat(at[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            rows.append((key[0].as_py(), block, pack(value)))
        return pa.Table.from_batches(_parts(rows), _PART_ARROW)

    return run


def covered(size: int, at: np.ndarray, width: int) -> np.ndarray:
    """Flags of the bytes covered by windows that start at the given places, each given once."""
    edge = np.zeros(size + width, np.int16)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:size], dtype=np.int16) > 0


def _removed(width: int, gram: int, shards: int, schema: pa.Schema):
    def run(key, group, answers):
        lean_memory()
        b = _opened(group, width, gram, shards)
        parts = sorted(zip(answers.column("key").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        least = np.concatenate([unpack(p)[0] for _, p in parts]) if parts else np.zeros(0, np.int64)
        at = np.cumsum(b.lead_many) - b.lead_many
        place = np.arange(int(b.n.sum())) - np.repeat(np.cumsum(b.n) - b.n, b.n)
        found = least[np.repeat(at[b.string], b.n) + place]
        gone = found < np.repeat(b.ids[b.of_doc], b.n)
        off = covered(len(b.raw), (np.repeat(b.at, b.n) + place)[gone], width)
        before = np.append(0, np.cumsum(off))
        end = b.start + b.length
        removed = before[end] - before[b.start]
        step = off & np.r_[True, ~off[:-1]] if len(off) else off
        step[b.start[b.length > 0]] = off[b.start[b.length > 0]]
        spans = np.append(0, np.cumsum(step))
        spans = spans[end] - spans[b.start]
        kept = ~off
        digests, texts = [], []
        for i, (s, e, r) in enumerate(zip(b.start.tolist(), end.tolist(), removed.tolist(), strict=True)):
            part = b.raw[s:e]
            digests.append(hashlib.sha256(part[kept[s:e]].tobytes() if r else part.tobytes()).hexdigest())
            if not r:
                texts.append(part.tobytes().decode())
                continue
            # a character that is removed in part stays whole
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            whole = np.logical_or.reduceat(kept[s:e], lead)
            texts.append(part[np.repeat(whole, np.diff(np.append(lead, e - s)))].tobytes().decode())
        t = pa.ipc.open_stream(b.others).read_all()
        more = [pa.array(texts, pa.string()), pa.array(b.length), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())]
        keep = len(schema) - len(more)  # the columns of the input that stay come first
        return pa.table([t.column(f.name).cast(f.type) for f in list(schema)[:keep]] + more, schema=schema)

    return run


#: The columns that are added: the text that remains, its bytes before, bytes removed, removed runs, digest of the remaining bytes.
ADDED = ("kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup_substrings(docs: DataFrame, width: int = 50, gram: int = 26, id_: str = "doc_id", text: str = "text", hot: int = HOT, shard: int = SHARD, array: int = ARRAY, added: tuple[str, ...] = ADDED) -> DataFrame:
    """The columns of docs without the text, and those of `added`: a row for each.

    kept_sha256 is of the remaining bytes; kept_text leaves whole any character
    that is removed in part. A null text is empty. Rows without an id are neither
    searched nor found. Rows that repeat an id aren't earlier than each other.
    Other columns stay as they are, but one with a name of `added` gives way to
    the new column; choose other names to keep it. No rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    if not 9 <= gram < width <= 255:
        raise ValueError("9 <= gram < width <= 255")
    scratch = Scratch(spark, "substrings")
    rows = docs.drop(*(c for c in added if c not in (id_, text))).withColumn(text, F.col(text).cast("string")).withColumn(id_, F.col(id_).cast("long"))
    blocks = scratch.write(rows.mapInArrow(_to_blocks(id_, text, width, gram), "block long, size long, payload binary"), "blocks")
    total = int(blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0])
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard))
    ranges = max(spark.sparkContext.defaultParallelism, -(-total // (4 * shard)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(spark, total, TASK))
    flags = blocks.mapInArrow(_anchors(width, gram, ranges), _PART).repartition(tasks, "key").groupBy("key").applyInArrow(_answers(hot), _PART)
    flags = scratch.write(flags, "flags")
    both = blocks.select(F.lit(-1).cast("long").alias("key"), "block", "payload").unionAll(flags)
    both = both.repartition(tasks, "block")
    strings = both.groupBy("block").applyInArrow(_to_shards(width, gram, shards), _PART)
    least = strings.repartition(tasks, "key").groupBy("key").applyInArrow(_in_shard(width, gram, array), _PART)
    kept = rows.drop(text).schema
    kinds = ("string", "long", "long", "long", "string")
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` {k}" for c, k in zip(added, kinds, strict=True)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = pa.schema([*to_arrow_schema(kept), *((c, pa.string() if k == "string" else pa.int64()) for c, k in zip(added, kinds, strict=True))])
    return both.groupBy("block").cogroup(least.repartition(tasks, "block").groupBy("block")).applyInArrow(_removed(width, gram, shards, arrow), out)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that smaller ids have too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
