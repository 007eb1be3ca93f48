"""Near-duplicate embeddings: int8 tile products with error bounds, full precision only where the bound leaves doubt.

A unit vector x is stored as s * q with int8 q, and e(x) is the length of what
that loses. For any two vectors

    |x.y - s s' q.q'| <= e(x) + (1 + e(x)) * e(y)

so a pair whose int8 product is below threshold - bound is no link, and only the
others are multiplied again in double precision from the given components. int8
products are taken as float32 matrix products of whole numbers, which are exact
up to 1,024 components at a time.

Vectors are dealt into tiles: by the nearest of a bounded sample of pivots, and
within one pivot by hash into tiles of at most about `tile` rows. A pair of
tiles whose cones (centre and widest angle) lie farther apart than the
threshold is skipped; every other pair is one task's work. The cones are
compared in groups, pair of groups by pair of groups, and which pairs of tiles are
left is a table as well: the driver only knows how many tiles there are. Links are never
listed: a task returns a count for each row and, as edges, one spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, mixed, pack, unpack

#: Tiles whose cones are compared as a group.
GROUP = 512
_SLACK = 1e-9  # rounding of the bounds themselves, far above what doubles lose


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32), scale and error length of unit vectors (double)."""
    scale = np.maximum(np.abs(x).max(1, initial=0), 1e-300) / 127
    q = np.rint(x / scale[:, None])
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
    return q.astype(np.float32), scale, error + _SLACK


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    if a.shape[1] <= 1024:
        return a @ b.T
    return sum((a[:, i : i + 1024] @ b[:, i : i + 1024].T).astype(np.float64) for i in range(0, a.shape[1], 1024))


def _in_range(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would over- or underflow, times a power of two, which changes no digit of a cosine."""
    top = np.abs(x).max(1, initial=0)
    off = np.flatnonzero((top > 1e100) | (top < 1e-100))
    if len(off):
        x = x.copy()
        x[off] = np.ldexp(x[off], -np.frexp(top[off])[1][:, None])
    return x


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index) after adding the edges a-b."""
    while True:
        x, y = label[a], label[b]
        off = x != y
        if not off.any():
            return label
        a, b, x, y = a[off], b[off], x[off], y[off]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within x, or between x and y (rows of any length but zero): counts of x's and y's rows, and labels over both."""
    same = y is None
    both = _in_range(x if same else np.concatenate([x, y]))
    norm = np.sqrt((both * both).sum(1))
    q, s, e = quantised(both / norm[:, None])
    n, m = len(x), len(both)
    lo = 0 if same else n
    count, label = np.zeros(m, np.int64), np.arange(m)
    if m == lo or not n:
        return count[:n], count[n:], label
    widest, longest = e[lo:].max(), s[lo:].max()
    for i in range(0, n, block):
        j = min(i + block, n)
        first = i if same else lo
        p = product(q[i:j], q[first:])
        least = threshold - e[i:j] - (1 + e[i:j]) * widest
        limit = np.where(least > 0, least / (s[i:j] * longest) * (1 - 1e-6), -np.inf)
        r, c = np.nonzero(p >= limit[:, None].astype(p.dtype))
        value = p[r, c].astype(np.float64)
        r, c = r + i, c + first
        keep = value * s[r] * s[c] >= threshold - e[r] - (1 + e[r]) * e[c]
        if same:
            keep &= c > r
        r, c = r[keep], c[keep]
        for k in range(0, len(r), 200_000):
            a, b = r[k : k + 200_000], c[k : k + 200_000]
            cos = np.einsum("ij,ij->i", both[a], both[b]) / (norm[a] * norm[b])
            ok = cos >= threshold
            a, b = a[ok], b[ok]
            count += np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
            label = _joined(label, a, b)
    return count[:n], count[n:], label


def _valid(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles, sizes and validity of a list column: null, empty, zero and non-finite vectors are not valid."""
    size = np.nan_to_num(np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], float)).astype(np.int64)
    flat = np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    start = np.cumsum(size) - size
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    some = np.append(0, np.cumsum(flat != 0))
    return flat, size, (bad[start + size] == bad[start]) & (some[start + size] > some[start])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = 8192, pivots: int = 64, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector.

    Rows of different numbers of components never link. A vector that is null or
    zero or has a null or non-finite component links with nothing; its row says
    n_links 0 and its own id. A repeated id is one node with a row for each
    occurrence, which link as their vectors say; a null id has no component.
    Other columns are ignored; no rows give no rows. threshold is above 0.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = scratch.write(vectors.select(F.col(id_).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(embedding).cast("array<double>").alias("x")), "vectors")
    fine = rows.where(F.expr("size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)"))
    # the rows with the smallest hashes are the pivots: a bounded sample
    chosen = [np.array(r["x"]) for r in fine.orderBy(F.xxhash64("row"), "row").limit(pivots).select("x").collect()]
    unit = [(p := _in_range(c[None])[0]) / np.sqrt(p @ p) for c in chosen]
    by_size = {d: np.stack([p for p in unit if len(p) == d]) for d in {len(p) for p in unit}}

    def place(batches):
        for b in batches:
            flat, size, ok = _valid(b.column(2))
            start = np.cumsum(size) - size
            near = np.zeros(len(size), np.int32)
            for d in np.unique(size[ok]).tolist():
                if d in by_size:
                    own = np.flatnonzero(ok & (size == d))
                    near[own] = (_in_range(flat[start[own][:, None] + np.arange(d)]) @ by_size[d].T).argmax(1)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), b.column(2).take(pa.array(keep)), pa.array(size[keep].astype(np.int32)), pa.array(near[keep])], names=["vec_id", "row", "x", "d", "near"])

    placed = fine.mapInArrow(place, "vec_id long, row long, x array<double>, d int, near int")
    sizes = {(r["d"], r["near"]): r["n"] for r in placed.groupBy("d", "near").agg(F.count("*").alias("n")).collect()}
    # small groups share a tile, large ones are cut by hash
    tiles: dict[tuple[int, int], tuple[int, int]] = {}
    at, room, last = 0, 0, None
    for (d, p), n in sorted(sizes.items()):
        ways = -(-n // tile)
        if ways > 1 or d != last or n > room:
            tiles[d, p] = (at, ways)
            at, room, last = at + ways, tile - n if ways == 1 else 0, d
        else:
            tiles[d, p] = (at - 1, 1)
            room -= n
    if not at:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))

    def dealt(batches):
        for b in batches:
            first = np.array([tiles[k][0] for k in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)], np.int64)
            ways = np.array([tiles[k][1] for k in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)], np.uint64)
            own = first + (mixed(b.column(1).to_numpy().astype(np.uint64)) % ways).astype(np.int64)
            ids, null = b.column(0).fill_null(0).to_numpy(), np.asarray(b.column(0).is_null().to_numpy(zero_copy_only=False))
            x = b.column(2)
            for t in np.unique(own).tolist():
                mine = np.flatnonzero(own == t)
                v = np.asarray(x.take(pa.array(mine)).flatten()).reshape(len(mine), -1)
                narrow = v.astype(np.float32)
                body = pack(ids[mine], null[mine].astype(np.uint8), b.column(1).to_numpy()[mine], (narrow if (narrow == v).all() else v).reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([body], pa.binary())], names=["tile", "d", "payload"])

    blocks = scratch.write(placed.mapInArrow(dealt, "tile int, d int, payload binary"), "tiles")

    def cone(key, group):
        v = np.concatenate([unpack(p)[3].astype(np.float64).reshape(-1, d) for p, d in zip(group.column("payload").to_pylist(), group.column("d").to_pylist(), strict=True)])
        v = _in_range(v)
        v = v / np.sqrt((v * v).sum(1))[:, None]
        c = v.sum(0)
        length = math.sqrt(c @ c)
        c = c / length if length > 0 else v[0]
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([c.tolist()]), "angle": pa.array([float(np.arccos(np.clip((v @ c).min(), -1, 1)))])})

    cones = scratch.write(blocks.groupBy("tile").applyInArrow(cone, "tile int, c array<double>, angle double"), "cones")
    reach = math.acos(min(threshold, 1.0)) + 1e-7
    groups = -(-at // GROUP)

    def facing(key, group):
        t, angle = group.column("tile").to_numpy(), group.column("angle").to_numpy()
        left, same = group.column("side").to_numpy() == 0, key[0].as_py() == key[1].as_py()
        c = group.column("c").to_pylist()
        size = np.array([len(x) for x in c])
        out = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for d in np.unique(size).tolist():
            one = np.flatnonzero((size == d) & left)
            two = one if same else np.flatnonzero((size == d) & ~left)
            if len(one) and len(two):
                x, y = (np.array([c[i] for i in rows]) for rows in (one, two))
                i, j = np.nonzero(np.arccos(np.clip(x @ y.T, -1, 1)) - angle[one][:, None] - angle[two] <= reach)
                a, b = t[one[i]], t[two[j]]
                keep = a <= b if same else np.ones(len(a), bool)
                out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["t", "u"])

    # every group of cones meets itself and each later one
    own = F.floor(F.col("tile") / GROUP).cast("int")
    met = cones.withColumn("g", own).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = met.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), F.when(F.col("g") <= F.col("h"), 0).otherwise(1).alias("side"), "tile", "c", "angle")
    pairs = scratch.write(met.groupBy("g", "h").applyInArrow(facing, "t int, u int"), "pairs")
    cells = pairs.select(F.col("t").alias("tile"), "t", "u", F.lit(0).alias("side")).unionAll(pairs.where("t <> u").select("u", "t", "u", F.lit(1)))
    few = pairs.count() <= 500_000  # 16 bytes for each of its two cells

    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def links(key, group):
        side = {0: [], 1: []}
        for s, d, p in zip(*(group.column(c).to_pylist() for c in ("side", "d", "payload")), strict=True):
            ids, null, row, v = unpack(p)
            side[s].append((ids, null, row, v.astype(np.float64).reshape(-1, d)))
        cat = lambda s, i: np.concatenate([x[i] for x in side[s]])
        x = cat(0, 3)
        nx, ny, label = tile_links(x, cat(1, 3) if side[1] else None, threshold)
        every = [0, 1] if side[1] else [0]
        ids, null, row = (np.concatenate([cat(s, i) for s in every]) for i in range(3))
        n = np.concatenate([nx, ny])
        has = np.flatnonzero(n)
        up = label[has]
        void = (null[has] | null[up]).astype(bool) | (ids[has] == ids[up])
        return pa.table([pa.array(row[has]), pa.array(n[has]), pa.array(ids[has], mask=void), pa.array(ids[up], mask=void)], schema=schema)

    sent = blocks.join(F.broadcast(cells) if few else cells, "tile").select("t", "u", "side", "d", "payload")
    found = sent.groupBy("t", "u").applyInArrow(links, "row long, n long, a long, b long")
    found = scratch.write(found, "links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    parts = components(found.select("a", "b"), scratch)
    out = rows.select("vec_id", "row").join(counts, "row", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with a cosine of 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
