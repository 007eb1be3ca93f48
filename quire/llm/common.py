"""What the operators of this package share: scratch tables, blocks of texts, tokens as numbers, components.

A *block* is some megabytes of whole documents that travel as one row with a
compressed payload. Operators that have to bring facts of the whole corpus
back to each text shuffle a block once, next to the facts, instead of
shuffling one row per token.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20


# ---------------------------------------------------------------- scratch


class Scratch:
    """Tables in the shared folder that the cluster names in spark.checkpoint.dir.

    A table written here cuts lineage and survives the loss of executors. Where
    the setting is unset and the master is local (tests, one machine), a temporary
    folder is made and kept as the setting of this session; on a cluster, whose
    machines don't share one, that is an error. Results may still read the tables,
    so what drop() doesn't delete goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(self.root), spark._jsc.hadoopConfiguration()
        files = path.getFileSystem(conf)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def write(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{t}")
            path.getFileSystem(conf).delete(path, True)


def partitions_for(spark: SparkSession, rows: float, per_task: float) -> int:
    """Shuffle partitions that hold about per_task rows each."""
    return max(spark.sparkContext.defaultParallelism, int(-(-rows // per_task)), 1)


_LIBC: list = []


def lean_memory(threshold: int = 2 << 20) -> None:
    """Called as a task begins: gives back what earlier tasks of this worker have freed, and keeps it so.

    The C library raises its bound for returning arrays as it goes and holds on to
    what is below; a worker that is reused from stage to stage would keep the
    most that any of them took.
    """
    if not _LIBC:
        import ctypes

        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, threshold)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, threshold)  # M_TRIM_THRESHOLD
            _LIBC.append(libc.malloc_trim)
        except (AttributeError, OSError):  # another C library
            _LIBC.append(lambda _: None)
    pa.default_memory_pool().release_unused()
    _LIBC[0](0)


# ---------------------------------------------------------------- payloads

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed string; integers as planes of bytes, which compress better."""
    parts, head = [], [len(arrays)]
    for a in arrays:
        if isinstance(a, np.ndarray):
            kind = a.dtype
            raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes() if kind.itemsize > 1 else a.tobytes()
            head += [{"i": 1, "u": 2, "f": 3, "b": 4}[kind.kind] * 16 + kind.itemsize, len(raw)]
        else:
            raw = bytes(a)
            head += [0, len(raw)]
        parts.append(raw)
    return _pack.compress(np.array(head, "<i8").tobytes() + b"".join(parts))


def unpack(payload: bytes) -> list:
    raw = _unpack.decompress(payload)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        part = memoryview(raw)[at : at + size]
        at += size
        if not kind:
            out.append(bytes(part))
            continue
        width, letter = kind % 16, " iufb"[kind // 16]
        flat = np.frombuffer(part, np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(f"{letter}{width}") if width > 1 else flat.view(f"{letter}1"))
    return out


# ---------------------------------------------------------------- texts and tokens


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start offsets and lengths of a string column; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off[:-1] - off[0], np.diff(off)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Fixed odd multipliers of the hash of a word (any would do).
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    for m, s in ((_M1, 32), (_M3, 29), (_M2, 32)):
        h ^= h >> np.uint64(s)
        h *= m
    h ^= h >> np.uint64(31)
    return h


def words(raw: np.ndarray, start: np.ndarray, length: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ of documents that lie one after the other in raw.

    Returns the lower-cased bytes (unchanged ones without lower), and of each word its start, length and document.
    """
    low = _LOWER[raw] if lower else raw
    inside = np.ones(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_SPACE[raw]
    begin = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    at = start[length > 0]
    begin[at] = inside[1:-1][at]  # a document starts a word of its own
    ends = (start + length - 1)[length > 0]
    finish[ends] = inside[1:-1][ends]
    s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    doc = np.repeat(np.arange(len(start)), np.diff(np.searchsorted(s, np.append(start, len(raw))))) if len(start) else np.zeros(0, np.int64)
    return low, s, e - s, doc


def word_hashes(low: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: words of eight bytes at a time, all words at once."""
    padded = np.zeros(len(low) + 16, np.uint8)
    padded[: len(low)] = low
    eight = np.lib.stride_tricks.as_strided(padded, (len(low) + 8, 8), (1, 1))
    h = mixed(n.astype(np.uint64) * _M2)
    todo, at = np.arange(len(s)), s
    left = n.copy()
    while len(todo):
        take = np.minimum(left, 8)
        key = np.ascontiguousarray(eight[at]).view("<u8").reshape(-1)
        key &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - take).astype(np.uint64) * np.uint64(8))
        x = (h[todo] ^ key) * _M1
        h[todo] = (x ^ (x >> np.uint64(29))) * _M3
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return mixed(h)


def grouped_batches(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches put together to tables of about limit bytes of text; a larger batch is cut between documents."""
    lean_memory()
    held, size = [], 0
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at = 0
        total = np.cumsum(lengths)
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            upto = int(np.searchsorted(total, done + limit - size, "right"))
            upto = min(max(upto, at + (not held)), b.num_rows)
            if upto > at:
                held.append(b.slice(at, upto - at))
                size += int(total[upto - 1] - done)
                at = upto
            if at < b.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def block_number(serial: int) -> int:
    """A number for this task's next block; no other task's block has it."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | serial


# ---------------------------------------------------------------- hot keys and components


def hot_limit(rows: float) -> int:
    """Rows above which a key counts as hot: at most 100,000 keys are."""
    return max(1_000, int(rows // 100_000))


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, limit: int, how: str = "inner") -> DataFrame:
    """big joined with small, whose keys are unique and whose column weight says how many rows of big have the key.

    Keys above the limit (of hot_limit, so no more than 100,000) are broadcast, so
    their rows stay where they are; only the others are shuffled. how: inner or left.
    A null key of big meets nothing. weight is left out of the result.
    """
    hot = small.where(F.col(weight) > limit).drop(weight).withColumn("_hot", F.lit(True))
    cold = small.where(F.col(weight) <= limit).drop(weight)
    tried = big.join(F.broadcast(hot), key, "left")
    found = tried.where("_hot").drop("_hot")
    left = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    if how == "inner":
        return found.unionByName(left.join(cold, key))
    loose = left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in cold.schema if f.name != key))
    return found.unionByName(left.where(F.col(key).isNotNull()).join(cold, key, "left")).unionByName(loose)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for every node on an edge.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing
    changes; each round is written to the shared folder, so neither lineage nor
    the driver grows. A node's neighbours are never gathered: both stars are a
    minimum per node (aggregated before the shuffle) and a join back, in which a
    node with very many neighbours is broadcast. Null ends and loops are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, was, rnd = scratch.write(e, f"{name}0"), None, 0

    def back(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        limit = hot_limit(n)
        return join_hot(rows, least, "u", "n", limit) if n > limit else rows.join(least.drop("n"), "u")

    while True:
        stamp = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if stamp == was:
            break
        was = stamp
        turned = cur.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = cur.select("u", "v").unionAll(turned).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = back(turned, least, stamp[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where("u <> v").distinct(), f"{name}{rnd}L")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = back(large, least, stamp[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = scratch.write(small.where("u <> v").distinct(), f"{name}{rnd + 1}")
        scratch.drop(f"{name}{rnd}", f"{name}{rnd}L")
        cur, rnd = nxt, rnd + 1
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
