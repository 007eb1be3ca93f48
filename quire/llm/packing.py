"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths.

A document of n tokens gives n // max_len pieces of max_len tokens and then one
piece for each set bit of the rest, longest first. Each piece is a sequence of
its own (offset 0), so no sequence crosses documents and none is padded; equal
lengths share a bucket, and a batch is drawn from one bucket.

No row is shuffled: each task tokenizes and cuts the documents that it reads.
"""

from __future__ import annotations

import importlib.util
import os
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_batches, utf8, word_hashes, words

#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 600_000
# Kinds of bytes for words that need no care: other signs, letters (ASCII, and the Latin letters whose UTF-8 starts
# with C3), digits; 3 marks bytes whose words are encoded one by one.
_KIND = np.full(256, 3, np.uint8)
_KIND[0x21:0x7F] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[48:58] = 2
_KIND[[0x27, 0x3C]] = 3


class WordEncoder:
    """Ids of whole texts from the ids of their words.

    Right only for tokenizers that drop white space, never join across it and mark
    the last id of each pre-token by </w>. Each distinct word is encoded once
    while it is remembered; plain words are encoded many at a time, and told
    apart by the count of their pre-tokens (runs of letters, single digits, runs
    of other signs).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([y for x in got for y in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _plain(self, texts: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Of words joined by spaces in texts, whose pre-tokens are counted; None if the counts don't add up."""
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids])
        upto = np.cumsum(count)
        if len(ends) != upto[-1] or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends[upto - 1] + 1, prepend=0)

    def _words(self, low: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        size = n + 1
        begin = np.cumsum(size) - size
        raw = np.full(int(size.sum()), 32, np.uint8)
        inner = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        raw[inner] = low[inner - np.repeat(begin, n) + np.repeat(s, n)]
        kind = _KIND[raw]
        kind[begin + n] = 0
        odd = (raw[1:] == 0x97) | (raw[1:] == 0xB7)  # C3 97 and C3 B7 are signs, not letters
        kind[np.flatnonzero(odd & (raw[:-1] == 0xC3))] = 3
        care = np.maximum.reduceat(kind, begin) == 3
        new = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
        new[begin] = True
        new[begin + n] = False
        count = np.add.reduceat(new.astype(np.int64), begin)
        text = lambda i, j: raw[begin[i] : begin[j - 1] + n[j - 1]].tobytes().decode("utf-8", "replace")
        if care.any():
            order = np.argsort(care, kind="stable")
            cut = len(care) - int(care.sum())
            a_ids, a_size = self._words(low, s[order[:cut]], n[order[:cut]]) if cut else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            b_ids, b_size = self._each([text(i, i + 1) for i in order[cut:].tolist()])
            ids, size = np.concatenate([a_ids, b_ids]), np.concatenate([a_size, b_size])
            at = np.cumsum(size) - size
            back = np.argsort(order)
            size = size[back]
            return ids[np.repeat(at[back] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size
        ids, sizes = [], []
        for lo in range(0, len(s), 65_536):
            hi = min(lo + 65_536, len(s))
            got = self._plain([text(i, min(i + 256, hi)) for i in range(lo, hi, 256)], count[lo:hi])
            got = got or self._each([text(i, i + 1) for i in range(lo, hi)])
            ids.append(got[0])
            sizes.append(got[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an `end` after each document; and how many each document has."""
        low, s, n, doc = words(raw, start, length, lower=False)
        code, uniq = pd.factorize(word_hashes(low, s, n))
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, uniq)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~known)
        slot = np.zeros(len(uniq), np.int64)
        slot[known] = self.slot[at[known]]
        if len(new):
            first = np.zeros(len(uniq), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            ids, size = self._words(low, s[first[new]], n[first[new]])
            slot[new] = len(self.start) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            keys, slots = np.concatenate([self.keys, uniq[new]]), np.concatenate([self.slot, slot[new]])
            order = np.argsort(keys)
            self.keys, self.slot = keys[order], slots[order]
        begin, size = self.start[slot][code], self.size[slot][code]
        before = np.cumsum(size) - size
        tokens = self.ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
        per_doc = np.bincount(doc, size, len(start)).astype(np.int64) + 1
        out = np.full(int(per_doc.sum()), end, np.uint32)
        out[np.arange(len(tokens)) + np.repeat(doc, size)] = tokens
        return out, per_doc


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each worker process, which keeps it from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces, in the order of documents and starts. max_len is a power of two."""
    full = n // max_len
    doc = [np.repeat(np.arange(len(n)), full)]
    start = [(np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)) * max_len]
    size = [np.full(int(full.sum()), max_len)]
    for bit in range(max_len.bit_length() - 2, -1, -1):
        has = np.flatnonzero(n >> bit & 1)
        doc.append(has)
        start.append(n[has] >> (bit + 1) << (bit + 1))
        size.append(np.full(len(has), 1 << bit))
    doc, start, size = (np.concatenate(x).astype(np.int64) for x in (doc, start, size))
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 2048, end: int = 1, id_: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and (with_ids) the ids.

    A null or empty text is the one piece [end]. Repeated rows are packed each
    for itself; a null id stays null; other columns are ignored. sequence_id
    holds the bucket (log2 of the length) in its high bits, then task and number.
    Without rows the result is empty.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        from pyspark import TaskContext

        task, serial, encode = TaskContext.get().partitionId() << 32, 0, None
        for t in grouped_batches(batches, "text", 4 << 20):
            encode = encode or _encoder(tokenizer)
            ids, n = encode(*utf8(t.column("text")), end)
            doc, start, size = pieces(n, max_len)
            at = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64, len(at))
            bucket = np.log2(size).astype(np.int32)
            sequence = bucket.astype(np.int64) << 56 | task | np.arange(serial, serial + len(at))
            serial += len(at)
            own = t.column("id").combine_chunks()
            for lo in range(0, len(at), 20_000):
                c = slice(lo, lo + 20_000)
                cols = [own.take(pa.array(doc[c])), pa.array(start[c]), pa.array(size[c]), pa.array(crc[c]), pa.array(n[doc[c]]), pa.array(sequence[c]), pa.array(np.zeros(len(at[c]), np.int64)), pa.array(bucket[c])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at[c] - at[c][:1], at[c][-1:] + size[c][-1:] - at[c][:1]).astype(np.int32)), pa.array(ids[at[c][0] : at[c][-1] + size[c][-1]].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    spark_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, spark_schema)


def public_tokenizer(name: str, folder: str = "/opt/tokenizers") -> str:
    """The path that the module in the folder of public tokenizers gives for a file."""
    module = sys.modules.get("public_tokenizers")
    if module is None:
        try:
            import public_tokenizers as module
        except ImportError:
            spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
    return str(module.path(name))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in power-of-two pieces of at most 2048 ids of the 49k word tokenizer."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("word_bpe_49k.json"), with_ids=False)
