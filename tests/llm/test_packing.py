from __future__ import annotations

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing as P
from quire.llm.common import utf8

tokenizers = pytest.importorskip("tokenizers")
PATH = P.public_tokenizer("word_bpe_49k.json")
TEXTS = ["Hello, world!", "", None, "don't <|endoftext|> STOP  3.14 café ÷×", "word " * 3000, "x" * 5000, "日本語 текст ΑΣ ΑΣ", "a\x0bb\x1cc d", "Hello, world!"]


def plain(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, n = P._encoder(PATH)(*utf8(pa.array(texts, pa.string())), 1)
    assert ids.tolist() == [i for t in texts for i in plain(t)] and n.tolist() == [len(plain(t)) for t in texts]


@given(st.lists(st.integers(1, 9000), min_size=1, max_size=20))
def test_pieces_tile_each_document_with_powers_of_two(sizes):
    doc, start, size = P.pieces(np.array(sizes), 2048)
    for d, n in enumerate(sizes):
        own = [(s, z) for x, s, z in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True) if x == d]
        assert sum(z for _, z in own) == n and all(z & (z - 1) == 0 and z <= 2048 for _, z in own)
        assert [s for s, _ in own] == np.cumsum([0, *(z for _, z in own)])[:-1].tolist()


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as start", "1 as ids").repartition(3)
    got = P.pack_documents(docs, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket == len(r.ids) for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        copies = sum(x == i for x, _ in rows)
        own = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(plain(t)) and {r.doc_tokens for r in own} == {len(plain(t))}
        assert [y for r in own[::copies] for y in r.ids] == plain(t)
    assert P.pack_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        P.pack_documents(docs, PATH, max_len=1000)
