from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import docs, edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
V = byte_bpe.vocabulary(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'''stmdrvle  \n\t　\x1c\x85aZé1٣!?-ß中😀", max_size=40), min_size=1, max_size=5))
def test_matches_the_library_and_round_trips(texts):
    for text, ids in zip(texts, V.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert V.decode(ids, V.offsets(ids)).decode() == text


def test_scan_does_not_depend_on_the_block():
    c = np.random.default_rng(0).integers(0, byte_bpe.CLASSES, 3000)
    for block in (1, 7, 256, 4096):
        assert (byte_bpe.states_of(c, block) == byte_bpe.states_of(c, 64)).all()


@pytest.mark.parametrize("piece", [b"a" * 3000, bytes(range(256)) * 4, b" " * 500])
def test_long_pieces_merge_alike(piece):
    assert byte_bpe.merged_by_heap(piece, V.ranks) == byte_bpe.merged(piece, V.ranks) == LIBRARY._encode_single_piece(piece)
    short = piece[:150]
    assert byte_bpe.merged(short, V.ranks) == byte_bpe.merged_by_heap(short, V.ranks)


def test_query_form(spark):
    df = docs(spark, edge_rows())
    for r in byte_bpe.round_trip(df, PATH).collect():
        text = dict(edge_rows())[r.doc_id] or ""
        want = LIBRARY.encode_ordinary(text)
        assert bytes(r.ids_le) == np.array(want, "<u4").tobytes() and r.n_tokens == len(want)
        assert hashlib.sha256(bytes(r.decoded)).digest() == hashlib.sha256(text.encode()).digest()
    assert byte_bpe.round_trip(df.where("false"), PATH).count() == 0


def test_encode_then_decode(spark):
    out = byte_bpe.decode(byte_bpe.encode(docs(spark, edge_rows()), PATH), PATH)
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in out.collect()) == sorted((i, t or "") for i, t in edge_rows())


def test_ids_of_text_and_null_ids(spark):
    df = spark.createDataFrame([("a", "one two", 1), (None, None, 2), ("a", "one two", 3)], "doc_id string, text string, n_tokens int")
    got = byte_bpe.round_trip(df, PATH).collect()
    assert sorted((r.doc_id or "", r.n_tokens) for r in got) == [("", 0), ("a", 2), ("a", 2)]
