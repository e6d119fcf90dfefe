from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import docs, edge_rows, prose

from tidewright.llm import token_files as f
from tidewright.llm.queries import rank_file

WORD, BYTES = rank_file("word_bpe_49k.json"), rank_file("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ROWS = [*edge_rows(), (None, "no id"), (None, None), (11, "in\x1cside\x0b and\ttabs\r\nlines here there 0 10 a0b 00"), (-3, "<|endoftext|> Ünïcödé ﬁ ΣΑΣ ΣΑΣ. don't"), (12, "x" * 70 + " " + "0" * 70), (13, "  two  spaces \n\n")]


@pytest.mark.parametrize(("path", "dtype", "by_words"), [(WORD, "uint16", True), (WORD, "uint32", False), (BYTES, "uint16", False)])
def test_files_against_the_library(spark, tmp_path, path, dtype, by_words):
    """Nulls first, repeated ids together, every text whole, offsets of several files."""
    rows = ROWS + [(i, prose(i, 40)) for i in range(100, 180)]
    df = docs(spark, rows).repartition(7)
    folder = str(tmp_path / "out")
    n = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = f.encode(df, folder, path, dtype=dtype, by_words=by_words)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n)
    of = library(path)
    got = sorted(f.rows_of(spark, folder, with_ids=True, rows=9).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(of(t) + [1])
    assert {i: sorted(x) for i, x in want.items()} == {i: sorted(list(r.ids) for r in got if r.doc_id == i) for i in want}
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert found == f.manifest(folder) and found["tokens"] == at and found["docs"] == len(rows) and len(found["parts"]) > 1
    for p in found["parts"]:
        ids = f.mapped(folder, p["name"] + ".ids", found["dtype"])
        assert isinstance(ids, np.memmap) and len(ids) == p["tokens"]
        assert f.mapped(folder, p["name"] + ".offsets", "<u8")[-1] == p["tokens"]


def test_words_apart_are_the_library_s_own(spark):
    """The words of texts, with and without the separator in them, and with a separator that is no single id."""
    of, e = library(WORD), f.Encoder(WORD, "uint16", True)
    texts = [t or "" for _, t in ROWS] + [prose(i, 200) for i in range(5)] + ["0", "a 0 b", "0a 0 0", "İstanbul ΟΔΟΣ é é ́x"]
    ids = lambda codes: [np.frombuffer(c, "<u2").tolist() for c in codes]
    assert ids(e(texts)) == [of(t) for t in texts]
    assert ids(e(texts)) == [of(t) for t in texts]  # remembered now
    e = f.Encoder(WORD, "uint16", True)
    e.mark = None
    assert ids(e(texts)) == [of(t) for t in texts]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(f, "KNOWN", 10)
    e, of = f.Encoder(WORD, "uint16", True), library(WORD)
    for i in range(5):
        t = prose(i, 30) + " " + "y" * 100
        assert np.frombuffer(e([t])[0], "<u2").tolist() == of(t)
    assert len(e.known) < 60 and max(map(len, e.known)) <= f.LONGEST


def test_empty_table_and_ids_that_do_not_fit(spark, tmp_path):
    found = f.encode(docs(spark, []), str(tmp_path / "none"), WORD)
    assert found["parts"] == [] and f.rows_of(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(ValueError, match="do not fit uint8"):
        f.encode(docs(spark, []), str(tmp_path / "small"), WORD, dtype="uint8")
