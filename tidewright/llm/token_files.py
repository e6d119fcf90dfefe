"""Token ids of a table as flat binary files, with 64-bit offsets, for training jobs that map them into memory.

Documents are dealt by ranges of their id and sorted, so the files in order hold the documents in order.  A task encodes
its range and writes, as it goes, the ids (flat unsigned integers, little-endian), the offset at which each document ends (64-bit,
within the file, after a 0) and the documents' ids (64-bit).  It returns one row about its files; a prefix sum over these rows gives
the base of each file, at which its first token stands in the whole, and is written beside the files as ``manifest.json``.
Attempts write files of their own names, and the manifest names those of the attempt whose row came back, so a lost executor does no harm.

Words are encoded once and remembered up to a bound.  That is the library's own encoding, because its tokenizer drops the spaces
between words; words that are not known yet are handed over together, kept apart by a separator that is encoded to one id, and one by one if that
cannot be.  A tokenizer that keeps spaces gets whole texts (``by_words=False``).

Defined results: a null or empty text has the end id alone; documents of a null id come first; those that share an id follow each other by
the hash of their text, and each is kept; a text of any length is one document; strings of special tokens are encoded as the library does by default;
further columns, also of the same names, are ignored; an empty table has no files and an empty manifest.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import LONGEST, chunks

END, SEPARATOR, KNOWN = 1, "0", 1 << 20
PARTS = "part int, name string, docs bigint, nulls bigint, tokens bigint"


def opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder that a URI (or a plain path) names, and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (arrow_fs.LocalFileSystem(), folder) if folder.startswith("/") else arrow_fs.FileSystem.from_uri(folder)


class Encoder:
    """Ids of texts by a file of the tokenizers library, as bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str, by_words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.by_words, self.known = Tokenizer.from_file(path), np.dtype(dtype), by_words, {"": b""}
        mark = self.library([SEPARATOR])[0]
        self.mark = mark[0] if len(mark) == 1 else None

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, ids: list[int] | np.ndarray) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        plain = [w for w in words if SEPARATOR not in w] if self.mark is not None else []
        out = {}
        for lo in range(0, len(plain), 256):
            some = plain[lo : lo + 256]
            ids = np.array(self.library([f" {SEPARATOR} ".join(some)])[0], np.int64)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(some) - 1:
                small, width = self.packed(ids), self.dtype.itemsize
                starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
                out.update((w, small[a * width : b * width]) for w, a, b in zip(some, starts, ends, strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, map(self.packed, self.library(rest)), strict=True))
        return [out[w] for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [self.packed(x) for x in self.library(texts)]
        known = self.known
        if len(known) > KNOWN:
            known.clear()
            known[""] = b""
        split = [[w for line in t.split("\n") for w in line.split(" ")] for t in texts]
        new = list({w for words in split for w in words if w not in known})
        got = dict(zip(new, self.of_words(new), strict=True))
        long = {w: got.pop(w) for w in new if len(w) > LONGEST}  # such words are not remembered
        known.update(got)
        return [b"".join([known[w] if w in known else long[w] for w in words]) if long else b"".join([known[w] for w in words]) for words in split]


ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str, by_words: bool) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = path, dtype, by_words
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(*key)
    return ENCODERS[key]


def encode(df: DataFrame, folder: str, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", dtype: str = "uint16", by_words: bool = True) -> dict:
    """Writes the files of all documents to ``folder``, which all workers share, and returns the manifest."""
    most = np.iinfo(dtype).max
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("at", F.monotonically_increasing_id())
    key = F.xxhash64("text")
    laid = docs.repartitionByRange("doc", key, "at").sortWithinPartitions("doc", key, "at").select("doc", "text", F.spark_partition_id().alias("part"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (files, at) = encoder(tokenizer, dtype, by_words), opened(folder)
        tail = of.packed([end]) if end is not None else b""
        part = name = None
        docs = nulls = tokens = 0
        out = {}
        for batch in batches:
            if batch.num_rows and part is None:
                part = batch.column(2)[0].as_py()
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}"
                out = {kind: files.open_output_stream(f"{at}/{name}.{kind}") for kind in ("ids", "offsets", "docs")}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            for ids, texts in chunks([batch]):
                codes = [c + tail for c in of(texts)]
                ends = tokens + np.cumsum([len(c) // of.dtype.itemsize for c in codes], dtype=np.int64)
                out["ids"].write(b"".join(codes))
                out["offsets"].write(ends.astype("<u8").tobytes())
                out["docs"].write(np.array([x or 0 for x in ids], "<i8").tobytes())
                docs, nulls, tokens = docs + len(ids), nulls + sum(x is None for x in ids), int(ends[-1])
        for stream in out.values():
            stream.close()
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": docs, "nulls": nulls, "tokens": tokens}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    files, at = opened(folder)
    files.create_dir(at, recursive=True)
    if encoder(tokenizer, dtype, by_words).tokenizer.get_vocab_size() > most + 1 or (end or 0) > most:
        raise ValueError(f"ids of this tokenizer do not fit {dtype}")
    parts = sorted(laid.mapInArrow(written, PARTS).collect())
    bases = accumulate((p.tokens for p in parts), initial=0)
    found = {"dtype": np.dtype(dtype).newbyteorder("<").str, "end": end, "docs": sum(p.docs for p in parts), "tokens": sum(p.tokens for p in parts),
             "parts": [{"name": p.name, "base": base, "docs": p.docs, "nulls": p.nulls, "tokens": p.tokens} for p, base in zip(parts, bases)]}
    with files.open_output_stream(f"{at}/manifest.json") as stream:
        stream.write(json.dumps(found).encode())
    return found


def manifest(folder: str) -> dict:
    files, at = opened(folder)
    with files.open_input_stream(f"{at}/manifest.json") as stream:
        return json.loads(stream.read())


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the file system is local, read otherwise."""
    files, at = opened(folder)
    if isinstance(files, arrow_fs.LocalFileSystem):
        return np.memmap(f"{at}/{name}", dtype, "r") if os.path.getsize(f"{at}/{name}") else np.empty(0, dtype)
    with files.open_input_file(f"{at}/{name}") as stream:
        return np.frombuffer(stream.read(), dtype)


def rows_of(spark: SparkSession, folder: str, with_ids: bool = False, rows: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, and its ids, read from the files; a task reads one file."""
    found = manifest(folder)
    dtype = found["dtype"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                ids, offsets, docs = mapped(folder, p["name"] + ".ids", dtype), mapped(folder, p["name"] + ".offsets", "<u8").astype(np.int64), mapped(folder, p["name"] + ".docs", "<i8")
                for lo in range(0, p["docs"], rows):
                    hi = min(lo + rows, p["docs"])
                    ends = offsets[lo : hi + 1]
                    own = [np.asarray(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    columns = [
                        pa.array(docs[lo:hi], mask=np.arange(lo, hi) < p["nulls"]), pa.array(ends[:-1] + p["base"]), pa.array(np.diff(ends)),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    parts = spark.createDataFrame([(p["name"], p["base"], p["docs"], p["nulls"]) for p in found["parts"]], "name string, base bigint, docs bigint, nulls bigint")
    return parts.repartition(max(1, len(found["parts"]))).mapInArrow(read, schema)
