"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays of code-point classes.  Each class is a transition function of a small automaton;
composing those functions is associative, so a blocked scan gives the state at every code point, and a boundary is a
local rule on neighbouring states.  The slices between boundaries go through a cached pair merge.  Token offsets are
kept, and decoding places each token's bytes at its offset.

Defined results: a null text counts as empty; an empty text has no tokens and the digest of no bytes; rows that repeat
are encoded separately, rows with a null id too; very long texts and pieces take n log n steps; of pairs with equal ranks the
leftmost is joined first; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import chunks, in_small_batches

END, SPACE, BLANK, LETTER, SINGLE, R, V, ELL, E, NUMBER, QUOTE, OTHER = range(12)
CLASSES = 12
# States: what the token in progress is after a code point.
START, AFTER_SPACE, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(10)
STATES = 10

# The code points of the Unicode property White_Space, and the endings of English contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SINGLE_ENDINGS, DOUBLE_ENDINGS = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[kinds == "L"], table[kinds == "N"] = LETTER, NUMBER
    table[WHITE_SPACE] = BLANK
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for c in SINGLE_ENDINGS:
        table[ord(c)] = SINGLE
    for c, k in (("r", R), ("v", V), ("l", ELL), ("e", E)):
        table[ord(c)] = k
    return table


@lru_cache(1)
def transitions() -> np.ndarray:
    """The state after each state (row) and class (column), flattened."""
    t = np.full((STATES, CLASSES), LETTERS, np.uint8)
    t[:, END] = t[:, BLANK] = START
    t[:, SPACE], t[:, NUMBER], t[:, OTHER] = AFTER_SPACE, NUMBERS, OTHERS
    t[:, QUOTE] = QUOTED
    t[[AFTER_SPACE, OTHERS, QUOTED], QUOTE] = OTHERS  # it goes on with a run, so it can't begin a contraction
    t[QUOTED, [SINGLE, R, V, ELL]] = CONTRACTED, QUOTED_R, QUOTED_V, QUOTED_L
    t[[QUOTED_R, QUOTED_V], E] = CONTRACTED
    t[QUOTED_L, ELL] = CONTRACTED
    return t.ravel()


def states_of(classes: np.ndarray, block: int = 256) -> np.ndarray:
    """The automaton's state after every class: blocks composed side by side, joined by a scan, then filled in."""
    table, n = transitions(), len(classes)
    if not n:
        return np.empty(0, np.uint8)
    rows = -(-n // block)
    c = np.full(rows * block, END, np.intp)
    c[:n] = classes
    c = np.ascontiguousarray(c.reshape(rows, block).T)
    f = np.tile(np.arange(STATES, dtype=np.intp), (rows, 1))
    for x in c:
        f = table[f * CLASSES + x[:, None]].astype(np.intp)
    step = 1
    while step < rows:  # prefix compositions: each row takes on what comes before it
        f[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        step *= 2
    s = np.concatenate(([START], f[:-1, START]))
    out = np.empty((block, rows), np.uint8)
    for j, x in enumerate(c):
        out[j] = s = table[s * CLASSES + x]
        s = s.astype(np.intp)
    return out.T.ravel()[:n]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a piece begins.  The last class must be END; every END is a piece of its own."""
    s = states_of(classes)
    before = np.concatenate(([START], s[:-1]))
    after = np.concatenate((s[1:], [START]))
    blank = (classes == SPACE) | (classes == BLANK)
    blank_before = np.concatenate(([False], blank[:-1]))
    next_class = np.concatenate((classes[1:], [END]))
    solid_next = ~np.concatenate((blank[1:], [False])) & (next_class != END)
    letter = (classes >= LETTER) & (classes <= E)
    starts = np.ones(len(classes), bool)
    starts[blank] = (~blank_before | solid_next)[blank]
    half = (s >= QUOTED_R) & (s <= QUOTED_L)  # an apostrophe and the first of two letters
    inside = np.isin(before, (LETTERS, AFTER_SPACE, QUOTED_R, QUOTED_V, QUOTED_L)) | (s == CONTRACTED) | (half & (after == CONTRACTED))
    starts[letter] = ~inside[letter]
    number = classes == NUMBER
    starts[number] = ~np.isin(before, (NUMBERS, AFTER_SPACE))[number]
    other = (classes == OTHER) | (classes == QUOTE)
    starts[other] = ~np.isin(before, (OTHERS, AFTER_SPACE, QUOTED))[other]
    return starts


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the adjacent pair of lowest rank is joined, leftmost first, until none has a rank."""
    if len(piece) > 200:
        return merged_by_heap(piece, ranks)
    get, none = ranks.get, len(ranks) + 256
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[x] for x in parts]


def merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, in n log n steps: candidates wait in a heap, and one whose parts have changed is skipped."""
    n, get = len(piece), ranks.get
    following, previous, end = [*range(1, n), -1], list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = following[i] if end[i] else -1
        if j < 0 or end[j] != stop:
            continue
        following[i] = k = following[j]
        end[i], end[j] = stop, 0  # 0: joined to another part
        if k >= 0:
            previous[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := previous[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Vocabulary:
    """Ranks of byte strings, with what encoding remembers and decoding looks up."""

    LONGEST, MOST = 64, 1 << 18  # bounds of what is remembered

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, i in self.ranks.items():
            self.length[i] = len(token)
        self.at = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        blob = bytearray(int(self.length.sum()))
        for token, i in self.ranks.items():
            blob[self.at[i] : self.at[i] + len(token)] = token
        self.blob = np.frombuffer(bytes(blob), np.uint8)
        self.known: dict[bytes, list[int]] = {}

    def ids(self, piece: bytes) -> list[int]:
        one = self.ranks.get(piece)
        out = [one] if one is not None else merged(piece, self.ranks)
        if len(piece) <= self.LONGEST:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = class_table()[points]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[ends] = END
        starts = np.flatnonzero(boundaries(classes))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))[starts].tolist()
        data, known, out = joined.encode(), self.known, []
        firsts = np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1))).tolist()
        for first, last in zip(firsts, np.searchsorted(starts, ends).tolist(), strict=True):
            ids: list[int] = []
            for a, b in zip(at[first:last], at[first + 1 : last + 1], strict=True):
                got = known.get(piece := data[a:b])
                ids += self.ids(piece) if got is None else got
            out.append(np.array(ids, dtype="<u4"))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        return np.concatenate(([0], np.cumsum(self.length[ids])))[:-1].astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the tokens, each put at its offset."""
        if not len(ids):
            return b""
        lengths = self.length[ids]
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros(int(offsets[-1] + lengths[-1]), np.uint8)
        out[np.repeat(offsets, lengths) + within] = self.blob[np.repeat(self.at[ids], lengths) + within]
        return out.tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def id_type(df: DataFrame, id_col: str) -> tuple[pa.DataType, str]:
    """The type of an id column: text, or else a long."""
    return (pa.string(), "string") if dict(df.dtypes)[id_col] == "string" else (pa.int64(), "bigint")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<long>) of every text; ``path`` is a rank file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for keys, texts in chunks(batches):
            ids = v.encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(ids, pa.list_(pa.int32())), pa.array([v.offsets(x) for x in ids], pa.list_(pa.int64()))], names=[id_col, "ids", "offsets"])

    kind, name = id_type(df, id_col)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {name}, ids array<int>, offsets array<bigint>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary) from columns ``ids`` and ``offsets``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [v.decode(np.array(i or [], np.int64), np.array(o or [], np.int64)) for i, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return df.select(id_col, "ids", "offsets").mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, bytes binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: (id, n_tokens, ids_le, decoded).

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers, ``decoded`` the bytes that they decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for keys, texts in chunks(batches):
            ids = v.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([v.decode(x, v.offsets(x)) for x in ids], pa.binary())],
                names=[id_col, "n_tokens", "ids_le", "decoded"],
            )

    kind, name = id_type(df, id_col)
    return in_small_batches(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {name}, n_tokens bigint, ids_le binary, decoded binary")
