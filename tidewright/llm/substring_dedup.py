"""Removal of long word runs that an earlier document also has.

The words of a document are a path through a De Bruijn graph whose edges are windows of ``width`` words.  The graph is
built in parts, as compacting assemblers do: windows in a row that share their minimizer (the least of the hashes of
their ``seed``-word runs) travel as one row keyed by it, so every edge meets all its equals.  Within a block of documents
only the first document of an edge is sent on; for the others their source, the coordinates (document, word) of the
nearest smaller document with that edge, is known at once.  A shuffle on the minimizer finds the sources of the edges of
all blocks.  As each document takes the nearest smaller one, a passage that is everywhere has no one source of all.

Repeated edges are then compacted: consecutive edges of a document whose sources are consecutive too form a path, and a
path ends where it branches to another source.  The paths' coordinates are joined back to the source documents, whose
words give each path a 128-bit digest, and with it to the documents that repeat them.  There a path is verified against
the words at its own coordinates and taken out.  So nothing is removed that a smaller document does not have word for
word.  Edges are told apart by 40 bits of their minimizer and 64 of their own hash; two different edges that agree in
these can only hide a repeat, never make one.

Windows at the edge of a passage that very many documents share are all different and have its minimizers.  A sample of the
documents shows which minimizers are that crowded; their windows travel one by one, keyed by a second hash of the window,
so they spread over the tasks and equal ones still meet.  At most 1 / ``SHARE`` minimizers can be crowded, which bounds
what is broadcast.  The sample decides only how windows are dealt, not the result.

Defined results: a null or empty text has no words; a document shorter than ``width`` words keeps all; rows with the same
id are one source, so they do not repeat each other; a row with a null id is returned unchanged and is no source; repeated
rows give repeated results; very long texts are cut into blocks of rows; further columns are ignored, whatever their
names; a carried column with the name of a result gets a trailing underscore; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WordHashes, checkpointed, chunks, in_small_batches, mix, pieces, rolled

WIDTH, SEED = 13, 3
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK_WORDS = 1 << 18
SHIFT, WINDOW_BYTES = np.uint64(24), 8  # 40 bits of a minimizer and 64 of a window's hash are sent
SAMPLED, CROWDED, SHARE = 1 / 64, 1024, 2.0**-20  # share of the documents; stretches, and share of the stretches in it, that make a minimizer crowded
SECOND = np.uint64(0xD6E8FEB86659FD93)
NONE = np.empty(0, np.uint64)
LOW = np.uint64(0xFFFFFFFF)
COLUMNS = ["m", "doc", "place", "windows", "src", "run"]
STRETCH = "m bigint, doc bigint, place bigint, windows binary, src bigint, run bigint"
SPANS = ["doc", "sub", "at", "n", "src", "src_sub", "src_at"]
RUNS = "doc bigint, sub bigint, at int, n int, src bigint, src_sub bigint, src_at int"
RESULTS = ("n_words", "n_removed", "kept")


def text_key(text: str) -> int:
    """Tells rows with one id but different texts apart, in 31 bits."""
    return xxhash.xxh3_64_intdigest(text) & 0x7FFFFFFF


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``x`` the sorted, not empty ``some`` holds."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def minimizers(words: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place and the hash of the least seed in it (the first of equal ones)."""
    seeds = rolled(words, seed)
    reach, n = width - seed + 1, len(words) - width + 1
    best, at = seeds[:n].copy(), np.arange(n)
    for j in range(1, reach):
        other = seeds[j : j + n]
        less = np.flatnonzero(other < best)
        best[less] = other[less]
        at[less] = less + j
    return at, best


def stretches(batches: Iterator[pa.RecordBatch], width: int, seed: int, crowded: np.ndarray = NONE) -> Iterator[pa.RecordBatch]:
    """Rows (m, doc, place, windows, src, run): windows from word ``at`` on that share minimizer m, with a hash each.

    Null windows are known to repeat: run packs how many (upper half) have their source at (src, lower half), and m is the
    key of the source's text.  ``place`` packs the text key (upper half) and at.  A window whose minimizer is among the sorted ``crowded`` ones is a row of its
    own, and m is a second hash of it.
    """
    hashes = WordHashes()
    ids, texts, n = [], [], 0
    for i, t in ((i, t) for some in chunks(batches) for i, t in zip(*some, strict=True)):
        if i is None:
            continue
        ids.append(i)
        texts.append(t)
        n += len(t) // 6
        if n >= BLOCK_WORDS:
            yield from block(ids, texts, hashes, width, seed, crowded)
            ids, texts, n = [], [], 0
    if ids:
        yield from block(ids, texts, hashes, width, seed, crowded)


def sources(window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows in order of document, the last row with the same window of the nearest smaller document (-1: there is none)."""
    order = np.argsort(window, kind="stable")
    w, d = window[order], doc[order]
    same = np.zeros(len(order), bool)
    same[1:] = w[1:] == w[:-1]
    fresh = ~same
    fresh[1:] |= d[1:] != d[:-1]
    head = np.flatnonzero(fresh)  # the first row of each window and document
    before = np.where(same[head], order[head - 1], -1)
    out = np.empty(len(order), np.int64)
    out[order] = before[np.cumsum(fresh) - 1]
    return out


def block(ids: list[int], texts: list[str], hashes: WordHashes, width: int, seed: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = []
    for k in np.argsort(np.array(ids, np.int64), kind="stable"):
        words = WORDS.findall(texts[k])
        if len(words) >= width:
            h = hashes(words)
            w = rolled(h, width)
            place, best = minimizers(h, width, seed)
            if len(crowded) and (alone := among(best >> SHIFT, crowded)).any():
                # Hashes of scrambled words; negative places keep neighbours from forming one stretch.
                best = np.where(alone, rolled(mix(h ^ SECOND), width), best)
                place = np.where(alone, -1 - np.arange(len(place)), place)
            parts.append((np.full(len(w), ids[k], np.int64), np.full(len(w), text_key(texts[k]), np.int64), np.arange(len(w)), place, best, w))
    if not parts:
        return
    doc, sub, at, place, m, window = map(np.concatenate, zip(*parts, strict=True))
    del parts
    source = sources(window, doc)
    known = source >= 0
    # A stretch ends where the document, its fate, the place of its minimizer or the line of its sources changes.
    new = np.ones(len(doc), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (known[1:] != known[:-1]) | np.where(known[1:], (source[1:] != source[:-1] + 1) | (doc[source[1:]] != doc[source[:-1]]) | (sub[source[1:]] != sub[source[:-1]]), place[1:] != place[:-1])
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(doc)))
    sent = ~known[starts]
    key = np.where(sent, m[starts] >> SHIFT, sub[source[starts]].view(np.uint64))  # what is known only passes through, dealt by its source
    hashes_sent = window[~known].astype("<u8")
    offsets = np.concatenate(([0], np.cumsum(n * sent * WINDOW_BYTES))).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(starts), [pa.array(sent, pa.bool_()).buffers()[1], pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes_sent.tobytes())])
    place = (sub[starts] << 32) | at[starts]
    src, run = doc[source[starts]], (n << 32) | at[source[starts]]
    for a in range(0, len(starts), 100_000):
        cut = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(doc[starts[cut]]), pa.array(place[cut]), blob[cut], pa.array(src[cut], mask=sent[cut]), pa.array(run[cut], mask=sent[cut])], names=COLUMNS)


def halves(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 32, (packed.view(np.uint64) & LOW).astype(np.int64)


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (doc, sub, at, n, src, src_sub, src_at) of windows that a smaller document has, from rows sorted by minimizer and document.

    What is kept from batch to batch are the distinct windows, with their last coordinates, of the one minimizer that goes on.
    """
    last, carry = None, (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=SPANS)

    for batch in batches:
        asked = np.asarray(batch.column(3).is_valid())
        m, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sub, at = halves(batch.column(2).to_numpy())
        if not asked.all():
            known = batch.filter(pa.array(~asked))
            n, src_at = halves(known.column(5).to_numpy())
            yield rows(doc[~asked], sub[~asked], at[~asked], n, known.column(4).to_numpy(), m[~asked], src_at)
        if not asked.any():
            continue
        m, doc, sub, at = (c[asked] for c in (m, doc, sub, at))
        blobs = batch.column(3).drop_null()
        n = pc.binary_length(blobs).to_numpy() // WINDOW_BYTES
        row = np.repeat(np.arange(len(m)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        w, d, a, t = np.frombuffer(b"".join(blobs.to_pylist()), "<u8"), doc[row], at[row] + within, sub[row]
        group = np.cumsum(np.concatenate(([0], m[1:] != m[:-1])))[row]
        before = len(carry[0]) if last == m[0] else 0
        if before:
            w, d, a, t = (np.concatenate(x) for x in zip(carry, (w, d, a, t), strict=True))
            group = np.concatenate((np.zeros(before, np.int64), group))
        source = sources(mix(group.astype(np.uint64)) ^ w, d)
        hits = np.flatnonzero((np.arange(len(source)) >= before) & (source >= 0) & (d[source] < d))
        source = source[hits]
        if len(hits):
            r, j, src, src_sub, src_at = row[hits - before], within[hits - before], d[source], t[source], a[source]
            fresh = np.ones(len(hits), bool)
            fresh[1:] = (r[1:] != r[:-1]) | (j[1:] != j[:-1] + 1) | (src[1:] != src[:-1]) | (src_sub[1:] != src_sub[:-1]) | (src_at[1:] != src_at[:-1] + 1)
            s = np.flatnonzero(fresh)
            yield rows(doc[r[s]], sub[r[s]], at[r[s]] + j[s], np.diff(np.append(s, len(hits))), src[s], src_sub[s], src_at[s])
        last, tail = m[-1], np.flatnonzero(group == group[-1])[::-1]
        tail = tail[np.unique(w[tail], return_index=True)[1]]  # of each window the last row
        carry = (w[tail], d[tail], a[tail], t[tail])


def crowded_minimizers(docs: DataFrame, width: int, seed: int) -> np.ndarray:
    """The minimizers, sorted, that ``CROWDED`` stretches and the share ``SHARE`` of all have in a sample of the documents."""
    rows = docs.sample(SAMPLED, seed=17).mapInArrow(lambda b: stretches(b, width, seed), STRETCH)
    counts = checkpointed(rows.where("windows is not null").groupBy("m").count())
    least = max(CROWDED, (counts.agg(F.sum("count")).first()[0] or 0) * SHARE)
    return np.sort(counts.where(F.col("count") >= least).select("m").toArrow().column(0).to_numpy().view(np.uint64))


def paths(runs: DataFrame) -> DataFrame:
    """(doc, sub, at, n, src, src_sub, src_at): runs whose places and sources go on from each other are one path.

    ``src_sub`` tells the texts of a source apart; it may be left out where a source has one text.
    """
    texts = [c for c in ("src", "src_sub") if c in runs.columns]
    runs = runs.repartition("doc").withColumn("line", F.col("src_at") - F.col("at")).withColumn("to", F.col("at") + F.col("n"))
    own = Window.partitionBy("doc", "sub", *texts, "line").orderBy("at")
    branch = F.coalesce(F.max("to").over(own.rowsBetween(Window.unboundedPreceding, -1)) < F.col("at"), F.lit(True))
    runs = runs.withColumn("branch", branch.cast("int")).withColumn("path", F.sum("branch").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc", "sub", *texts, "line", "path").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    return out.select("doc", "sub", "at", (F.col("to") - F.col("at")).alias("n"), *texts, (F.col("at") + F.col("line")).alias("src_at"))


def found_paths(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """The paths of all documents (doc, text), written once; nothing of how they were found is kept."""
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_minimizers(docs, width, seed))
    rows = docs.mapInArrow(lambda b: stretches(b, width, seed, crowded.value), STRETCH)
    return checkpointed(paths(rows.repartition("m").sortWithinPartitions("m", "doc").mapInArrow(repeats, RUNS)))


def digest(words: list[str], at: int, n: int, width: int) -> bytes | None:
    """A digest of the words that ``n`` windows from ``at`` on cover; None if there are not so many."""
    return xxhash.xxh3_128_digest(" ".join(words[at : at + n + width - 1])) if at + n + width - 1 <= len(words) else None


def kept_words(text: str | None, spans: list, width: int) -> tuple[int, int, str | None]:
    """Words, removed words, and the kept ones joined by one space; of ``spans``, those of another text or with other words are passed over."""
    words = WORDS.findall(text or "")
    edge = np.zeros(len(words) + 1, np.int64)
    sub = text_key(text or "") if spans else None
    for s in spans:
        if s["sub"] == sub and digest(words, s["at"], s["n"], width) == s["proof"]:
            edge[s["at"]] += 1
            edge[s["at"] + s["n"] + width - 1] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    removed = int((~keep).sum())
    return len(words), removed, " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if removed else " ".join(words)


def with_spans(df: DataFrame, id_col: str, text_col: str, carry: list[str], width: int, seed: int) -> DataFrame:
    """(k, doc, text, carried ..., spans) of every row, spans as (sub, at, n, proof)."""
    found = found_paths(in_small_batches(df).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), width, seed)
    # Both joins with the texts read one shuffle of them, as they ask for the same columns; rows without an id are dealt by text.
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("k"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))

    proven = pa.list_(pa.struct([("sub", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("proof", pa.binary())]))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the asked paths hold at their source, a row for each document that asks."""
        place = len(carry) + 3
        for batch in pieces(batches, 2):
            askers, out = [], []
            for doc, text, asked in zip(batch.column(1), batch.column(2), batch.column(place), strict=True):
                if doc.is_valid:
                    text = text.as_py() or ""
                    own, words, by_doc = text_key(text), WORDS.findall(text), {}
                    for a in asked.as_py():
                        if a["src_sub"] == own and (d := digest(words, a["src_at"], a["n"], width)):
                            by_doc.setdefault(a["doc"], []).append({"sub": a["sub"], "at": a["at"], "n": a["n"], "proof": d})
                    askers += by_doc
                    out += by_doc.values()
            yield pa.RecordBatch.from_arrays([pa.array(askers, pa.int64()), pa.array(out, proven)], names=["doc", "spans"])

    # A place of a source is asked for by the next documents that have its window, in its block and beyond: two, however many have it.
    asked = found.groupBy(F.col("src").alias("k")).agg(F.collect_list(F.struct("src_sub", "src_at", "n", "doc", "sub", "at")).alias("asked"))
    proofs = texts.join(asked, "k").select(*texts.columns, "asked").mapInArrow(prove, "doc bigint, spans array<struct<sub:bigint,at:int,n:int,proof:binary>>")
    spans = proofs.groupBy(F.col("doc").alias("k")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return texts.join(spans, "k", "left_outer").select(*texts.columns, "spans")


def cut(batches: Iterator[pa.RecordBatch], width: int, shape: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        own = zip(batch.column(1), batch.column(2), batch.column(batch.num_columns - 1), strict=True)
        yield shape(batch, [kept_words(t.as_py(), (s.as_py() or []) if i.is_valid else [], width) for i, t, s in own])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row, and the columns to carry along."""
    types, own = dict(df.dtypes), [c for c in carry if c != text_col]
    names = [c + "_" if c in (id_col, *RESULTS) else c for c in carry]

    def shape(batch: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
        n, removed, kept = zip(*got, strict=True) if got else ((), (), ())
        carried = [batch.column(2) if c == text_col else batch.column(3 + own.index(c)) for c in carry]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *carried], names=[id_col, *RESULTS, *names])

    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept string" + "".join(f", `{n}` {types[c]}" for n, c in zip(names, carry, strict=True))
    return with_spans(df, id_col, text_col, own, width, seed).mapInArrow(lambda b: cut(b, width, shape), schema)


def rewritten(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` with their columns; where words go, the text is what is kept and ``size_col``, if there is one, its length."""
    names = df.columns
    own = [c for c in names if c not in (id_col, text_col)]

    def shape(batch: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
        columns = {id_col: batch.column(1), text_col: batch.column(2)} | {c: batch.column(3 + i) for i, c in enumerate(own)}
        changed = pa.array([removed > 0 for _, removed, _ in got], pa.bool_())
        columns[text_col] = pc.if_else(changed, pa.array([kept for *_, kept in got], pa.string()), columns[text_col])
        if size_col in own:
            columns[size_col] = pc.if_else(changed, pa.array([len(kept) for *_, kept in got], columns[size_col].type), columns[size_col])
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return with_spans(df, id_col, text_col, own, width, seed).mapInArrow(lambda b: cut(b, width, shape), df.schema)
