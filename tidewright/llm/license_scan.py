"""License scans with ordered signature rules.

A rule is a hand-written regex with a priority, a label and a keyword without which it cannot match.  One pass over a text
finds the keywords in it, and only their rules are tried.  Hits are resolved in order of priority: one that lies inside a
hit of higher priority, or of the same priority and greater length, is suppressed.  Base phrases look at words only;
every place of theirs counts and none is suppressed.

Defined results: a null or empty text has no words, no labels and score 0; several hits of one label count once; of hits
with the same place and priority the label that sorts first stays; very long texts take linear time; the score is that of
the strongest hit, a hundredth of its priority, and 1 with a base phrase; repeated rows, also of a null id, give repeated
results; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.license_rules import RULES

# The base phrases with their labels, and the bytes that belong to words once A-Z are lower-cased.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

GAP = r"(?:[\s#*/]+)"  # between words: white space and comment marks


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    regex: re.Pattern


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules, highest priority first."""
    out = []
    for line in RULES.strip().splitlines():
        head, regex = line.split(" :: ", 1)
        priority, label, keyword = head.split()
        spaced = re.sub(r"\[[^\]]*\]| ", lambda m: GAP if m[0] == " " else m[0], regex)
        out.append(Rule(int(priority), label, keyword, re.compile(spaced)))
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(1)
def prefilter() -> ahocorasick.Automaton:
    """Finds the keywords in one pass; each stands for the rules that need it."""
    found = ahocorasick.Automaton()
    of: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        of.setdefault(r.keyword, []).append(i)
    for k, some in of.items():
        found.add_word(k, tuple(some))
    found.make_automaton()
    return found


def resolved(hits: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """(start, end, priority, score, label) without the hits inside one of higher priority, or of the same and greater length.

    Of hits of one place and priority the label that sorts first stays.
    """
    kept, reach = [], {}
    # By start, longest first, a hit is inside an earlier one exactly if it ends no later than the furthest end so far.
    for a, b, p, score, label in sorted(set(hits), key=lambda h: (h[0], -h[1], -h[2], h[4])):
        if not any(q >= p and end >= b for q, end in reach.items()):
            kept.append((a, b, p, score, label))
        reach[p] = max(reach.get(p, 0), b)
    return kept


def detections(lower: str) -> list[tuple[int, int, int, float, str]]:
    """The hits that are left in a text in lower case."""
    wanted = {some for _, some in prefilter().iter(lower)}
    every = rules()
    return resolved([(m.start(), m.end(), every[i].priority, every[i].priority / 100, every[i].label) for some in wanted for i in some for m in every[i].regex.finditer(lower)])


def scan_text(text: str | None) -> tuple:
    """(words, base places, first word, last word, base labels, labels, score, spans) of one text."""
    data = (text or "").encode()
    words = data.translate(WORD_BYTES).split()
    starts, base = [], set()
    if b"license" in words:
        line = b" " + b" ".join(words) + b" "
        for phrase, label in BASE.items():
            at = line.find(probe := b" " + phrase + b" ")
            word = line.count(b" ", 0, max(at, 0))
            while at >= 0:
                starts.append(word)
                base.add(label)
                after = line.find(probe, at + 1)
                word += line.count(b" ", at, max(after, at))
                at = after
    found = detections(data.translate(LOWER_BYTES).decode()) if data else []
    labels = base | {h[4] for h in found}
    score = max([h[3] for h in found] + [1.0] * bool(base), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [(a, b, label) for a, b, *_, label in found]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: counts, labels, score and the spans (start, end, label) of the method's detections, in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(scan_text(x.as_py()) for x in batch.column(1)), strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), t) for x, t in zip(got[:-1], types, strict=False)), pa.array([[dict(zip(("start", "end", "label"), s, strict=True)) for s in spans] for spans in got[-1]], types[-1])], names=names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))]
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"
    return df.select(id_col, text_col).mapInArrow(run, schema)
