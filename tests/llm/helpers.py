"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

WORDS = {"en": "the of and to in is that for it was on are river stone garden window paper bridge market winter candle harbour".split(), "de": "der die und das von zu mit nicht Haus Garten Wasser Brot Stein Fenster".split()}


def prose(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS[lang]) + r.choice(["", "", "", "s", "ly", "ed", str(r.randint(0, 9))])
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, words string, m bigint, id bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2) for i, t in rows], DOC_SCHEMA)


def edge_rows():
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, prose(1, 60)), (6, prose(1, 60)), (6, prose(1, 60)), (7, long), (8, "Émile’s “naïve” café — 東京 ١٢٣ 😀😀 it's we'll they've 'tis ''s"), (9, "a" * 5000), (10, "x" + "́" * 40)]
