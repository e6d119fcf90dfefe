from __future__ import annotations

import re

from helpers import docs, edge_rows

from tidewright.llm.license_scan import BASE, detections, rules, scan, scan_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    hits = [(i, label) for p, label in BASE.items() for q in [p.decode().split()] for i in range(len(words)) if words[i : i + len(q)] == q]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = ["", None, "MIT License", "the mit... LICENSE mit license", "xmit license", "Apache License, GNU General\nPublic  License é mit license", "mit license mit license", "İMIT License", "mit licenses"]


def every_hit(lower):
    """All hits of all rules, without the prefilter."""
    return {(m.start(), m.end(), r.priority, r.priority / 100, r.label) for r in rules() for m in r.regex.finditer(lower)}


def left(hits):
    """The definition: what no other hit of higher priority, or of the same and more length, holds; of equal ones the first label."""
    inside = lambda x, y: x is not y and y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or (y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[4] < x[4])))
    return sorted(x for x in hits if not any(inside(x, y) for y in hits))


def examples(n):
    """Texts made of strings that the rules' own regexes match, and of other words."""
    from hypothesis import HealthCheck, Phase, given, seed, settings
    from hypothesis import strategies as st

    out = []

    @seed(1)
    @settings(max_examples=n, database=None, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
    @given(st.data())
    def collect(data):
        some = data.draw(st.lists(st.sampled_from(rules()), min_size=1, max_size=4))
        parts = [data.draw(st.from_regex(r.regex.pattern.replace("(?<![\\w.-])", "").replace("(?<![\\w-])", "").replace("(?<![\\w])", ""), fullmatch=False)) for r in some]
        out.append(data.draw(st.sampled_from([" ", ", ", "\n", " license ", ""])).join(parts))

    collect()
    return out


def test_rules_against_brute_force():
    texts = examples(250) + ["mit license apache license gpl-2.0 general public license", "under the gnu lesser general public license version 3 or the gpl v3"]
    texts += [" ".join(t) for t in zip(texts, texts[3:], texts[7:])]
    found = 0
    for t in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        want = left(every_hit(lower))
        assert sorted(detections(lower)) == want, lower
        found += len(want)
        assert scan_text(t)[:5] == brute(t)
        assert set(scan_text(t)[5].split(",")) - {""} == {x[4] for x in want} | (set(scan_text(t)[4].split(",")) - {""})
    assert found > 300


def test_rules_are_written_one_by_one():
    assert len(rules()) > 250 and len({r.regex.pattern for r in rules()}) == len(rules()) and len({r.label for r in rules()}) > 80


def test_long_texts_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        got = scan_text("MIT license, " * n)
        assert got[:4] == (2 * n, n, 0, 2 * n - 2)
        return time.perf_counter() - began

    assert seconds(80_000) < 24 * max(seconds(10_000), 0.02)


def test_base_phrases():
    for t in TEXTS + [t for _, t in edge_rows()]:
        assert scan_text(t)[:5] == brute(t)


def test_rules_and_suppression():
    assert len(rules()) > 200
    found = detections("licensed under the gnu lesser general public license, version 2.1.")
    assert {h[4] for h in found} == {"lgpl"}  # the GPL phrase inside it is suppressed
    assert {h[4] for h in detections("spdx-license-identifier: bsd-3-clause\nspdx-license-identifier: mpl-2.0")} == {"bsd", "mpl"}
    assert detections("nothing of this kind") == []
    assert scan_text("Permission is hereby granted, free of charge, to any person obtaining a copy")[5] == "mit"
    a = scan_text("This work is licensed under the GNU General Public License, version 3.")
    assert a[4] == "gpl" and a[5] == "gpl" and 0 < a[6] <= 1


def test_a_hit_inside_one_of_higher_priority_goes():
    for text in ("released under the mit license agreement", "terms of the apache software license, version 2.0"):
        found = detections(text)
        for x in found:
            assert not any(y != x and y[2] >= x[2] and y[0] <= x[0] and x[1] <= y[1] for y in found)


def test_table(spark):
    df = docs(spark, [*edge_rows(), (20, "MIT License"), (20, "MIT License")])
    got = scan(df).collect()
    assert len(got) == len(edge_rows()) + 2
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id == 20] == [(2, 1, 0, 0, "mit")] * 2
    assert scan(df.where("false")).count() == 0
