from __future__ import annotations

from helpers import docs, edge_rows, prose
from pyspark.sql import functions as F

from tidewright.llm import decontaminate as d

QUESTION = "A train leaves the station at 60 km per hour and, as we know, travels for 3 hours before Anna counts 60 km on the dial and stops it."


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id bigint, text string, doc_id string")


def pairs(spark, rows, items, **kw):
    return {(r.doc_id, r.item_id): r for r in d.matches(docs(spark, rows), benchmark(spark, items), **kw).collect()}


def test_tokens(spark):
    df = docs(spark, [(1, "We met Anna, who ran 1,000.5 km. Then Bob left_home at 7 o'clock")])
    words = df.select(d.tokens(F.col("text")).alias("w")).first().w
    assert [w[0] for w in words if w[0] in (d.NUMBER, d.NAME, d.UNIT)] == [d.NAME, d.NUMBER, d.UNIT, d.NAME, d.NUMBER]
    assert words[:2] == ["we", "met"] and "then" in words


def test_verbatim_reworded_parameters_and_inconsistent_ones(spark):
    other = QUESTION.replace("60", "75").replace("3", "4").replace("Anna", "Maria")
    broken = QUESTION.replace("60", "75", 1)
    rows = [*edge_rows(), (50, prose(3, 30) + " " + QUESTION + " " + prose(4, 20)), (51, prose(5, 9) + " " + other), (52, broken), (53, prose(6, 200)), (None, QUESTION)]
    got = pairs(spark, rows, [(1, QUESTION), (2, QUESTION), (3, None), (4, ""), (5, "no more than four")])
    assert set(got) == {(50, 1), (51, 1)}
    assert got[50, 1].verbatim and not got[51, 1].verbatim and got[51, 1].n_slots >= 3


def test_every_place_of_a_short_or_long_item_is_seen(spark):
    item = prose(11, 40)
    short = "seven plain words make this little item"
    rows = [(100 + i, prose(200 + i, i) + " " + item + " " + prose(300 + i, 5)) for i in range(9)] + [(200 + i, prose(400 + i, i + 1) + " " + short) for i in range(5)]
    got = pairs(spark, rows, [(1, item), (2, short)])
    assert set(got) == {(100 + i, 1) for i in range(9)} | {(200 + i, 2) for i in range(5)}


def test_edited_items_are_seen_at_every_offset(spark):
    words = prose(12, 60).split()
    edited = lambda n, every: " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words[:n]))
    rows = [(100 * k + i, prose(500 + i, 20 + i) + " " + edited(*e)) for k, e in enumerate([(18, 10), (21, 10), (40, 10), (60, 10)], 1) for i in range(4)]
    for k, n in enumerate((18, 21, 40, 60), 1):
        got = pairs(spark, rows, [(k, " ".join(words[:n]))])
        assert {100 * k + i for i in range(4)} <= {d for d, _ in got}


def test_a_conflict_takes_only_its_own_windows(spark):
    plain = prose(13, 60).translate(str.maketrans("", "", "0123456789."))
    item = f"Take 60 apples and then 60 pears {plain} and 7 plums are left in the end"
    rows = [(1, item), (2, item.replace("60", "75", 1)), (3, item.replace("60", "75", 1).replace("7 plums", "9 plums"))]
    got = pairs(spark, rows, [(1, item)])
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert got[1, 1].coverage == 1 and got[1, 1].n_slots == 2 and got[1, 1].verbatim
    # The windows with 60 cover the first six tokens alone.
    assert got[2, 1].covered_tokens == got[3, 1].covered_tokens == got[1, 1].covered_tokens - 6
    assert not got[2, 1].verbatim and not got[3, 1].verbatim


def test_against_brute_force(spark):
    items = [(i, prose(20 + i, 15 + i)) for i in range(12)]
    rows = [(i, prose(60 + i, 30) + " " + items[i % 12][1] + " " + prose(90 + i, 11)) if i % 3 else (i, prose(60 + i, 70)) for i in range(40)]
    want = {(i, k) for i, t in rows for k, x in items if x in t}
    assert set(pairs(spark, rows, items)) == want and want


def test_native_and_clean(spark):
    rows = [(1, QUESTION), (2, prose(1, 50)), (3, None)]
    df, items = docs(spark, rows), benchmark(spark, [(1, QUESTION)])
    plan = d.matches(df, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    out = d.clean(df, items)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert d.matches(df.where("false"), items).count() == 0 and d.matches(df, items.where("false")).count() == 0


A = "In the yard stand 5 red boxes beside the gate and further down the lane stand 5 blue boxes"
B = A.replace("5", "3", 1).replace("5", "4")


def brute(rows, items, count_verbatim, window=d.WINDOW, coverage=d.COVERAGE):
    """The same from the definition: rows and items are (id, [(form, value)]) with equal form and value for plain words."""
    first = {}
    for i, words in sorted(items):
        first.setdefault(tuple(words), i)
    classes = {}
    for words, i in first.items():
        seen = list(dict.fromkeys(v for f, v in words if f != v))
        classes.setdefault((tuple(f for f, _ in words), tuple(seen.index(v) + 1 if f != v else 0 for f, v in words)), []).append((i, words))
    out = {}
    for doc, text in set((i, tuple(w)) for i, w in rows):
        for (forms, numbers), of in classes.items():
            n = len(forms)
            width = min(n, window)
            consistent, plain, equal = set(), set(), {i: set() for i, _ in of}
            for shift in range(-n, len(text)):
                places = []
                for at in range(n - width + 1):
                    cut = text[shift + at : shift + at + width] if shift + at >= 0 else ()
                    if len(cut) == width and all(f == g for (f, _), g in zip(cut, forms[at : at + width], strict=True)):
                        alone = all(f != v for f, v in cut)
                        if not alone or any(tuple(v for _, v in w[at : at + width]) == tuple(v for _, v in cut) for _, w in of):
                            places.append((at, cut))
                slots = {(numbers[at + j], v) for at, cut in places for j, (f, v) in enumerate(cut) if f != v}
                bad = {k for k, _ in slots if sum(k == q for q, _ in slots) > 1}
                for at, cut in places:
                    here, ok = set(range(at, at + width)), not any(numbers[at + j] in bad for j in range(width))
                    slotted = any(f != v for f, v in cut)
                    consistent |= here if ok else set()
                    plain |= here if ok and not slotted else set()
                    for i, w in of:
                        if slotted and (ok or count_verbatim) and w[at : at + width] == cut:
                            equal[i] |= here
            hits = {i for i, c in equal.items() if c and len(c | plain) / n >= coverage}
            for i in hits or ({min(i for i, _ in of)} if len(consistent) / n >= coverage else set()):
                out[doc, i] = max(out.get((doc, i), 0), len(consistent | equal[i]))
    return out


def forms(spark, rows):
    got = docs(spark, rows).select("doc_id", d.tokens(F.col("text")).alias("w")).collect()
    return [(r.doc_id, tuple((w[0] if d.NUMBER <= w < d.BEYOND else w, w) for w in r.w)) for r in got]


def test_items_of_one_form_keep_their_own_values(spark):
    rows = [(1, A), (2, B), (3, prose(1, 5) + " " + B + " " + A), (4, A.replace("5", "8"))]
    both = pairs(spark, rows, [(1, A), (2, B)])
    assert {(1, 1), (2, 2), (3, 1), (3, 2), (4, 1)} <= set(both)
    assert both[1, 1].verbatim and both[2, 2].verbatim and both[3, 1].verbatim and both[3, 2].verbatim and not both[4, 1].verbatim
    for one in ((1, A), (2, B)):
        assert set(pairs(spark, rows, [one])) <= set(both)
    # Two items of one class: the verbatim one is reported, whatever its id is.
    other = A.replace("5", "8")
    assert set(pairs(spark, rows, [(1, A), (2, other)])) >= {(1, 1), (4, 2)}
    assert {(r.item_id, r.template_id) for r in d.templates(benchmark(spark, [(1, A), (2, other), (3, B), (4, A), (5, None)])).collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}


def test_verbatim_windows_in_conflict_count_if_asked(spark):
    broken = QUESTION.replace("60", "75", 1)
    assert not pairs(spark, [(52, broken)], [(1, QUESTION)])
    got = pairs(spark, [(52, broken)], [(1, QUESTION)], count_verbatim=True)
    assert set(got) == {(52, 1)} and not got[52, 1].verbatim and got[52, 1].coverage > 0.7


def test_a_replaced_word_is_seen_at_every_offset(spark):
    words = "we know that small boats cross the wide bay each day before noon with fresh fish".split()
    edited = " ".join("ships" if i == 8 else w for i, w in enumerate(words))
    rows = [(i, prose(700 + i, 40).translate(str.maketrans("", "", "0123456789.")).split(" ", 40 - i)[-1] + " " + edited) for i in range(8)]
    got = pairs(spark, rows, [(1, " ".join(words))])
    assert set(got) == {(i, 1) for i in range(8)} and {r.covered_tokens for r in got.values()} == {8}


def test_tables_of_numbers_match_only_themselves(spark):
    table = " ".join(str(i * i) for i in range(3, 40))
    rows = [(1, table), (2, " ".join(str(i + 7) for i in range(400))), (3, "x " + table + " y")]
    assert set(pairs(spark, rows, [(1, table), (2, "4 5 6")])) == {(1, 1), (3, 1)}


def test_templates_against_brute_force(spark):
    import random

    r = random.Random(5)
    plain = "the box by the gate holds some fruit and then it goes to town on a cart with".split()

    def text(n, values):
        return " ".join(str(r.choice(values)) if r.random() < 0.2 else r.choice(plain) for _ in range(n))

    items = [(i, text(5 + i, [3, 4])) for i in range(14)]
    items += [(20 + i, x.replace("3", str(5 + i))) for i, x in items] + [(40 + i, " ".join("4" if w == "3" else "3" if w == "4" else w for w in x.split())) for i, x in items]
    rows = []
    for k in range(160):
        words = r.choice(items)[1].split()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words))
            words[at] = str(r.choice([3, 4, 9])) if words[at].isdigit() else r.choice([words[at], r.choice(plain)])
        rows.append((k // 2 if k < 20 else k, text(r.randrange(12), [3, 4]) + " " + " ".join(words) + " " + text(r.randrange(9), [3, 4])))
    for count in (False, True):
        got = {k: v.covered_tokens for k, v in pairs(spark, rows, items, count_verbatim=count).items()}
        assert got == brute(forms(spark, rows), forms(spark, items), count) and len(got) > 100
