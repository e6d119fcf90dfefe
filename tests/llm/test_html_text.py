from __future__ import annotations

import pytest

from tidewright.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The  title</h1><p>First &amp; long paragraph with<br>words and <b>bold</b> ones.</p><div class="ad">Buy</div><form><p>Sign up</p></form><p>No.</p>
<aside>Related</aside><section class="comments"><p>Reader says a lot of things here, and goes on for long.</p></section></article>
<div id="sidebar"><p>Side</p></div><footer>&copy; 2024</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "The title\n\nFirst & long paragraph with words and bold ones.\n\nNo."


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<nav><a href='/'>x</a></nav>", "<script>a<b</script>", "<!-- c -->"])
def test_nothing(html):
    assert main_text(html) == ""


def test_without_an_article_element():
    body = "".join(f"<p>{'A long sentence of the story that goes on. ' * 5}{i}</p><p>Ha.</p>" for i in range(4))
    text = main_text(f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>{body}<div><a href=4>More links here</a></div></body>")
    assert text.count("story") == 20 and text.count("Ha.") >= 3 and "More links" not in text and "Two" not in text


def test_broken_markup():
    assert main_text("<article><p>One<p>Two &am") == "One\n\nTwo &am"
    assert main_text("<p>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>" + "<b>" * 2000 + "x</p><p>y</p></article>") == "x\n\ny"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == 3 and {r.page_id: r.text for r in got}[2] == ""
    assert extract(df.where("false")).count() == 0


LONG = "A long sentence of the story that goes on and on for a while, so that it is text. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<nav>menu" + "<b>" * 300 + "</nav><article><p>Main text.</p></article>", "Main text."),
        ("<head><title>t</title><body><article><p>Main.</p></article>", "Main."),
        ("<head><title>t</title><article><p>Main.</p></article>", "Main."),
        ("<head><meta charset=utf-8>Main text.", "Main text."),
        ("<p class='notice'>We use cookies<article><p>Main.</p></article>", "Main."),
        (f"<article><p>{LONG}</p><section class='side-effects'><p>May cause sleep.</p></section><p class='share-price'>It fell.</p><p>{LONG}</p></article>", f"{LONG.strip()}\n\nMay cause sleep.\n\nIt fell.\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p><a href=/x>A whole paragraph that is a link</a></p><p>{LONG}</p></article>", f"{LONG.strip()}\n\nA whole paragraph that is a link\n\n{LONG.strip()}"),
        (f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h1>Title</h1><p>{LONG}</p><p>Short.</p></div><div>Imprint</div>", f"Title\n\n{LONG.strip()}\n\nShort."),
        (f"<article><ul><li><a href=1>Share</a><li><a href=2>Mail</a></ul><h1>T</h1><p>{LONG}</p></article>", f"T\n\n{LONG.strip()}"),
        (f"<b><div class=ad>Buy</b> now</div><article><p>{LONG}</article>", LONG.strip()),
        ("<article><table><tr><td>a<td>b<tr><td><p>c</table><ul><li><b>d<li>e</ul></article>", "a\n\nb\n\nc\n\nd\n\ne"),
        (f"<main><h1>T</h1><article><p>{LONG}</p></article></main>", f"T\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p></article><article class='cookieNotice'><p>Teaser.</p></article>", LONG.strip()),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


def test_names_of_page_parts():
    from tidewright.llm.html_text import names_part

    for name in ("ad", "cookie-notice", "sidebar left", "readerComments", "top-nav", "ad-slot-2", "site_footer", "x related-posts"):
        assert names_part(name), name
    for name in ("", "side-effects", "share-price", "shared", "menu-engineering", "adhoc", "commentary", "notice-period", "content", "main"):
        assert not names_part(name), name


def test_built_pages_against_their_articles():
    """Pages of random blocks, with omitted end tags and unclosed inline elements; the builder knows the article's blocks."""
    import random

    r = random.Random(4)
    say = lambda n: " ".join(r.choice("river stone garden the of and window paper market".split()) for _ in range(n))

    def block(out):
        kind = r.choice(["p", "p", "p", "h2", "li", "quote", "pre", "link", "short", "br"])
        text = say(r.choice([1, 3]) if kind in ("h2", "short", "li") else r.randrange(12, 90))
        if kind == "li":
            more = say(2)
            out += [text, more]
            return f"<ul><li>{text}<li><b>{more}</ul>"
        if kind == "br":
            more = say(9)
            out.append(f"{text} & {more}")
            return f"<p><b>{text}  &amp;<br>\n {more}</b></p>"
        out.append(text)
        return {"p": f"<p>{text}" + r.choice(["</p>", "", "<i>"]), "h2": f"<h2>{text}</h2>", "quote": f"<blockquote><p>{text}</p></blockquote>", "pre": f"<pre>{text}</pre>", "link": f"<p>{text[:9]}<a href='/x'>{text[9:]}</a></p>", "short": f"<div>{text}</div>"}[kind]

    junk = ["<nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>", "<div class='ad banner'><p>Buy this now</div>", "<aside><p>See also</aside>", "<form><label>Mail</label><input></form>", "<script>if (a < b) '</p>'</script>", "<div role=navigation><a href=1>1</a></div>", "<section id=comments><h3>Comments</h3><p>I say much here, and then some more.</section>", "<!-- note --><style>p{}</style>"]
    for _ in range(300):
        want = []
        inner = [block(want) for _ in range(r.randrange(3, 25))]
        if max(map(len, want)) < 60:
            continue
        for _ in range(r.randrange(3)):
            inner.insert(r.randrange(len(inner) + 1), r.choice(junk))
        tag = r.choice(["article", "article", "main"])
        page = f"<html><head><title>{say(3)}</title>" + r.choice(["</head><body>", "<body>", ""]) + "".join(r.choice(junk) for _ in range(r.randrange(5)))
        page += f"<{tag}>" + "".join(inner) + f"</{tag}>" + "".join(r.choice(junk) for _ in range(r.randrange(4))) + "<footer>&copy; x</footer></body></html>"
        assert main_text(page) == "\n\n".join(want), page


def test_very_long_and_very_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<article>" + "<p><b><span>word word" * n + "<div>" * n + "x</article>" + "<ul><li><a href=1>a</a>" * n
        began = time.perf_counter()
        assert main_text(page).startswith("word word")
        return time.perf_counter() - began

    assert seconds(24_000) < 20 * max(seconds(3_000), 0.02)


SAME = "The same long text of a section that differs in a letter or two, so that no cluster is apart from another. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # texts that hardly differ are one cluster
        (f"<body><section><p>{SAME}a</p></section><section><p>{SAME}bb</p></section><section><p>{SAME}ccc</p></section></body>", f"{SAME}a\n\n{SAME}bb\n\n{SAME}ccc"),
        (f"<body><div><p>{SAME}a</p></div><div><p>{SAME}bcd</p></div></body>", f"{SAME}a\n\n{SAME}bcd"),
        (f"<article><p>{SAME}a</p></article><article><p>{SAME}bcd</p></article>", f"{SAME}a\n\n{SAME}bcd"),
        # headings stay with what they head, short sections with the long one
        (f"<div class=post><h1>Head</h1><div class=text-block><p>{LONG}</p></div></div><div>Imprint</div>", f"Head\n\n{LONG.strip()}"),
        (f"<div class=post><h1>Head</h1><section><h2>One</h2><p>Short.</p></section><section><h2>Two</h2><p>{LONG}</p></section></div><div>Imprint</div>", f"Head\n\nOne\n\nShort.\n\nTwo\n\n{LONG.strip()}"),
        # the ratio decides against an element's name
        (f"<article><p>Teaser.</p></article><div><p>{LONG}</p><p>{LONG}</p><p>Ha.</p></div>", f"{LONG.strip()}\n\n{LONG.strip()}\n\nHa."),
        # reader comments in articles, and under a maker's prefix
        (f"<main><article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article></main>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG} Yes.</p></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><div class='wpd-comment-text'>I like it. {LONG}</div></article>", LONG.strip()),
        # a paragraph of the text is not left out for its class, and a list of references goes with its heading
        (f"<article><p>{LONG}</p><p class='notice'>Notice that it rains.</p><p>{LONG}</p></article>", f"{LONG.strip()}\n\nNotice that it rains.\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><h2>References</h2><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article>", f"{LONG.strip()}\n\nReferences\n\nOne\n\nTwo"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>Share</a><li><a href=2>Mail</a></ul></article>", LONG.strip()),
    ],
)
def test_regions_by_ratio(html, want):
    assert main_text(html) == want.replace("  ", " ")


def test_names_with_a_prefix():
    from tidewright.llm.html_text import names_part

    assert all(names_part(x) for x in ("wpd-comment-text", "wp-comments", "dsq-comment"))
    assert not any(names_part(x) for x in ("no-comments", "has-comments", "commented", "code-comment-parser", "my-side"))


def test_built_pages_without_article_elements():
    """Random texts in divs and sections, told apart from lists of links and short lines around them by their ratio alone."""
    import random

    r = random.Random(8)
    say = lambda n: " ".join(r.choice("river stone garden the of and window paper market".split()) for _ in range(n))
    links = lambda: "<div><ul>" + "".join(f"<li><a href=/{i}>{say(2)}</a></li>" for i in range(r.randrange(3, 8))) + "</ul></div>"
    for _ in range(200):
        want = [say(3)] + [say(r.randrange(40, 120)) for _ in range(r.randrange(2, 9))]
        inner = f"<h1>{want[0]}</h1>" + "".join(f"<p>{x}</p>" for x in want[1:])
        shell = r.choice(["<div class=post>{}</div>", "<div><div>{}</div></div>", "<div id=content>{}</div>"]).format(inner)
        page = "<html><body>" + "".join(links() for _ in range(r.randrange(3))) + shell + "".join(r.choice([links(), "<div>Imprint</div>", "<div>All rights</div>"]) for _ in range(r.randrange(4))) + "</body></html>"
        assert main_text(page) == "\n\n".join(want), page


def test_the_ratio_decides():
    """Without its smoothing or its threshold the result of some pages is another."""
    import numpy as np

    from tidewright.llm import html_text as h

    page = f"<body><div><p>{'Short text here. '}</p><p>Ha.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"
    kept, h.cut = h.cut, lambda values: float("-inf")
    try:
        assert "Short text" in main_text(page)
    finally:
        h.cut = kept
    assert np.isneginf(h.cut(np.array([10.0, 11.0, 12.0]))) and 3 < h.cut(np.array([1.0, 2.0, 30.0, 31.0])) < 30
