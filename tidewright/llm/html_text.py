"""Main-text extraction from HTML.

The standard-library parser streams events.  Each block (a "line") gets its text, the number of tags seen with it, the
length of its link text and the container it stands in.  The text-to-tag ratio of the lines is smoothed with a Gaussian,
and a threshold between two clusters of the smoothed ratios, if these are apart, splits the lines into high and low ones.
Each container weighs what its high lines hold, of those that are so by themselves and not by their neighbours, less a
share of what its other lines do, and the heaviest one is the content
region; an article is one region whatever it is cut into, its own low lines weigh nothing, and a section brings the
sections beside it.  A region is kept whole, short lines and headings too, with the headings right before it; of the blocks in
it only containers that are nothing but links go (inside an article, those of several links before its first or after
its last high line that have no heading of their own).  Elements that are never part of an article are left out
beforehand: by name, by role, or by a class or id that names such a part and nothing else ("cookie-notice", but not
"side-effects"); inside an article names count on containers only, and on a nested article.

Omitted end tags are implied as in HTML: a block closes an open paragraph, body content closes the head, and so on; the
end tag of an inline element closes that element alone.

Defined results: null or empty html, and pages without content, give an empty text; unclosed and cut-off markup is read
as far as it goes; very long pages and very deep nesting take linear time; where the ratios of the two clusters are not a quarter apart there is one,
and every line is high; repeated rows, also of a null id, give repeated results; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe object svg math canvas audio video dialog menu noframes search".split())
HEAD_CONTENT = frozenset("html head title meta link script style noscript template base basefont bgsound".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
SCOPES = frozenset("html table caption td th object template button marquee".split())
CONTAINERS = frozenset("body article main section div td th ul ol dl table blockquote details fieldset figure center".split())
# What a start tag closes (the innermost of the first) unless one of the second is open further in.
IMPLIED = {
    "li": ("li", "ul ol menu dir table td th"), "dt": ("dt dd", "dl table td th"), "dd": ("dt dd", "dl table td th"), "option": ("option", "select datalist optgroup"),
    "td": ("td th caption", "tr table"), "th": ("td th caption", "tr table"), "tr": ("tr caption", "table"), "tbody": ("tbody thead tfoot caption", "table"), "tfoot": ("tbody thead tfoot caption", "table"), "thead": ("tbody thead tfoot caption", "table"),
}
IMPLIED = {k: (a.split(), b.split()) for k, (a, b) in IMPLIED.items()}
# Names of page parts that are no article text, and words that go with them in compounds.
PARTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner banners billboard nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations widget widgets comment comments disqus respond replies reply pagination pager copyright disclaimer skip hidden paywall".split())
WITH_PARTS = frozenset("area bar block blocks bottom box button buttons container content copy form global group header holder inner icon icons item items label left link links list main message outer page panel placeholder post posts primary reader readers region right row secondary section site slot small sticky text thread title to top unit user users widget wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
NOT_THOSE = frozenset("no has with is non without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PIECES = frozenset("section table td th ul ol dl blockquote details fieldset figure center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def names_part(names: str, some: frozenset[str] = PARTS) -> bool:
    """Whether a class or id among ``names`` is the name of a page part, or a compound of such a name and words that go with it.

    Reader comments may have a maker's few letters in front.
    """
    for token in names.split():
        parts = [x.lower() for x in NAME_PARTS.findall(token)]
        if len(parts) > 1 and len(parts[0]) <= 4 and parts[0] not in NOT_THOSE and parts[0] not in PARTS and not COMMENTS.isdisjoint(parts):
            parts = parts[1:]
        if not some.isdisjoint(parts) and all(x in PARTS or x in WITH_PARTS or x.isdigit() for x in parts):
            return True
    return False


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters of link text
    container: int
    heading: bool


class Open(NamedTuple):
    tag: str
    left_out: bool
    article: bool
    container: bool


class Lines(HTMLParser):
    """Turns parser events into lines; ``parents``, ``links``, ``kinds`` and ``articles_of`` tell of each container what it is in,
    how many links it has, its element and the outermost article around it (a container too; -1: none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open | None] = []  # None: an inline element that has been closed
        self.at: dict[str, list[int]] = {}  # where in ``open`` the elements of a name are
        self.blocks: list[int] = []  # where in ``open`` the blocks are
        self.out = self.articles = self.in_link = self.in_heading = 0
        self.parents, self.links, self.within, self.kinds, self.articles_of = [-1], [0], [0], [""], [-1]
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.within[-1], self.in_heading > 0))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def innermost(self, names: list[str] | frozenset[str]) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def push(self, item: Open) -> None:
        place = len(self.open)
        self.open.append(item)
        self.at.setdefault(item.tag, []).append(place)
        if item.tag in BLOCKS:
            self.blocks.append(place)
        self.out += item.left_out
        self.in_link += item.tag == "a"
        self.in_heading += item.tag in HEADINGS
        if item.container:
            own = len(self.parents)
            self.articles_of.append(self.articles_of[self.within[-1]] if self.articles else own if item.article else -1)
            self.parents.append(self.within[-1])
            self.links.append(0)
            self.kinds.append(item.tag)
            self.within.append(own)
        self.articles += item.article

    def close_item(self, place: int) -> None:
        item = self.open[place]
        if item is None:
            return
        self.open[place] = None
        self.at[item.tag].pop()  # elements are closed from the innermost of a name outwards
        if item.tag in BLOCKS:
            self.blocks.pop()
        self.out -= item.left_out
        self.articles -= item.article
        self.in_link -= item.tag == "a"
        self.in_heading -= item.tag in HEADINGS
        if item.container:
            self.within.pop()

    def close_to(self, place: int) -> None:
        """Closes the element at ``place`` and all in it."""
        if self.blocks and self.blocks[-1] >= place:
            self.flush()
        while len(self.open) > place:
            self.close_item(len(self.open) - 1)
            self.open.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += not self.out
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if self.at.get("head") and tag not in HEAD_CONTENT:
            self.close_to(self.at["head"][-1])
        if tag in CLOSES_P and self.at.get("p") and self.at["p"][-1] > self.innermost(SCOPES):
            self.close_to(self.at["p"][-1])
        if tag in IMPLIED:
            closed, inside = IMPLIED[tag]
            if (place := self.innermost(closed)) > self.innermost(inside):
                self.close_to(place)
        if tag == "a":
            self.links[self.within[-1]] += 1
        if tag in VOID:
            return
        a = dict(attrs)
        left_out = tag in NEVER or (tag == "header" and not self.articles) or "hidden" in a or a.get("aria-hidden") == "true" or (a.get("role") or "").lower() in ROLES
        if not left_out and tag not in ("html", "body", "main"):
            names = f"{a.get('class') or ''} {a.get('id') or ''}"
            if tag == "article":
                left_out = names_part(names, PARTS if self.articles else COMMENTS)
            elif not self.articles or tag in BLOCKS - HEADINGS - {"p"}:
                left_out = names_part(names)
        self.push(Open(tag, left_out, tag in ("article", "main") and not self.out, tag in CONTAINERS))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.at.get(tag):
            self.close_to(self.at[tag][-1])

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.out
        if tag in BLOCKS:
            self.flush()
        if not self.at.get(tag):
            return
        place = self.at[tag][-1]
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > place:
            self.close_item(place)  # blocks that were opened in it stay open
        elif tag in SCOPES or tag in ("tr", "tbody", "thead", "tfoot", "body") or place > self.innermost(SCOPES):
            self.close_to(place)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] is not None and self.open[-1].tag == "head" and data.strip():
            self.close_to(len(self.open) - 1)
        if not self.out:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian smoothing that does not lose weight at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return pad(ratios) / pad(np.ones(len(ratios)))


def cut(values: np.ndarray, apart: float = 1.25) -> float:
    """The threshold between two clusters of values (alternating means, from the extremes); below all where the higher
    mean is less than ``apart`` times the lower one."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        t = (low + high) / 2
        a, b = values[values <= t], values[values > t]
        if not len(b) or (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2 if high >= apart * low else float("-inf")


LOW = 0.2  # what a low line takes from its container, for what a high one gives


def chosen(p: Lines, sigma: float, link_share: float) -> np.ndarray:
    """Which lines are in the content region and no lists of links."""
    lines = p.lines
    size, linked = np.array([len(x.text) for x in lines]), np.array([x.linked for x in lines])
    container, heading = np.array([x.container for x in lines]), [x.heading for x in lines]
    ratio = (size - linked) / np.maximum(1, [x.tags for x in lines])
    smooth = np.round(smoothed(ratio, sigma), 6)
    threshold = cut(smooth)
    high = (smooth >= threshold) & (linked <= link_share * size)
    # Of each container with what is in it: text, link text, high lines, links and weight.
    n, parents, articles, all_links = len(p.parents), p.parents, p.articles_of, list(p.links)
    weights = np.where(high & (ratio >= threshold), size - linked, np.where(np.array(articles)[container] < 0, -LOW * size, 0.0))
    text, link_text, highs, weight = (np.bincount(container, x, n).tolist() for x in (size, linked, high, weights))
    depth = [0] * n
    for i in range(n - 1, 0, -1):  # a container comes after what it is in
        for x in (text, link_text, highs, all_links, weight):
            x[parents[i]] += x[i]
    for i in range(1, n):
        depth[i] = depth[parents[i]] + 1
    is_list = [b > link_share * a and not h for a, b, h in zip(text, link_text, highs, strict=True)]
    in_list, in_menu = [is_list[0]] + [False] * (n - 1), [False] * n
    for i in range(1, n):
        in_list[i] = is_list[i] or in_list[parents[i]]
        in_menu[i] = (is_list[i] and all_links[i] > 1) or in_menu[parents[i]]
    best = max((i for i in range(n) if highs[i]), key=lambda i: (round(weight[i], 6), depth[i], -i), default=-1)
    if best < 0:  # nothing is high: the articles, if there are any
        return np.array(articles)[container] >= 0
    whole = articles[best]
    top = whole if whole >= 0 else best
    # A section, or another piece of a text, brings the pieces of its kind beside it.
    beside = whole < 0 and p.kinds[best] in PIECES
    region = [i == top or (beside and parents[i] == parents[best] and p.kinds[i] == p.kinds[best]) for i in range(n)]
    for i in range(1, n):
        region[i] = region[i] or region[parents[i]]
    keep = np.array(region)[container]
    own = np.flatnonzero(keep)
    if whole < 0:
        keep &= ~np.array(in_list)[container]
        first = int(own[0])
        while first > 0 and heading[first - 1]:
            first -= 1
            keep[first] = True
        return keep
    ends = own[high[own]][[0, -1]]
    for i in own[(own < ends[0]) | (own > ends[1])].tolist():
        if in_menu[container[i]]:
            # A list goes on from line to line; it stays if a heading of the article comes right before it.
            titled = i > own[0] and (heading[i - 1] or (keep[i - 1] and in_menu[container[i - 1]])) and bool(keep[i - 1]) and i > ends[1]
            keep[i] = titled
    return keep


def main_text(html: str | None, sigma: float = 1.0, link_share: float = 0.6) -> str:
    """The article's blocks, joined by blank lines."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    return "\n\n".join(x.text for x, k in zip(p.lines, chosen(p, sigma, link_share), strict=True) if k) if p.lines else ""


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text) of every row; the parse is a map, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*names, "text"])

    names, types = [id_col, *keep], dict(df.dtypes)
    return df.select(html_col, *names).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", text string")
