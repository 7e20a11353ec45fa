"""Main text of web pages by two-pass block rules.

The markup is cut into blocks at block-level tags. First pass: each block is good, bad or
ambiguous by its own figures alone, which are length, density of stop words, density of
links, and the region of the page it stands in. Second pass: ambiguous blocks, short ones
above all, inherit the label of the nearest decided neighbour. An article or main element
counts as a decided good neighbour at both of its ends, so that what it holds needs no
length or stop words of its own; menus, footers and the like are decided bad.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import named, small_batches, tidied, without

#: Characters below which a block is short and from which a good one is long; shares of stop words; share of linked characters.
SHORT, LONG, FEW_STOPS, MANY_STOPS, LINKED = 70, 200, 0.12, 0.25, 0.5
#: Common function words, fixed values.
STOPS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her she there been",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ils mais comme ou si leur y dont aux",
}
WORDS = {k: frozenset(v.split()) for k, v in STOPS.items()}

#: Elements that end a block where they begin and end; of these, those that may hold blocks are followed.
HOLDERS = frozenset("address article aside blockquote body button center canvas dd details dialog dir div dl dt fieldset figcaption figure footer form header iframe li main menu nav noscript object ol search section select svg table tbody td template tfoot th thead tr ul video audio".split())
BLOCKS = HOLDERS | frozenset("h1 h2 h3 h4 h5 h6 hr p pre caption legend option optgroup summary textarea title head html".split())
#: Elements whose content is no markup, and no text of the page.
RAW = re.compile(r"</(script|style|textarea|title|xmp|noembed|noframes)(?=[\s/>])", re.I)
#: Regions that hold no article text: for good, or unless an article begins inside.
NEVER = frozenset("aside footer dialog menu button select template noscript svg iframe object canvas video audio search".split())
UNLESS = frozenset("nav header form".split())
NAMED = NEVER | UNLESS | {"article", "main"}
NEVER_ROLES = frozenset("complementary contentinfo dialog alertdialog alert menu menubar toolbar tablist tooltip search status".split())
UNLESS_ROLES = frozenset("navigation banner form".split())
#: Words of class and id that name such a region.
NEVER_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promotion banner sidebar aside widget cookie cookies consent gdpr popup modal overlay newsletter subscribe comment comments commentlist disqus respond reply replies related recommended share sharing social breadcrumb breadcrumbs pagination pager footer copyright notice notices alert disclaimer login signup teaser".split())
UNLESS_NAMES = frozenset("menu nav navbar navigation topbar toolbar masthead header form".split())
#: A class with one of these words says what a region lies beside, not what it is.
BESIDE = frozenset("has with no without enabled disabled open closed fixed sticky".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GOOD, BAD, OPEN = 1, -1, 0
#: Regions: none named, an article, none of it for good, none of it unless an article begins.
PLAIN, ARTICLE, NOTHING, OUTSIDE = 0, 1, 2, 3


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    region: int
    heading: bool


def region(tag: str, rest: str, outer: int) -> int:
    """The region that an element makes inside ``outer``."""
    if outer == NOTHING or tag in ("body", "html") or not (rest or tag in NAMED):
        return outer
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest else {}
    names = [set(map(str.lower, NAME_WORD.findall(c))) for k in ("class", "id") for c in found.get(k, "").split()]
    names = set().union(*[n for n in names if not n & BESIDE])
    role = found.get("role", "").lower()
    if "hidden" in found or tag in NEVER or role in NEVER_ROLES or names & NEVER_NAMES:
        return NOTHING
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody":
        return ARTICLE
    if outer == ARTICLE and (tag == "header" or "header" in names):
        return ARTICLE
    return OUTSIDE if tag in UNLESS or role in UNLESS_ROLES or names & UNLESS_NAMES else outer


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, decoded, with white space made single."""
    out: list[Block] = []
    held: list[tuple[str, int]] = []  # open elements and their regions
    opened: Counter[str] = Counter()
    now: list[str] = []
    linked, link, at, own, heading = 0, None, 0, None, False

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        now.append(piece)
        if link is not None:
            linked += len(" ".join(piece.split()))

    def close() -> None:
        nonlocal linked, own, heading
        if now:
            text = " ".join("".join(now).split())
            if text:
                out.append(Block(text, linked, own if own is not None else held[-1][1] if held else PLAIN, heading))
            now.clear()
        linked, own, heading = 0, None, False

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            now.append(" ")
        if m["end"]:
            if opened[tag]:
                while True:  # what was left open inside ends with it
                    name, _ = held.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            if tag == "a" or (link is not None and len(held) < link):
                link = None
            continue
        outer = held[-1][1] if held else PLAIN
        if tag in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes"):
            while (stop := RAW.search(page, at)) and stop[1].lower() != tag:
                at = stop.end()
            at = stop.start() if stop else len(page)
        elif tag == "a":
            link = len(held) if "href" in m["rest"].lower() else None
        elif tag == "plaintext":
            at = len(page)
        elif tag in HOLDERS:
            if tag in ("li", "dt", "dd", "tr", "td", "th") and held and held[-1][0] == tag:
                opened[held.pop()[0]] -= 1
                outer = held[-1][1] if held else PLAIN
            if not m["rest"].endswith("/") or tag not in ("svg", "iframe", "object", "canvas"):
                held.append((tag, region(tag, m["rest"], outer)))
                opened[tag] += 1
        elif tag in BLOCKS:
            own, heading = region(tag, m["rest"], outer), tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def first_labels(found: list[Block]) -> list[int]:
    """Good, bad or open, by each block's own figures."""
    article = any(b.region == ARTICLE for b in found)
    outside = [b.region in (NOTHING, OUTSIDE) or (article and b.region != ARTICLE) for b in found]
    words = [[] if x else b.text.lower().split() for b, x in zip(found, outside, strict=True)]
    stops = [[sum(map(s.__contains__, ws)) for ws in words] for s in WORDS.values()]
    stops = max(stops, key=sum)  # those of the page's language
    labels = []
    for b, x, ws, n in zip(found, outside, words, stops, strict=True):
        stop, link = n / max(len(ws), 1), b.linked / len(b.text)
        if x:
            labels.append(BAD)
        elif b.region == ARTICLE:
            labels.append(GOOD if len(b.text) >= LONG and stop >= MANY_STOPS and link <= LINKED else OPEN)
        elif link > LINKED or "©" in b.text or (len(b.text) >= SHORT and stop < FEW_STOPS):
            labels.append(BAD)
        elif len(b.text) >= LONG and stop >= FEW_STOPS or len(b.text) >= SHORT and stop >= MANY_STOPS:
            labels.append(GOOD)
        else:
            labels.append(OPEN)
    return labels


def final_labels(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks with the label of the nearest decided block of their region before or
    behind them; the ends of a page are bad, those of an article good. Of two that are
    equally near and differ, a heading follows the one behind it, another block the good one."""
    out, n = list(labels), len(found)
    at = 0
    while at < n:
        end = at
        while end < n and (found[end].region == ARTICLE) == (found[at].region == ARTICLE):
            end += 1
        edge = GOOD if found[at].region == ARTICLE else BAD
        behind, near = [(edge, 0)] * (end - at), (edge, end)
        for i in range(end - 1, at - 1, -1):
            near = (labels[i], i) if labels[i] != OPEN else near
            behind[i - at] = near
        before = (edge, at - 1)
        for i in range(at, end):
            if labels[i] != OPEN:
                before = (labels[i], i)
                continue
            (a, j), (b, k) = before, behind[i - at]
            nearer = a if i - j < k - i else b if k - i < i - j else max(a, b)
            out[i] = b if found[i].heading and found[i].region != ARTICLE else nearer
        at = end
    return out


def main_text(page: str | None) -> str:
    """The page's article, one block a line; empty if there is none."""
    found = blocks(page or "")
    labels = final_labels(found, first_labels(found)) if found else []
    return "\n".join(b.text for b, x in zip(found, labels, strict=True) if x == GOOD)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """``pages`` without ``markup``, plus ``text`` and ``n_chars`` (its code points), which
    replace columns of these names.

    One narrow pass without shuffle, in which only the markup goes to Python; pages of any
    length are read whole, in time that grows with their length. A null or empty page, and
    one without article text, gives an empty text and 0. Markup that is cut short or never closed is
    read as far as it goes. Repeated rows get equal results; further columns stay; an empty
    table gives an empty result.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series([main_text(p) for p in batch], dtype=object) for batch in batches)

    kept = without(pages, "text", "n_chars", markup)
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars", markup.lower())]
    out = pages.select(*[c.alias(f"c{k}") for k, c in enumerate(kept)], read.asNondeterministic()(named(markup)).alias("text"))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "text", F.length("text").cast("long").alias("n_chars"))
