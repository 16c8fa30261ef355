"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can: blocks made of links, copyright lines and
blocks inside menus, footers, sidebars, forms, adverts, notices and comments are boilerplate; long blocks rich in stop words
are text; the rest is ambiguous. An element that is named as the article bounds the text only if the text that this pass has
found bears it out. In the second pass, ambiguous blocks take the label of the nearest decided neighbour, first within their
own section of the page. Every step is linear in the page, whatever its markup.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

# A tag ends at the first > outside quotes. Quotes count behind = only, and an unquoted < ends a tag that isn't closed, so no
# stretch of a page is looked at again and again.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|</?[a-zA-Z][^<>]*+>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_TAIL = re.compile(r"</?[a-zA-Z!?][^<]*\Z", re.S)
#: Elements whose inside isn't text of the page. Those of the second group hold markup, so one that is never closed is an
#: element like others; one of the first group goes to the end of the page.
_RAW = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in "script style title textarea iframe noscript template svg object canvas select button audio video".split()}
_TO_THE_END = frozenset("script style title textarea iframe".split())
_ATTR = re.compile(r"(?<![a-zA-Z:-])([a-zA-Z:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_FRAME = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul td li p".split())
_SECTION = _FRAME - frozenset("p li ul ol dl blockquote figure".split())
_BAD_TAG = frozenset("nav footer aside menu dialog fieldset".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog note".split())
_BAD_WORD = frozenset(
    "ad ads adv advert advertisement advertisements advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login register "
    "sidebar aside menu nav navbar navigation navi breadcrumb breadcrumbs header masthead topbar footer copyright social share sharing related recommended recommendations teaser comment comments commentlist disqus respond reply replies discussion "
    "form search pager pagination toolbar widget".split()
)
_COMMENT_WORD = frozenset("comment comments reply ad advert sponsored teaser related promo".split())
_GOOD_WORD = frozenset("article story entry post content main maincontent".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"\w+")
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on one or she so than that the their them there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und vom von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cuando del desde el ella en entre era es esta este ha hay la las lo los más me muy no o para pero por porque que se si sin sobre su sus también te todo un una y ya".split()
)

BAD, UNSURE, GOOD = -1, 0, 1
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_ENDS_P = _HEADING | frozenset("div article section ul ol table footer nav aside header main form".split())
SCHEMA = "text string, n_chars long, n_blocks int, n_kept int"


class Block(NamedTuple):
    """A stretch of text between block-level tags: characters in links, what the frame around it says, its innermost section,
    whether it is a heading."""

    text: str
    linked: int
    kind: int
    number: int
    sure: bool
    section: int
    heading: bool


class _Frame:
    """An open element, and what it says of the text in it: kind, number of the element that says so, whether for sure, and
    number of the innermost section."""

    __slots__ = ("tag", "kind", "number", "sure", "inside", "section")

    def __init__(self, tag: str, kind: int, number: int, sure: bool, inside: bool, section: int) -> None:
        self.tag, self.kind, self.number, self.sure, self.inside, self.section = tag, kind, number, sure, inside, section


def _kind(tag: str, attrs: str, inside: bool) -> tuple[int, bool]:
    """(BAD, UNSURE or GOOD for what an element holds, whether an element inside may overrule it)."""
    kind, soft = UNSURE, False
    if tag in _BAD_TAG or (tag == "header" and not inside):
        kind = BAD
    elif tag == "form":
        kind, soft = BAD, True
    elif tag in ("article", "main"):
        kind = GOOD
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return kind, soft
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    role = found.get("role", "").lower()
    if role in _BAD_ROLE:
        return BAD, False
    if role in ("main", "article"):
        return GOOD, False
    if "hidden" in re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs).lower().split() or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return BAD, False
    if tag in ("html", "body", "main"):
        return kind, soft
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if tag == "article":
        return (BAD, False) if words & _COMMENT_WORD else (kind, soft)
    bad = words & _BAD_WORD
    if inside:
        bad -= {"header", "form", "search"}
    if bad:
        return BAD, False
    if kind == UNSURE and words & _GOOD_WORD and tag in ("div", "section", "td"):
        return GOOD, True
    return kind, soft


def blocks(page: str) -> list[Block]:
    """All blocks of a page with text, in order."""
    out: list[Block] = []
    stack = [_Frame("", UNSURE, 0, False, False, 0)]
    depth: dict[str, int] = {}  # open elements by tag
    unclosed: set[str] = set()
    parts: list[str] = []
    linked, in_link, at, frames, heading = 0, 0, 0, 0, False

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            out.append(Block(text, linked, top.kind, top.number, top.sure, top.section, heading))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len("".join(piece.split()))

    def push(tag: str, attrs: str) -> None:
        above = stack[-1]
        kind, soft = _kind(tag, attrs, above.inside)
        inside = above.inside or (kind == GOOD and not soft)
        section = frames if tag in _SECTION else above.section
        if above.kind == BAD and above.sure or kind == UNSURE:  # nothing inside firm boilerplate is text
            stack.append(_Frame(tag, above.kind, above.number, above.sure, inside, section))
        else:
            stack.append(_Frame(tag, kind, frames, not soft, inside, section))
        depth[tag] = depth.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop().tag
        depth[tag] -= 1
        return tag

    close = page.rfind(">") + 1  # tags that begin behind the last > have no end
    while m := _TOKEN.search(page, at, close):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, end = tag.lower(), bool(m["end"])
        if tag in _RAW and not end and tag not in unclosed and not m["attrs"].endswith("/"):
            if last := _RAW[tag].search(page, at):
                at = last.end()
                continue
            if tag in _TO_THE_END:
                at = len(page)
                break
            unclosed.add(tag)
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if end else 1
        elif tag in _BLOCK:
            flush()
            heading = tag in _HEADING and not end
            if tag in _FRAME:
                if not end:
                    if tag in ("p", "li", "td") and stack[-1].tag == tag or tag in _ENDS_P and stack[-1].tag == "p":
                        pop()  # a paragraph ends where another block begins
                    frames += 1
                    if not m["attrs"].endswith("/"):
                        push(tag, m["attrs"])
                elif depth.get(tag):
                    while pop() != tag:
                        pass
            elif tag in _HEADING and stack[-1].tag == "p":
                pop()
            in_link = 0
    if at < len(page):
        rest = page[at:]
        add(_TAIL.sub("", rest) if at >= close else rest)
    flush()
    return out


def _first_pass(items: list[Block], short: int, sure: int, dense: float, most_links: float) -> list[int]:
    """GOOD, BAD or UNSURE by link density, length and stop words alone, but for blocks in frames that are boilerplate."""
    labels = []
    for b in items:
        links = b.linked / max(1, len(b.text) - b.text.count(" "))
        named = b.kind == GOOD and b.sure
        if b.kind == BAD or links > (0.8 if b.kind == GOOD else most_links):
            labels.append(BAD)
        elif not named and len(b.text) < 3 * short and _COPYRIGHT.match(b.text):
            labels.append(BAD)
        elif len(b.text) < short:
            labels.append(UNSURE if links == 0 or b.kind == GOOD else BAD)
        else:
            words = _WORD.findall(b.text.lower())
            density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            # between the two lengths, only a frame's name makes a block certain
            labels.append(GOOD if density >= dense and (named or len(b.text) >= sure) else UNSURE)
    return labels


def _second_pass(items: list[Block], labels: list[int], short: int) -> list[int]:
    """Undecided blocks take the label of the nearest decided block of their own section, else of the frame that names it, else
    of the page. Of two different ones, a heading takes the one that follows; of two as near, the frame's name decides. On a
    page without any good block, long undecided blocks are text, or if there are none, those from the first heading on."""
    n, labels = len(items), labels.copy()
    if GOOD not in labels and not any(b.kind == GOOD for b in items):
        head = next((k for k in range(n) if items[k].heading and labels[k] == UNSURE), n)
        long = [k for k in range(n) if labels[k] == UNSURE and len(items[k].text) >= short]
        for k in long or [k for k in range(head, n) if labels[k] == UNSURE]:
            labels[k] = GOOD
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        nearest: list[tuple] = [()] * n
        last, by_section, by_frame = None, {}, {}
        for k in order:
            if labels[k] != UNSURE:
                last = by_section[items[k].section] = by_frame[items[k].number] = (k, labels[k])
            else:
                nearest[k] = (by_section.get(items[k].section), by_frame.get(items[k].number), last)
        sides.append(nearest)
    out = labels.copy()
    for k in range(n):
        if labels[k] != UNSURE:
            continue
        choice = UNSURE
        for before, after in zip(sides[0][k], sides[1][k]):
            if before and after and before[1] != after[1]:
                nearer = k - before[0] - (after[0] - k)
                if items[k].heading or nearer > 0:
                    choice = after[1]
                elif nearer < 0:
                    choice = before[1]
                else:
                    choice = GOOD if items[k].kind == GOOD else BAD
            elif before or after:
                choice = (before or after)[1]
            elif items[k].kind == GOOD:
                choice = GOOD
            if choice != UNSURE:
                break
        out[k] = choice if choice != UNSURE else GOOD
    return out


def classify(items: list[Block], short: int = 70, sure: int = 140, dense: float = 0.2, most_links: float = 0.4, trust: float = 0.25) -> list[int]:
    """GOOD or BAD for each block.

    Text that the first pass finds good weighs a page's named article: if at least ``trust`` of it stands there, the article
    is where the page says, and blocks elsewhere are boilerplate; else the name counts for nothing."""
    labels = _first_pass(items, short, sure, dense, most_links)
    named = [b.kind == GOOD and b.sure for b in items]
    inside = sum(len(b.text) for b, label, own in zip(items, labels, named) if label == GOOD and own)
    every = sum(len(b.text) for b, label in zip(items, labels) if label == GOOD)
    if any(named):
        if inside >= trust * every and (inside or not every):
            labels = [label if own else BAD for label, own in zip(labels, named)]
        else:
            items = [b._replace(kind=UNSURE, sure=False) if own else b for b, own in zip(items, named)]
            labels = _first_pass(items, short, sure, dense, most_links)
    return _second_pass(items, labels, short)


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, kept blocks) of a page."""
    if not page:
        return "", 0, 0
    items = blocks(page)
    kept = [b.text for b, label in zip(items, classify(items)) if label == GOOD]
    return "\n\n".join(kept), len(items), len(kept)


def _worker():
    def work(column: pa.Array) -> dict:
        found = [main_text(x) for x in column.to_pylist()]
        return {"text": pa.array([f[0] for f in found], pa.string()), "n_chars": [len(f[0]) for f in found], "n_blocks": pa.array([f[1] for f in found], pa.int32()), "n_kept": pa.array([f[2] for f in found], pa.int32())}

    return work


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of ``df``: id, ``keep`` columns, text, n_chars, number of blocks and of kept ones.

    Null and empty pages, and pages without text, have an empty text. Repeated rows stay, an empty table gives an empty
    result; other columns are ignored. A kept column may not be called like a column of the result.
    """
    if clash := {c.lower() for c in (id_col, *keep)} & {x.split()[0] for x in SCHEMA.split(", ")}:
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    return map_text(df, [id_col, *keep], html_col, SCHEMA, lambda: _worker())
