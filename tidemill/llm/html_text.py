"""Main text of web pages by two passes of block rules.

A tolerant scanner cuts the page into blocks at block-level tags and knows what each stands in: an article or
main element, a menu, footer, form and so on, or any block whose class or id names such a part (inside an article only by
a whole name such as "share", elsewhere also by a name made of such words and others that say nothing, as in
"site-footer" or "ad-box" but not "share-price").  The first
pass decides a block by where it stands, its link density, its length and its density of stop words.  Blocks
that this leaves open, mostly short ones and those in languages whose stop words are not known, inherit in the second pass the label of
the nearest decided neighbours within the same article (without one, within the page); where those differ the nearer one counts,
and at equal distance the good one.  Where stop words decide no block of a page without articles, length and link density do so alone.
A block of an article with no decided neighbour is kept, others are not.  Articles hide what stands outside them, unless more text
is kept there than in all of them, as on a page with a teaser card.

Edge cases: null and empty pages give an empty text; unclosed tags, quotes and comments end with the page;
character references are decoded once, each run of text between two tags by itself; text of hidden elements goes; repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text.
RAW = "script|style|template|noscript|iframe|object|svg|math|canvas|textarea|select|title"
SCAN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][\w:-]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
#: Elements that end a block where they begin and end.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Block elements whose nesting is followed; the others may stay unclosed without harm.
NESTED = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form head header main menu nav ol section table ul".split())
#: Parts of a page that are no article text.
BOILERPLATE = frozenset("aside button dialog footer form head menu nav".split())
MAIN = frozenset(["article", "main"])
VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
#: Words of class, id and role attributes that name such parts; inside an article, their whole tokens.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer disqus dropdown form gdpr login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Those that an article's own section may be about; inside an article their parts go as forms or by their links.
TOPICS = frozenset("search social tags".split())
#: Those that name a page's part only outside an article, and only as a container.
OUTER_HINTS = HINTS | frozenset("header footer head foot top bottom".split())
#: Words that may stand beside them in a name without changing what it says.
PLAIN = frozenset("site page main global primary secondary inner outer left right center sticky fixed floating mobile desktop box wrap wrapper container section block list area bar item items row col column columns panel strip slot unit zone region group holder content body text title link links button buttons icon icons form field input user post posts article articles stories story news topics reader readers thread count overlay popover module component info meta small large mini by us our all js".split())
#: Blocks that another one of the named kinds ends where their own end tag is left out.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}, "p": BLOCKS} | dict.fromkeys(HEADINGS, HEADINGS)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: What a block begins with that is a copyright notice; a bare "(c)" may be an item of a list.
COPYRIGHT = re.compile(r"©|\(c\) (?:(?i:copyright)\b|(?:1[89]|20)\d\d\b)")
WORD = re.compile(r"[^\W\d_]+")
#: The commonest words of some languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with be at by this from or an not he his have had they which but were there we can all has their if will one about so no more when who what out up into than them then its only
    de la le les et des en du un une que est pour qui dans a par plus pas au sur ne se ce il sont avec aux ou son
    el los las y del se por con no su para es al lo como mas o pero sus una sin sobre
    der die und in den von zu das mit sich des auf fur für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem uber über einen so zum war
    il di che e per non si da con del sono una della ha o da os as um uma em para com nao não dos het van een""".split()
)
LINKED, SHORT, STOPPED = 0.4, 60, 0.15
#: A copyright notice is shorter than this, or reserves rights.
NOTICE = 80
RESERVED = re.compile(r"\bcopyright\b|rights reserved", re.I)
#: Scripts that write a word in a character or two.
DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
#: Classes that show from some screen width on what "hidden" hides below it.
SHOWN = re.compile(r"(?:sm|md|lg|xl|2xl):(?:block|flex|grid|inline|inline-block|inline-flex|contents|table|table-cell|table-row)")


@dataclass
class Piece:
    """A block: its text, where it stands, and its label (True, False or open)."""

    text: str
    scope: int  # number of the article or main element it is in, 0 for none
    out: bool  # stands in a part that is no article text
    linked: int  # characters inside links
    label: bool | None = None


def attributes_of(rest: str) -> dict[str, str]:
    """The attributes of a tag by their lower-case names; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(value))
    return found


def hidden(attributes: dict[str, str], tokens: set[str]) -> bool:
    """A hidden attribute, aria-hidden, an inline display:none or the class "hidden" at all widths; no other use of the word."""
    return (
        attributes.get("hidden", "false").strip().lower() in ("", "hidden", "true")
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or ("hidden" in tokens and not any(SHOWN.fullmatch(t) for t in tokens))
        or bool(UNDISPLAYED.search(attributes.get("style", "")))
    )


def named_part(attributes: dict[str, str], hints: frozenset, scope: int) -> bool:
    """Whether class, id or role name a part of the page that is no article text."""
    tokens = " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split()
    if scope:  # an article's own sections may hold such a word in a longer name
        return not (HINTS - TOPICS).isdisjoint(t.lower() for t in tokens)
    for token in tokens:
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if len(w) > 1]
        if not hints.isdisjoint(words) and all(w in hints or w in PLAIN or len(w) == 2 for w in words):
            return True
    return False


def cut_blocks(page: str) -> list[Piece]:
    found: list[Piece] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # name, boilerplate, scope
    scopes, anchors = 0, 0
    veiled, depth = "", 0  # a hidden inline element, and how many of its name are open
    buffer: list[tuple[str, bool]] = []

    def take(text: str, linked: bool) -> None:
        if not veiled:
            buffer.append((html.unescape(text), linked))

    def flush() -> None:
        if buffer:
            text = " ".join("".join(t for t, _ in buffer).split())
            if text:
                linked = sum(len("".join(t.split())) for t, inside in buffer if inside)
                found.append(Piece(text, stack[-1][2], stack[-1][1], linked))
            buffer.clear()

    at = 0
    for m in SCAN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()], anchors > 0)
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m["raw"]:
                take(" ", False)
            continue
        ending = bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        if name not in BLOCKS:
            if name == veiled:
                depth += -1 if ending else 1
                veiled = veiled if depth else ""
            elif not veiled and rest and not ending and name not in VOID:
                attributes = attributes_of(rest)
                attributes.pop("aria-hidden", None)  # on an inline element it hides nothing from the eye
                if hidden(attributes, set(attributes.get("class", "").lower().split())):
                    veiled, depth = name, 1
            if name == "a":
                anchors = 0 if ending else 1
            elif name == "br":
                take(" ", False)
            continue
        flush()
        veiled, anchors = "", 0
        if ending:
            # an element that may stay open is looked for in its own container only
            k = len(stack) - 1
            while k > 0 and stack[k][0] != name and (name in NESTED or stack[k][0] not in NESTED):
                k -= 1
            if k > 0 and stack[k][0] == name:
                del stack[k:]
            continue
        if name == "body":  # whatever the head left open ends here
            del stack[1:]
        while name in ENDED_BY.get(stack[-1][0], ()):
            stack.pop()
        _, out, scope = stack[-1]
        attributes = attributes_of(rest) if rest else {}
        nested = name in NESTED
        marked = name in BOILERPLATE or (name == "header" and not scope)
        if attributes:
            if name not in ("body", *MAIN):
                marked |= named_part(attributes, OUTER_HINTS if nested else HINTS, scope)
            marked |= hidden(attributes, set(attributes.get("class", "").lower().split()))
        if name in MAIN and not out and not marked and not scope:
            scopes += 1
            scope = scopes
        if nested or marked:
            stack.append((name, out or marked, scope))
    if at < len(page):
        take(page[at:], anchors > 0)
    flush()
    return found


def weight(text: str) -> int:
    """The length of a text; a character of a dense script counts for three."""
    return len(text) + 2 * len(DENSE.findall(text))


def first_pass(piece: Piece) -> bool | None:
    if piece.out or (COPYRIGHT.match(piece.text) and (len(piece.text) < NOTICE or RESERVED.search(piece.text))):
        return False
    letters = sum(not c.isspace() for c in piece.text) if piece.linked else 0
    if piece.linked and piece.linked >= LINKED * letters:
        return False
    if weight(piece.text) < SHORT:
        return None
    words = WORD.findall(piece.text.lower())
    stopped = sum(w in STOP_WORDS for w in words)
    return True if stopped >= STOPPED * max(len(words), 1) else None


def second_pass(pieces: list[Piece], whole: bool) -> list[bool]:
    """Final labels; ``whole`` says that the pieces are those of one article."""
    n = len(pieces)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if pieces[i].label is not None else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if pieces[i].label is not None else last
        after[i] = last
    out = []
    for i, p in enumerate(pieces):
        near = [(abs(i - k), not pieces[k].label) for k in (before[i], after[i]) if k is not None]
        out.append(p.label if p.label is not None else (not min(near)[1] if near else whole))
    return out


def main_text(page: str | None) -> str:
    pieces = cut_blocks(page or "")
    for p in pieces:
        p.label = first_pass(p)
    if not any(p.label for p in pieces):  # no language that is known here
        for p in pieces:
            if p.label is None and not p.scope and weight(p.text) >= SHORT:
                p.label = True
    kept: dict[int, bool] = {}
    for scope in {p.scope for p in pieces}:
        # parts that are no article text say nothing about an article's own open blocks
        own = [i for i, p in enumerate(pieces) if p.scope == scope and not (scope and p.out)]
        kept |= dict(zip(own, second_pass([pieces[i] for i in own], scope > 0), strict=True))
    inside = sum(len(pieces[i].text) for i, v in kept.items() if v and pieces[i].scope)
    outside = sum(len(pieces[i].text) for i, v in kept.items() if v and not pieces[i].scope)
    return " ".join(pieces[i].text for i in sorted(kept) if kept[i] and (bool(pieces[i].scope) == (inside >= outside)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(p.as_py()) for p in part.column(2)], pa.string())], schema=schema)


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html): text and n_chars of each row."""
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return whole.mapInArrow(_extract, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
