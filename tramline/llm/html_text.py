"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; what stands in elements that hold no article text by their name (navigation,
headers, footers, asides, forms, dialogs, scripts and the like) is no block. Pass one adds up the evidence of each block alone:
its length, its stop-word density, its link density, and a hint of the elements it stands in. Much evidence makes a block good, less than none bad; between,
a block is near (of some length) or short. Where no block is good, those of the most evidence are. Short blocks before the page's first heading are bad.

A hint is no verdict: it weighs as much as the densities may, at most. An article or main element speaks for its blocks; a class, id or role that names an
advert, notice, menu, sidebar or comment section, or an element that isn't shown, speaks against them. Such a name on an article or main element
counts only where that is nested, as comments are; and nothing counts against most of a page's text if
what is left has no article element and no block that is good by itself.

Pass two settles near blocks and then short ones by their nearest decided neighbours, one on each side; a neighbour in another
container that gives a hint counts as ELSEWHERE blocks further, and for nothing where the block's own hint speaks against it. If both have the same label, or
there is one alone, the block takes it. If they differ, near blocks are good, a short heading goes with the good text after it, and other short
blocks take the label of the closer neighbour, bad if both are as close.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_workers, pick

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: One attribute after the other, so that no name is found within another or within a value.
ATTRIBUTE = re.compile(r"[\s/]*([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?|[\"'=]")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of HTML, and words of class and id names.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary svg table tbody td template tfoot th thead title tr ul video audio canvas object".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed frame hr img input keygen link meta param source track wbr".split())
DROPPED = set("head nav footer aside form dialog menu noscript template select button svg canvas object audio video fieldset search option datalist map".split())
CLOSES_LIKE = ({"li"}, {"td", "th"}, {"dt", "dd"})
CLOSES_P = BLOCKS - set("body head html option button noscript title svg video audio canvas object select".split())
MARKED = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead topbar footer sidebar rail aside "
    "cookie cookies consent gdpr notice notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies reader related recommended recommendations share sharing social widget "
    "form search toolbar skip copyright".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Frequent function words.
STOP_WORDS = set(
    "the of and to a in is it you that he was for on are with as i his they be at one have this from or had by but not what all were we when your can "
    "said there use an each which she do how their if will up other about out many then them these so some her would has him into no could my than been who its now "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d l n s qu cette ont ou mais comme on tout nous sa "
    "fait été aussi leur bien peut ces y deux elle même "
    "el los las del que y en a un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy "
    "hasta desde está mi porque qué sólo han yo hay vez puede todos".split()
)
WORD = re.compile(r"[^\W\d_]+")

#: Characters of text from which a block is of some length, and from which it is long; densities of stop words and links.
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS, LINKED, ALL_LINKED = 0.15, 0.30, 0.34, 0.9
#: Evidence: a point for each of the two lengths, and these; from GOOD on a block is good, under 0 bad. NAMED takes away no more than lengths and stop words can give.
STOPS_FOR, STOPS_AGAINST, LINKS, MENU, ARTICLE, NAMED, GOOD = 1, -2, -2, -4, 2, -3, 3
#: How many blocks further a neighbour in another container counts.
ELSEWHERE = 1000


def _marked(attributes: str) -> bool:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id") and any(w.lower() in MARKED for w in NAME.findall(value)):
            return True
    return False


class Block:
    """Text, its linked characters, whether it is a heading, and the innermost container that gives a hint: its number and the hint."""

    __slots__ = ("heading", "hint", "linked", "parts", "place", "text")

    def __init__(self, within: tuple[int, int]):
        self.parts: list[str] = []
        self.linked, self.text, self.heading = 0, "", False
        self.place, self.hint = within


class Container:
    """An element whose name or attributes say something of what is in it."""

    __slots__ = ("article", "marked", "size", "up")

    def __init__(self, up: int, article: bool, marked: bool):
        self.up, self.article, self.marked, self.size = up, article, marked, 0


def weigh(blocks: list[Block], containers: list[Container]) -> None:
    """Give each block the hint of the containers it stands in; the first one stands for the page."""

    def chain(k: int) -> Iterator[Container]:
        while k:
            yield containers[k]
            k = containers[k].up

    total = 0
    for b in blocks:
        total += len(b.text)
        for c in chain(b.place):
            c.size += len(b.text)
    for k, c in enumerate(containers):
        if c.article and c.marked:  # the name of an article's own counts where it is nested
            c.marked = any(x.article or x.marked for x in chain(c.up))
            c.article = not c.marked
    most = [c for c in containers if c.marked and 2 * c.size > total]
    rest = [b for b in blocks if not any(c.marked for c in chain(b.place))] if most else []
    if not any(own_evidence(b) >= GOOD or any(c.article for c in chain(b.place)) for b in rest):
        for c in most:
            c.marked = False
    hints = [0] * len(containers)
    for k in range(1, len(containers)):
        for c in chain(k):
            if c.marked:
                hints[k] += NAMED
                break
            if c.article and not hints[k]:
                hints[k] = ARTICLE
    for b in blocks:
        b.hint = hints[b.place]


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order, without those of dropped elements."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, dropped, container
    containers = [Container(0, False, False)]
    inside = articles = 0  # the container at hand, and how many article or main elements are open
    dropped = False
    links = 0
    block = Block((0, 0))

    def end() -> None:
        nonlocal block
        if block.parts:
            block.text = SPACE.sub(" ", "".join(block.parts)).strip()
            if block.text:
                out.append(block)
        block = Block((inside, 0))

    def text(raw: str) -> None:
        if raw and not dropped:
            t = unescape(raw) if "&" in raw else raw
            block.parts.append(t)
            if links:
                block.linked += len("".join(t.split()))

    def close(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal dropped, inside, links, articles
        links = max(0, links - sum(x[0] == "a" for x in stack[k:]))
        articles -= sum(x[0] in ("article", "main") for x in stack[k:])
        del stack[k:]
        _, dropped, inside = stack[-1] if stack else ("", False, 0)

    def innermost(name: str) -> int | None:
        return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m[2].lower()
        if m[1]:
            k = innermost(name)
            if name == "br" or name == "p" and k is None:
                text(" ")
                if name == "p":
                    end()
                continue
            if k is None or name not in BLOCKS and any(x[0] in ("article", "main", "body", "div", "section") for x in stack[k:]):
                continue  # nothing to close, or a stray inline tag across containers
            if name in BLOCKS:
                end()
            close(k)
            if name in BLOCKS:
                end()
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else n
            if name in BLOCKS:
                end()
            continue
        if name == "br":
            text(" ")
            continue
        if name in CLOSES_P and (k := innermost("p")) is not None:
            close(k)
        if stack and any(name in same and stack[-1][0] in same for same in CLOSES_LIKE):
            close(len(stack) - 1)
        if name in BLOCKS:
            end()
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            block.place = inside
            continue
        # a header within an article may hold its heading
        dropped = dropped or name in DROPPED or name == "header" and not articles
        article, marked = name in ("article", "main"), _marked(m[3]) and name not in ("html", "body")
        if article or marked:
            containers.append(Container(inside, article, marked))
            inside = len(containers) - 1
        articles += article
        stack.append((name, dropped, inside))
        links += name == "a"
        if name in BLOCKS:
            end()
            block.heading = name in HEADINGS
    end()
    weigh(out, containers)
    return out


def own_evidence(b: Block) -> int:
    """What a block's length and densities speak for it, as points."""
    size = len(b.text)
    points = (size >= SHORT) + (size >= LONG)
    if size >= SHORT:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        points += STOPS_FOR if stops >= MANY_STOPS else STOPS_AGAINST if stops < FEW_STOPS else 0
    linked = b.linked / max(1, len(b.text.replace(" ", "")))
    if linked > LINKED:
        points += MENU if linked > ALL_LINKED and size >= SHORT else LINKS
    return points


def evidence(b: Block) -> int:
    return own_evidence(b) + b.hint


def decide_alone(blocks: list[Block]) -> list[str]:
    """Pass one: good, bad, near or short."""
    points = [evidence(b) for b in blocks]
    good = min(GOOD, max([0, *points]))  # where none is good, those of the most evidence
    labels = ["good" if x >= good else "bad" if x < 0 else "near" if x > 0 and len(b.text) >= SHORT else "short" for b, x in zip(blocks, points, strict=True)]
    first = next((i for i, b in enumerate(blocks) if b.heading), 0)
    if "good" not in labels[:first]:
        labels[:first] = ["bad" if x == "short" and b.hint <= 0 else x for b, x in zip(blocks[:first], labels, strict=False)]
    return labels


def _nearest(blocks: list[Block], labels: list[str], order: range) -> list[tuple[str, int]]:
    """For each block the label and distance of its nearest decided neighbour among those before it in the order."""
    out = [("", 0)] * len(blocks)
    last: dict[int, int] = {}  # of each container its last decided block
    any_last = -1
    for i in order:
        own, far = last.get(blocks[i].place, -1), any_last
        if own >= 0:
            out[i] = (labels[own], abs(i - own))
        if far >= 0 and blocks[far].place != blocks[i].place and (own < 0 or abs(i - far) + ELSEWHERE < abs(i - own)):
            out[i] = (labels[far], abs(i - far) + ELSEWHERE)
        if labels[i] in ("good", "bad"):
            last[blocks[i].place] = any_last = i
    return out


def decide_by_neighbours(blocks: list[Block], labels: list[str]) -> list[str]:
    """Pass two: good or bad for all."""
    for kind in ("near", "short"):
        settled = list(labels)
        n = len(blocks)
        for i, ((before, back), (after, on)) in enumerate(zip(_nearest(blocks, labels, range(n)), _nearest(blocks, labels, range(n - 1, -1, -1)), strict=True)):
            if labels[i] != kind:
                continue
            if blocks[i].hint < 0:
                before, after = before if back < ELSEWHERE else "", after if on < ELSEWHERE else ""
            if before == after or not before or not after:
                settled[i] = before or after or "bad"
            elif kind == "near" or blocks[i].heading and after == "good":
                settled[i] = "good"
            else:
                settled[i] = before if back < on else after if on < back else "bad"
        labels = settled
    return labels


def main_text(html: str | None) -> str:
    """The main text: good blocks, one to a line. Null or no good block: empty."""
    blocks = blocks_of(html) if html else []
    labels = decide_by_neighbours(blocks, decide_alone(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == "good")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text; repeated rows and null ids give rows of their own; other columns are ignored. The
    whole of each page is read, whatever its length; the time is proportional to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return on_workers(pick(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
