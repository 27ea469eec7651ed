"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandbook.llm.common import lean, ship
from strandbook.llm.shingles import slices

# Element names of HTML and the usual names of page furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header hgroup html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Their content is no markup, and no text of the page either.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: No part of an article: as blocks, and within a line, which goes on behind them.
DROPPED = frozenset("nav aside footer dialog menu noscript template".split())
DROPPED_INLINE = frozenset("button select option label svg canvas audio video object".split())
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommend recommended recommendations related replies reply respond share sharing shoutbox sidebar skip social sponsor sponsored subscribe toc toolbar tooltip".split())
#: Of these, what is an advert within a line too; other names stand for words of a sentence there.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements sponsored".split())
#: Names that furniture has and others too: they count where the text consists of links.
DOUBTFUL = frozenset("disclaimer header meta overlay rail reaction reactions teaser widget".split())
LAYOUT = frozenset("no with without has is js".split())
#: What the other parts of a compound name of furniture are; with any other part a name only weighs.
PARTS = frozenset("after area bar before below block body bottom box btn button buttons card cards center col column container content cta feed form foot group head header holder icon icons inner item items left link links list main message modal module outer overlay page pane panel posts primary right row section signup site slot stories strip tag tags text thread title top unit wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Opening one of these ends an open one of the same group, up to a bound.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
#: A block of so many characters, with few of them in links, is prose.
PROSE = 80
#: Levels up to which a block passes points on.
LEVELS = 8

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|[\s/=]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "dropped", "furniture", "named", "doubtful", "points", "chars", "links", "anchors", "titled", "prose")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, furniture: bool = False, named: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.dropped, self.furniture, self.named, self.doubtful = tag, parent, dropped, furniture, named, doubtful
        self.points, self.chars, self.links, self.anchors, self.titled, self.prose = 0.0, 0, 0, 0, tag == "h1", False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """Every tag as (begin, end, name, whether it closes, attributes), and all else that is no text as (begin, end, "", ...); in one pass.

    A quote that nothing closes is part of an unquoted value. A tag that the page ends in has no end.
    """
    at, n = 0, len(page)
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            yield begin, at, "", False, {}
            continue
        if page[begin + 1:begin + 2] in ("!", "?"):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            yield begin, at, "", False, {}
            continue
        closes = page.startswith("</", begin)
        name = NAME.match(page, begin + 1 + closes)
        if not name:  # a sign like any other
            at = begin + 1
            continue
        at, found = name.end(), {}
        while at < n and page[at] != ">":
            part = ATTRIBUTE.match(page, at)
            if part[1]:
                found.setdefault(part[1].lower(), part[2] or part[3] or part[4] or "")
            at = part.end()
        at = min(at + 1, n)
        tag = name[0].lower()
        if tag in RAW and not closes:
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else n
            yield begin, at, "", False, {}
        else:
            yield begin, at, tag, closes, found


def marks(tag: str, found: dict[str, str]) -> tuple[bool, bool, bool, bool]:
    """Whether an element's attributes hide it, name it as page furniture, name something of furniture beside other words, or may do so."""
    if not found or tag in ("html", "body"):
        return False, False, False, False
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
    furniture, named, doubtful = found.get("role", "").lower() in ROLES, False, False
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    if tag not in ("main", "article"):
        for name in names:
            parts = [p for p in re.split(r"[-_:]+", name) if p]
            if name in FURNITURE:
                furniture = True
            elif tag in CONTAINERS and len(parts) > 1 and parts[0] not in LAYOUT and (parts[0] in FURNITURE or parts[-1] in FURNITURE):
                if all(p in FURNITURE or p in PARTS or p in DOUBTFUL or p.isdecimal() for p in parts):
                    furniture = True
                else:
                    named = True
            doubtful |= tag in CONTAINERS and bool(parts) and (parts[0] in DOUBTFUL or parts[-1] in DOUBTFUL)
    elif tag == "article":
        furniture |= any(re.split(r"[-_:]+", name)[0] in ("comment", "comments", "reply") for name in names)
    return hidden, furniture, named, doubtful


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int, int]]]:
    """The page's block elements in order, and its blocks of text: element, text, characters in links, links."""
    nodes = [Node("html", None)]
    stack, blocks, text = [nodes[0]], [], []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    holders = [0]  # and those of blocks
    links = anchors = at = 0
    linked = False

    def flush() -> None:
        nonlocal links, anchors
        if text:
            block = " ".join(references.unescape("".join(text)).split())
            text.clear()
            holder = stack[holders[-1]]
            if block and not holder.dropped:
                blocks.append((holder, block, min(links, len(block)), anchors))
        links = anchors = 0

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        if node.tag in BLOCKS:
            holders.append(len(stack))
            nodes.append(node)
        stack.append(node)

    def cut(upto: int) -> None:
        for x in stack[upto:]:
            opened[x.tag].pop()
            if x.tag in BLOCKS:
                holders.pop()
        del stack[upto:]

    def say(piece: str) -> None:
        nonlocal links
        if piece and (stack[-1].tag in BLOCKS or not stack[-1].dropped):
            text.append(piece)
            if linked:
                links += len(piece.strip())

    for begin, end, tag, closes, found in tags(page):
        say(page[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                linked = False
            if tag in BLOCKS:
                flush()
                linked = False
            if opened[tag]:
                cut(opened[tag][-1])
            continue
        if tag in ("br", "hr"):
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            continue
        if tag in VOID or tag in ("html", "body", "head"):
            continue
        hidden, furniture, named, doubtful = marks(tag, found)
        if tag in BLOCKS or tag in DROPPED:
            flush()
            linked = False
            top = len(stack)
            while top > 1 and (stack[top - 1].tag not in BLOCKS or stack[top - 1].tag == "p" or stack[top - 1].tag in HEADINGS and (tag in CONTAINERS and tag not in HEADINGS or tag == "p")):
                top -= 1
            cut(top)
            if tag in ENDS:
                last = lambda names: max((opened[x][-1] for x in names if opened[x]), default=0)
                ended = last(ENDS[tag])
                if ended > last(BOUNDS.get(tag, ("table",))):
                    cut(ended)
            page_header = tag == "header" and not (opened["article"] or opened["main"])
            dropped = stack[-1].dropped or hidden or tag in DROPPED or page_header
            push(Node(tag, stack[-1], dropped, furniture or tag == "form", named, doubtful))
        elif (hidden or tag in DROPPED_INLINE or furniture and not ADVERTS.isdisjoint(found.get("class", "").lower().split())) and end and page[end - 2:end] != "/>":
            push(Node(tag, stack[-1], True))
        elif tag == "a":
            linked = True
            anchors += 1
    say(page[at:])
    flush()
    return nodes, blocks


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines.

    Every block passes points, for being long and for its commas, to the
    container it stands in, half of them to the next one out, a third beyond that
    and so on; a container's points are discounted by the share of its text that
    is links, and by names of page furniture. The best one is widened to the
    article or main element around it. Its siblings with a fifth of its points
    are kept too, and what lies between, and headings right before. Furniture is
    left out, unless it holds the best container or a title; where a name has other
    words than furniture's, what it names is left out only if it holds no prose or
    consists of links. Within a line what is hidden is left out, controls and adverts.
    """
    nodes, blocks = blocks_of(page) if page else ([], [])
    if not blocks:
        return ""
    for node, block, linked, anchors in blocks:
        points = (1.0 if len(block) >= 25 else 0.0) + block.count(",") + min(len(block) / 100, 3.0)
        node.chars += len(block)
        node.links += linked
        node.anchors += anchors
        node.prose |= len(block) >= PROSE and linked < 0.25 * len(block)
        holder = node if node.tag in CONTAINERS else node.parent
        for level in range(LEVELS):
            if holder is None:
                break
            holder.points += points / (1, 2)[level] if level < 2 else points / (level * 3)
            holder = holder.parent
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.links += x.links
            x.parent.anchors += x.anchors
            x.parent.titled |= x.titled and not x.dropped
            x.parent.prose |= x.prose

    def score(x: Node) -> float:
        named = 25 if x.tag in ("article", "main") and x.chars else 0
        return (x.points * (1 - x.links / max(x.chars, 1)) + named) * (0.2 if x.furniture else 0.6 if x.named else 1)

    tainted: dict[Node, bool] = {}
    for x in nodes:  # parents come first
        tainted[x] = x.furniture or x.parent is not None and tainted[x.parent]
    holders = [x for x in nodes if x.tag in CONTAINERS and x.chars and not x.dropped]
    best = max(holders, key=lambda x: score(x) * (0.2 if tainted[x] and not x.furniture else 1))
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around if around is not None and not around.dropped else best
    above, x = set(), best
    while x is not None:
        above.add(x)
        x = x.parent

    def out(x: Node) -> bool:
        if x in above:
            return False
        if x.furniture:
            return not x.titled
        if x.named and x.chars:
            return not x.titled and (not x.prose or x.links >= 0.5 * x.chars)
        if x.doubtful and x.chars and x.links >= 0.5 * x.chars:
            return True
        return x.tag in ("ul", "ol", "dl", "div", "table", "section") and x.anchors >= 3 and x.links >= 0.8 * x.chars

    left: dict[Node, bool] = {}
    unit: dict[Node, Node | None] = {}  # what stands beside the best container, or is it
    for x in nodes:
        left[x] = out(x) or x.parent is not None and left[x.parent]
        unit[x] = x if x is best or x.parent is not None and x.parent is best.parent else unit[x.parent] if x.parent is not None else None
    rows = [(unit[node], node, block, linked) for node, block, linked, _ in blocks if not left[node] and unit[node] is not None]
    least = max(10.0, 0.2 * score(best))

    def stays(u: Node, node: Node, block: str, linked: int) -> bool:
        if u is best:
            return True
        return score(u) >= least if u.tag in CONTAINERS else len(block) >= 80 and linked < 0.25 * len(block)

    sure = [k for k, row in enumerate(rows) if stays(*row)]
    if not sure:
        return ""
    lo, hi = sure[0], sure[-1]
    while lo and rows[lo - 1][0].tag in HEADINGS:
        lo -= 1
    kept = set(sure)
    kept |= {k for k in range(lo, hi + 1) if rows[k][0].tag not in CONTAINERS or rows[k][0].tag in HEADINGS}
    return "\n".join(rows[k][2] for k in sorted(kept))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if there is none) and ``n_chars`` (its code points) for its ``html``.

    Null pages count as empty; all other columns pass through, and ones named
    text or n_chars are replaced. Broken, cut off and very long pages are read in
    one pass, whatever their marks. Repeated rows stay; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    rest = pages.select(*(c for c in pages.columns if c not in (html, "text", "n_chars")), html)
    at = len(rest.columns) - 1
    schema = rest.drop(html).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return rest.mapInArrow(lean(run), schema)
