"""Main text of web pages by tree scoring.

The tags of a page become a tree. Every paragraph gives points for its commas and its length to its parent and half of them
to its grandparent, each container's sum is discounted by the share of its text that stands in links, and the best
container is the article. Its blocks stay, and so do siblings that score nearly as well. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are no part of the tree that is scored. What only its class,
id or role calls so stays when it holds an article or half of the page's text, and then counts for less.

Cases: null and empty html, and pages without text, give the empty text. Unclosed and misplaced tags are repaired as browsers
do for the common ones. Repeated rows are read one by one, ids and URLs may be null, extra columns are ignored, pages of any
length are read whole, in time that grows with their length; empty in, empty out.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.shared import travels

travels(__name__)

RAW = re.compile(r"<(script|style|noscript|template|svg|textarea|select|iframe)\b[^>]*>", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg textarea select iframe".split()}
LETTER, STOP = re.compile("</?[a-zA-Z]"), re.compile("[>\"']")
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>/=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
             "h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = set("head nav footer aside form button dialog menu title".split())
FURNITURE = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie "
                "cookies consent disclaimer disqus footer gdpr masthead menu menubar nav navbar navigation newsletter notice notification "
                "pager pagination popup promo promoted recommended related replies respond search share sharing sidebar "
                "signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that a name may have beside those: "site-footer" is furniture; "with-sidebar" and "search-results" are not.
PLAIN = set("area articles bar block bottom box buttons container form global icons inner item items left link links list main outer page post "
            "posts primary right secondary section site top wrap wrapper".split())
CONTENT = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A number in a character reference that names no character, however long it is; and zeros before a number.
NO_CHARACTER, ZEROS = re.compile("&#0*[1-9][0-9]{7,};?"), re.compile("&#0+(?=[0-9])")
#: What prose in an element with such a name counts for.
LOWERED = 0.5
P, CELLS, BEFORE_ARTICLE = {"p"}, {"td", "th", "table"}, DROPPED | {"header", "ul", "ol", "p"}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "dropped", "named", "holds", "gone", "lowered", "near", "chars", "points", "length", "linked")

    def __init__(self, tag, parent, dropped, named=False):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.holds = False  # an article or main
        self.near = None
        self.chars = self.points = self.length = self.linked = 0


class Path:
    """The open elements, with the depths at which each tag is open; going up costs as much as coming down did."""

    def __init__(self):
        self.root = Node("html", None, False)
        self.nodes, self.path, self.open = [self.root], [self.root], {"html": [0]}

    def push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Leave the elements from ``depth`` on."""
        while len(self.path) > depth:
            self.open[self.path.pop().tag].pop()

    def deepest(self, tags) -> int:
        depth = -1
        for tag in tags:
            at = self.open.get(tag)
            if at and at[-1] > depth:
                depth = at[-1]
        return depth

    def inside(self, tags) -> bool:
        return self.deepest(tags) >= 0

    def close(self, tags, stop=()) -> None:
        """Leave the nearest element of ``tags``, unless one of ``stop`` is nearer."""
        depth = self.deepest(tags)
        if depth > 0 and (not stop or depth > self.deepest(stop)):
            self.cut(depth)

    def leave_all(self, tags) -> None:
        self.cut(max(1, min((self.open[t][0] for t in tags if self.open.get(t)), default=len(self.path))))


def tokens(page: str):
    """(token, whether it is a tag) in page order, without comments, declarations and elements whose text is no prose.

    Every step goes on where the one before ended, and what is known to be missing ahead is not looked for again. A tag ends
    at the first bracket outside quotes; a quote that is never closed is a plain character. If no bracket outside quotes is
    left, tags end at the first bracket, and without any the rest is text.
    """
    at, last = 0, page.rfind(">")
    unclosed, quoted = {page.rfind("\""), page.rfind("'")}, True
    while at < len(page):
        start = page.find("<", at)
        if start != at:
            yield page[at:start if start >= 0 else len(page)], False
            if start < 0:
                return
        at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
        elif page[at:at + 9].upper() == "<![CDATA[":
            end = page.find("]]>", at + 9)
            at = end + 3 if end >= 0 else len(page)
        elif at > last:
            yield page[at:], False
            return
        elif raw := RAW.match(page, at):
            end = RAW_END[raw[1].lower()].search(page, raw.end())
            at = end.end() if end else len(page)
        elif LETTER.match(page, at):
            end = at
            while quoted:
                stop = STOP.search(page, end)
                if not stop:
                    quoted = False
                elif stop[0] == ">":
                    end = stop.end()
                    break
                else:
                    end = stop.end() if stop.start() in unclosed else page.find(stop[0], stop.end()) + 1
            if not quoted:
                end = page.find(">", at) + 1
            yield page[at:end], True
            at = end
        elif page[at + 1:at + 2] in ("!", "?", "/"):
            at = page.find(">", at) + 1
        else:
            yield "<", False
            at += 1


def _plain(source: list[str]) -> str:
    """Character references decoded, white space as single spaces."""
    text = "".join(source)
    if "&#" in text:
        text = NO_CHARACTER.sub("\ufffd", ZEROS.sub("&#", text))
    return SPACE.sub(" ", html.unescape(text)).strip()


def _furniture(tag: str, source: str, path: Path) -> bool:
    return bool(tag in DROPPED or len(source) > len(tag) + 2 and HIDDEN.search(source) or tag == "header" and not path.inside(CONTENT))


def _named(tag: str, source: str, path: Path) -> bool:
    """Whether a whole class, id or role is a name of furniture; every word of it is one or a plain word."""
    if len(source) <= len(tag) + 2:
        return False
    names = " ".join(m.strip("\"'") for m in NAMED.findall(source)).lower()
    if not names or tag in CONTENT or tag in ("body", "html") or tag in HEADINGS and path.inside(CONTENT):
        return False
    for name in names.split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if not FURNITURE.isdisjoint(words) and words <= FURNITURE | PLAIN:
            return True
    return False


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, and (nearest block element, text, characters in links) of each block outside the furniture, in page order."""
    path = Path()
    links, out = 0, []
    text: list[str] = []
    linked: list[str] = []

    def flush():
        if text:
            node = path.path[-1]
            clean = "" if node.dropped else _plain(text)
            if clean:
                out.append((node, clean, len(_plain(linked))))
            text.clear()
            linked.clear()

    for token, is_tag in tokens(page):
        if not is_tag:
            text.append(token)
            if links:
                linked.append(token)
            continue
        tag = TAG.match(token)[1].lower()
        if tag == "a":
            links = 0 if token[1] == "/" else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if token[1] == "/":
            path.close({tag})
            continue
        links = 0
        if tag in CONTENT:  # an article never belongs to a menu or header left open before it
            path.leave_all(BEFORE_ARTICLE)
        elif tag == "body":
            path.cut(1)
        elif tag in CLOSES_P:
            path.close(P, CELLS)
        if tag == "li":
            path.close({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            path.close({"dd", "dt"}, {"dl"})
        elif tag in ("tr", "td", "th"):
            path.close({"tr", "td", "th"} if tag == "tr" else {"td", "th"}, {"table", "tr"} if tag != "tr" else {"table"})
        parent = path.path[-1]
        path.push(Node(tag, parent, parent.dropped or _furniture(tag, token, path), _named(tag, token, path)))
        up = parent if tag in CONTENT else None
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
    flush()
    return path.nodes, _without_named(path.nodes, out)


def _without_named(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside elements with furniture names; all of them if there are no others."""
    for node, text, _ in found:
        node.chars += len(text)
    for node in reversed(nodes[1:]):  # a parent stands before its children
        node.parent.chars += node.chars
    total = nodes[0].chars
    for node in nodes:
        node.gone = node.parent is not None and node.parent.gone or node.named and not node.holds and 2 * node.chars < total
        # An element with a furniture name is around it, inside the article if there is one.
        node.lowered = node.tag not in CONTENT and (node.named and not node.holds or node.parent is not None and node.parent.lowered)
    return [b for b in found if not b[0].gone] or found


def main_text(page: str | None) -> str:
    nodes, found = blocks(page or "")
    if not found:
        return ""
    containers: dict[int, Node] = {}
    for node, text, linked in found:
        holder = node if node.tag in CONTENT or node.tag in ("div", "section", "td", "body", "html") or not node.parent else node.parent
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - min(1, linked / len(text))) * (LOWERED if node.lowered else 1)
        for weight, up in ((1.0, holder), (0.5, holder.parent)):
            if up is not None:
                up.points += weight * points
                containers[id(up)] = up
        node.length += len(text)
        node.linked += linked
    for node in reversed(nodes[1:]):
        node.parent.length += node.length
        node.parent.linked += node.linked

    def score(n: Node) -> float:
        return n.points * (1 - n.linked / n.length if n.length else 1) * (1.5 if n.tag in CONTENT else 0.8 if n.tag in ("html", "body") else 1)
    best = max(containers.values(), key=score)
    least = score(best) * 0.2
    for node in nodes:  # the best container, or the sibling of it, that holds the element
        if node is best or node.parent is not None and node.parent is best.parent:
            node.near = node
        elif node.parent is not None:
            node.near = node.parent.near

    def kept(up: Node | None, text: str, linked: int) -> bool:
        """Siblings without a furniture name stay by their score, as prose, as an article beside one, or as a heading outside one."""
        if up is None or up is best:
            return up is best
        if up.named and not up.holds:
            return False
        prose = linked < len(text) / 4
        if best.tag in CONTENT:
            beside = up.tag in CONTENT
        else:
            beside = up.tag in HEADINGS
        return score(up) >= max(least, 1.0) or prose and (beside or up.tag == "p" and len(text) > 80)
    return "\n\n".join(text for node, text, linked in found if kept(node.near, text, linked))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    def run(batches):
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                texts.append(main_text(batch.column(2)[k].as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
