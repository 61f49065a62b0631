"""Main text of web pages by tree scoring.

The page is cut into tags and text, built into a tree (with the implied ends of p, li,
cells and the like), and rid of what is never article text. Paragraphs pass points for
their length and commas to their ancestors, halved at each step and discounted by link
density; the best container is kept, with siblings that score near it, and with the
headings, paragraphs, quotes, lists and tables beside it unless they are mostly links.
Its blocks come out in page order.

Elements whose kind tells what they are (navigation, scripts, buttons and the like) go before
the scoring. A name of a class or an id, or being a form, only raises a doubt: such an element
goes unless it holds an article or main, or most of the page's text; names count whole, and
not beside one that is about content. What is named as readers' comments always goes.

Null or empty html gives an empty text, as does a page without a paragraph. Truncated
pages count as far as they go; nothing is capped, and time grows in proportion to a page
however deep it nests. Ties go to the container that ends first. Line breaks are white
space. Repeated rows get equal results. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = RAW | {"head", "nav", "footer", "aside", "button", "dialog", "menu", "canvas", "audio", "video", "label", "fieldset", "map"}
PARAGRAPH = {"p", "pre", "blockquote", "td", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
BLOCK = PARAGRAPH | {
    "address", "article", "body", "caption", "center", "details", "div", "dl", "dt", "figure", "header", "hr", "html", "main",
    "ol", "section", "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul", "form", *(DROP - {"label", "button", "svg", "math", "canvas"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Kept beside the best container, at any length.
BESIDE = PARAGRAPH | {"ul", "ol", "dl", "dt", "table", "figure"}
#: What a new tag ends if it is open, and what stops the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Class and id words of what is beside an article, and of what readers wrote.
ASIDE = (
    "ad ads advert adverts advertisement banner promo promos promotion sponsor sponsors sponsored sidebar nav navbar navigation navi menu menubar breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice notices notification notifications newsletter subscribe subscription signup social share sharing related recommended "
    "widget widgets popup modal overlay toolbar pagination pager skip legal copyright disclaimer"
).split()
READERS = "comment comments commentlist disqus replies respond responses".split()
#: Words that may stand beside those in one name, and words of a name that is about content.
JOINED = "site page main top bottom left right side header box bar area list item items wrapper wrap section container block links buttons inner body thread form count meta".split()
CONTENT = "article post entry content story body text main page news layout col column row prose blog".split()


def named(words: list[str]) -> re.Pattern:
    """Whole names made of the words, of at least one of them, with joined words around it."""
    one, more = "|".join(words), "|".join([*words, *JOINED])
    return re.compile(rf"(?:(?:{more})[-_]+)*(?:{one})(?:[-_]+(?:{more}|\d+))*", re.I)


BESIDES, REMARKS = named([*ASIDE, "side-bar"]), named(READERS)
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "alertdialog"}
LEAST = 1e-9
MENU = 3
#: A doubtful block stays if it holds more than this share of the page's text; its points count half.
SHARE, DOUBT = 0.5, 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "away", "doubtful", "holds", "inside", "score", "chars", "linked", "commas", "links", "own")

    def __init__(self, tag: str, parent: "Node | None", away: bool, inside: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.away, self.inside, self.doubtful = tag, parent, away, inside, doubtful
        self.holds = tag in ("article", "main")
        self.children: list = []
        self.score = 0.0
        self.chars = self.linked = self.commas = self.links = self.own = 0


class Open:
    """The nodes that are open, and for each tag where they stand, so that no search climbs."""

    def __init__(self, root: Node):
        self.path, self.blocks, self.at = [root], [], {}

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.at.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def close(self, i: int) -> None:
        """Closes the i-th node and all within it."""
        while len(self.path) > i:
            node = self.path.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost node with one of the tags; -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element goes in any case, and whether it is doubtful: its name or kind is that of what is beside an article."""
    if tag in DROP or tag == "header" and not inside:
        return True, False
    doubtful = tag == "form"
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, doubtful
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            names = value.split()
            if not any(x in CONTENT for n in names for x in re.split(r"[-_]+", n.lower()) if not BESIDES.fullmatch(n) and not REMARKS.fullmatch(n)):
                if any(map(REMARKS.fullmatch, names)):
                    return True, False
                doubtful = doubtful or any(map(BESIDES.fullmatch, names))
        elif name == "role" and value.lower() in AWAY_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
    return False, doubtful


def build(html: str) -> Node:
    root = Node("html", None, False)
    opened = Open(root)
    path = opened.path
    at, size = 0, len(html)
    find = TOKEN.search
    while at < size:
        m = find(html, at)
        if m is None:
            path[-1].children.append(html[at:])
            break
        if m.start() > at:
            path[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if (i := opened.last((tag,))) > 0:
                opened.close(i)
            continue
        if tag == "br":
            path[-1].children.append(" ")
        if tag in VOID:
            if tag == "hr":
                path[-1].children.append(Node("hr", path[-1], True))
            continue
        if tag == "html" and len(path) == 1:
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK and opened.blocks and path[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in ENDS:
            ended, stops = ENDS[tag]
            i = opened.last((*ended, *stops))
            if i > 0 and path[i].tag in ended:
                opened.close(i)
        elif tag in ("body", "article", "main", "section", "footer", "nav") and (i := opened.last(("head",))) > 0:
            opened.close(i)  # a head that was never closed holds no content
        inside = opened.last(("article", "main")) > 0
        away, doubtful = unwanted(tag, m[3], inside)
        node = Node(tag, path[-1], away, inside or tag in ("article", "main"), doubtful)
        root.doubtful = root.doubtful or doubtful
        path[-1].children.append(node)
        if not m[3].endswith("/"):
            opened.push(node)
    return root


def measure(root: Node) -> list[Node]:
    """Characters, linked characters and links below each node, its own characters and commas outside inner blocks; the nodes, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.away)
    order.reverse()
    for node in order:
        node.chars = node.linked = node.commas = node.links = node.own = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
                node.own += len(c.strip())
                node.commas += c.count(",")
            elif not c.away:
                node.chars += c.chars
                node.linked += c.linked
                node.links += c.links
                node.holds = node.holds or c.holds
                if c.tag not in BLOCK:
                    node.commas += c.commas
                    node.own += c.own
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
    return order


def settled(root: Node) -> list[Node]:
    """The nodes, measured, children first. Doubtful ones go unless they hold an article or main, or most of the page's text that isn't linked."""
    order = measure(root)
    if not root.doubtful:
        return order
    most = SHARE * (root.chars - root.linked)
    for node in order:
        if node.doubtful and node is not root and not node.holds and node.chars - node.linked <= most:
            node.away = True
    return measure(root)


def clear(node: Node) -> float:
    return 1 - node.linked / node.chars if node.chars else 0.0


def best(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    order = settled(root)
    for node in order:
        if node.chars and (node.tag in PARAGRAPH or node.tag in BLOCK and node.own):
            points = (1 + node.commas + min(node.chars / 100, 3)) * clear(node) * (DOUBT if node.doubtful and node is not root else 1)
            up = node.parent if node.tag in PARAGRAPH else node
            for share in (1, 0.5, 0.25):
                if up is None:
                    break
                up.score += points * share
                up = up.parent
    found = max(order, key=lambda n: n.score * clear(n), default=None)
    if found is None or found.score <= LEAST:
        return []
    # an article or main around the winner is the wanted whole
    node = found
    while node is not None:
        if node.tag in ("article", "main"):
            found = node
        node = node.parent
    if found.parent is None or found.tag in ("article", "main", "body"):
        if found.tag == "article" and found.parent is not None:
            mains = [c for c in found.parent.children if isinstance(c, Node) and not c.away and (c is found or c.tag == "article" and c.score * clear(c) >= 0.2 * found.score)]
            return mains
        return [found]
    least = max(0.2 * found.score * clear(found), 1.0)
    kept = []
    for c in found.parent.children:
        if not isinstance(c, Node) or c.away:
            continue
        if c is found or c.score * clear(c) >= least or c.tag in HEADINGS or c.tag in BESIDE and clear(c) > 0.75:
            kept.append(c)
    return kept


def menu(node: Node) -> bool:
    """A list of MENU links or more with hardly a word between them, outside article and main."""
    return not node.inside and node.tag in ("div", "section", "ul", "ol") and node.links >= MENU and clear(node) < 0.1


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def close():
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    # an explicit stack: pages may nest deeper than calls may
    stack: list = [(n, False) for n in reversed(nodes)]
    while stack:
        item, leaving = stack.pop()
        if isinstance(item, str):
            line.append(item)
            continue
        if item.away or menu(item):
            if item.tag in BLOCK:
                close()
            continue
        if item.tag in BLOCK:
            close()
        if not leaving:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    close()
    return out


def main_text(html: str | None) -> str:
    return "\n".join(blocks(best(build(html)))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    src = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
