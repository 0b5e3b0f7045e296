"""A forgiving reader of HTML: blocks as a tree, with what their names say about them."""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SINGLE = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is not markup.
RAW = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in "iframe noembed noframes script style textarea title xmp".split()}
#: Elements that are never text of a page.
UNSEEN = set("audio button canvas datalist map math noscript object select svg template video".split())
HOLDERS = set(
    "address article aside body center details dialog div dl fieldset footer form header hgroup main menu nav ol search "
    "section table tbody td tfoot th thead tr ul".split())
PROSE = set("blockquote caption dd dt figcaption figure h1 h2 h3 h4 h5 h6 legend li listing p pre summary".split())
BLOCKS = HOLDERS | PROSE | {"hr"}
#: An open element that the start of another one ends, and where the search for it stops.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
} | {f"h{i}": ({f"h{j}" for j in range(1, 7)}, HOLDERS) for i in range(1, 7)}
P_STOPS = {"td", "th", "caption", "table"}
ASIDE_TAGS = {"aside", "dialog", "footer", "form", "menu", "nav", "search"}
ASIDE_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words in class names and ids of what is not the article.
ASIDE_WORDS = set(
    "ad ads adsbygoogle adslot adbox advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs "
    "comment commentlist comments consent cookie cookies discussion disqus foot footer gdpr login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion reader recommended "
    "recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription taboola toolbar topbar widget".split())
NOT_SO = {"no", "has", "with", "without", "non"}
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[a-z]+")


class Node:
    """An element: its texts (with their white space) and elements in order."""

    __slots__ = ("tag", "key", "aside", "main", "parts", "own", "links", "inline")

    def __init__(self, tag: str, key: str = "", aside: bool = False, main: bool = False, inline: bool = False):
        self.tag, self.key, self.aside, self.main, self.inline = tag, key or tag, aside, main, inline
        self.parts: list[str | Node] = []
        self.own = self.links = 0  # characters outside of links, and inside

    @property
    def nodes(self) -> list[Node]:
        return [part for part in self.parts if isinstance(part, Node)]


def _hinted(name: str) -> bool:
    words = LETTERS.findall(HUMP.sub(" ", name).lower())
    return bool(words) and words[0] not in NOT_SO and not ASIDE_WORDS.isdisjoint(words)


def _described(tag: str, rest: str) -> Node:
    """The node of a start tag; digits in names (numbers of posts) do not count."""
    if "=" not in rest and "hidden" not in rest:
        return Node(tag, tag, tag in ASIDE_TAGS, tag in ("article", "main"))
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    names = found.get("class", "").split()
    role, mark = found.get("role", "").lower(), found.get("id", "")
    aside = (
        tag in ASIDE_TAGS or role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower() or _hinted(mark) or any(map(_hinted, names)))
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    plain = ["-".join(LETTERS.findall(name.lower())) for name in names]
    key = ".".join([tag, *sorted(set(filter(None, plain)))]) + ("#" + "-".join(LETTERS.findall(mark.lower())) if mark else "")
    return Node(tag, key, aside, main)


class _Reader:
    def __init__(self) -> None:
        self.root = Node("body")
        self.open = [self.root]
        self.link = 0  # depth at which a link was opened

    def text(self, piece: str) -> None:
        if not piece:
            return
        node = self.open[-1]
        node.parts.append(piece)
        size = len(piece.strip())
        if self.link:
            node.links += size
        else:
            node.own += size

    def close_to(self, depth: int) -> None:
        del self.open[depth:]
        if self.link > len(self.open):
            self.link = 0

    def end_open(self, tags: set[str], stops: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                return self.close_to(depth)
            if self.open[depth].tag in stops:
                return None
        return None

    def start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.link = len(self.open)
        if tag == "br":
            self.open[-1].parts.append(" ")
        if tag in SINGLE and tag != "hr" or tag in ("html", "head", "body"):
            return
        if tag not in BLOCKS and tag not in UNSEEN:
            if "=" not in rest and "hidden" not in rest:
                return
            node = _described(tag, rest)
            if not node.aside:
                return
            node.inline = True
        else:
            if tag in BLOCKS:
                self.end_open({"p"}, P_STOPS)
            if tag in ENDED:
                self.end_open(*ENDED[tag])
            node = Node(tag) if tag in UNSEEN else _described(tag, rest)
            if tag in UNSEEN:
                node.aside = node.inline = True
        self.open[-1].parts.append(node)
        if tag != "hr" and not rest.endswith("/") or tag in BLOCKS - {"hr"}:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                return self.close_to(depth)
            if tag == "p" and self.open[depth].tag in HOLDERS:
                return None
        return None


def _settle(root: Node) -> None:
    """A name alone does not set aside what holds an article or a first heading."""
    order, held = [root], {}
    for node in order:
        order += node.nodes
    for node in reversed(order):
        inner = any(held[id(kid)] for kid in node.nodes)
        if node.aside and inner and node.tag not in ("nav", "aside", "footer"):
            node.aside = False
        held[id(node)] = inner or (not node.aside and (node.main or node.tag == "h1"))


def parse(html: str) -> Node:
    """The page's tree; what the markup leaves open is closed as a browser would."""
    reader, at = _Reader(), 0
    while match := TOKEN.search(html, at):
        reader.text(html[at:match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            reader.end(tag)
        elif tag in RAW:
            stop = RAW[tag].search(html, at)
            end = html.find(">", stop.start()) if stop else -1
            at = end + 1 if end >= 0 else len(html)
        else:
            reader.start(tag, match[3])
    reader.text(html[at:])
    _settle(reader.root)
    return reader.root


def blocks(node: Node, dropped: set[int]) -> list[str]:
    """Texts of the blocks below a node, in order, references decoded and white space made single."""
    found: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join("".join(current).split())
        if text:
            found.append(text)
        current.clear()

    work: list[Node | str | None] = [node]
    while work:
        part = work.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            current.append(unescape(part) if "&" in part else part)
        elif id(part) in dropped:
            if not part.inline:
                flush()
        else:
            if not part.inline:
                flush()
                work.append(None)
            work += reversed(part.parts)
    flush()
    return found
