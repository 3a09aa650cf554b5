"""A tolerant HTML tree: a subset of the standard's rules, linear in its input.

Implied end tags, void elements, implied html, head and body, raw text of
scripts and styles and character references are treated as browsers do;
foster parenting and the adoption agency aren't: formatting elements that
overlap are closed with their parents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

from quire.functions.text import collapse_html, tokens, trim

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set("address article aside blockquote body details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What an opening tag closes, up to the element that bounds the search.
_CLOSES = {
    "li": ({"li"}, {"ol", "ul"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
_HEAD = set("base link meta script style title template".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def elements(self) -> Iterator[Element]:
        return (c for c in self.children if isinstance(c, Element))

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator[Element]:
        """Descendants in document order; those of skipped tags are left out with what they hold."""
        stack = [self.elements()]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif node.tag not in skip:
                yield node
                stack.append(node.elements())

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack.append(iter(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, None)
        self.open = [self.root]
        self.html: Element | None = None
        self.body: Element | None = None

    def _push(self, tag: str, attrs: dict[str, str]) -> Element:
        node = Element(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)
        return node

    def _need(self, body: bool) -> None:
        if self.html is None:
            self.html = self._push("html", {})
        if body and self.body is None:
            while self.open[-1] is not self.html:
                self.open.pop()
            self.body = self._push("body", {})

    def _close(self, tags: set[str], bound: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in bound:
                return
            if tag in tags:
                del self.open[k:]
                if not tags - {tag}:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag == "html" and self.html is not None or tag == "body" and self.body is not None or tag == "head" and self.body is not None:
            node = {"html": self.html, "body": self.body}.get(tag)
            for k, v in given.items() if node is not None else ():
                node.attrs.setdefault(k, v)
            return
        if tag == "html":
            self.html = self._push(tag, given)
            return
        self._need(body=tag not in _HEAD and tag not in ("head", "body"))
        if tag == "body":
            while self.open[-1] is not self.html:
                self.open.pop()
            self.body = self._push(tag, given)
            return
        if tag in _BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button", "#document"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        self._push(tag, given)
        if tag in _VOID:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.body is None and self.open[-1].tag not in _HEAD:
            if not data.strip(" \t\n\r\f"):
                return
            self._need(body=True)
        self.open[-1].children.append(data)


_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _finished_only(text: str) -> str:
    """Markup whose character references all end in a semicolon: each other ampersand is written as one."""
    return _REFERENCE.sub(lambda m: m[0] if m[0][1:2] == "#" or m[0][1:] in html5 else "&amp;" + m[0][1:], text) if "&" in text else text


def parse_html(text: str, lenient: bool = True) -> Element:
    """The tree of a page. Unless lenient, a reference without its semicolon (``&amp`` where a text was cut) is text."""
    builder = _Builder()
    builder.feed(text if lenient else _finished_only(text))
    builder.close()
    return builder.root


#: Elements that are a block of text unless they hold others.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption".split())
_NO_TEXT = frozenset("script style template head title".split())


def blocks(root: Element) -> list[tuple[str, str]]:
    """(tag, collapsed text) of the leaf blocks in document order; pre keeps its white space."""
    out = []
    for node in root.walk(_NO_TEXT):
        if node.tag in LEAVES and not any(c.tag in LEAVES for c in node.walk(_NO_TEXT)):
            raw = node.text(_NO_TEXT)
            t = raw if node.tag == "pre" else collapse_html(raw)
            if t:
                out.append((node.tag, t))
    return out


def places(root: Element) -> list[tuple[str, str, str | None, int]]:
    """(kind, name, reference, offset) of anchors, links, note references and page breaks.

    Offsets count in the canonical text: the leaf blocks' texts, a line feed
    after each. What stands outside of a leaf is where the next one begins.
    """
    out: list[tuple[str, str, str | None, int]] = []
    leaves = {id(n) for n in root.walk(_NO_TEXT) if n.tag in LEAVES and not any(c.tag in LEAVES for c in n.walk(_NO_TEXT))}
    start, leaf, raw = 0, None, ""
    stack: list[tuple[Iterator[Element | str], Element | None]] = [(iter(root.children), None)]
    while stack:
        node = next(stack[-1][0], None)
        if node is None:
            done = stack.pop()[1]
            if done is not None and done is leaf:
                text = raw if leaf.tag == "pre" else collapse_html(raw)
                start, leaf = start + (len(text) + 1 if text else 0), None
            continue
        if isinstance(node, str):
            raw += node if leaf is not None else ""
            continue
        if node.tag in _NO_TEXT:
            continue
        if id(node) in leaves:
            leaf, raw = node, ""
        before = raw if leaf is not None and leaf.tag == "pre" else collapse_html(raw + "x")[:-1] if leaf is not None else ""
        at = start + len(before)
        if name := node.attrs.get("id"):
            out.append(("anchor", name, None, at))
        types = tokens(node.attrs.get("epub:type"))
        if "pagebreak" in types:
            out.append(("pagebreak", collapse_html(node.attrs.get("title") or node.attrs.get("aria-label") or node.text()), None, at))
        if node.tag == "a" and "href" in node.attrs:
            out.append(("noteref" if "noteref" in types else "link", collapse_html(node.text(_NO_TEXT)), trim(node.attrs["href"]), at))
        stack.append((iter(node.children), node))
    return out


#: Limits of navigation lists. Fixed values.
MAX_DEPTH, MAX_ENTRIES = 64, 100_000


def navigation(text: str) -> tuple[dict[str, list[dict]], bool]:
    """Lists of a navigation file by kind (toc, page-list, landmarks) as flat entries in order, and whether one was cut.

    An entry has depth, title, href and type; a child follows its parent one deeper.
    """
    root = parse_html(text)
    found: dict[str, list[dict]] = {}
    cut = False
    for nav in root.walk():
        if nav.tag != "nav":
            continue
        for kind in tokens(nav.attrs.get("epub:type")):
            if kind in ("toc", "page-list", "landmarks") and kind not in found:
                found[kind], more = _list_entries(nav, kind == "landmarks")
                cut |= more
    return found, cut


def _list_entries(nav: Element, landmark: bool) -> tuple[list[dict], bool]:
    first = next((e for e in nav.walk(frozenset({"nav"})) if e.tag in ("ol", "ul")), None)
    out: list[dict] = []
    todo = [(item, 1) for item in reversed([c for c in (first.elements() if first else ()) if c.tag == "li"])]
    while todo:
        item, depth = todo.pop()
        if depth > MAX_DEPTH or len(out) >= MAX_ENTRIES:
            return out, True
        label = sub = None
        stack = [item.elements()]
        while stack and not (label and sub):
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif node.tag in ("ol", "ul"):
                sub = sub or node
            elif node.tag != "nav":
                if label is None and node.tag in ("a", "span"):
                    label = node
                stack.append(node.elements())
        out.append({"depth": depth, "title": _label(label) if label else "", "href": label.attrs.get("href") if label is not None and label.tag == "a" else None, "type": trim(label.attrs["epub:type"]) if landmark and label is not None and "epub:type" in label.attrs else None})
        todo += [(c, depth + 1) for c in reversed([c for c in (sub.elements() if sub else ()) if c.tag == "li"])]
    return out, False


def _label(label: Element) -> str:
    """A link's text, else its first image's alternative, else its title."""
    lists = frozenset({"ol", "ul"})
    image = next((e for e in label.walk(lists) if e.tag == "img"), None)
    options = (label.text(lists), (image.attrs.get("alt") or "") if image else "", label.attrs.get("title", ""))
    return next((c for o in options if (c := collapse_html(o))), "")
