"""From sheets and a section's tree to computed styles; a section is one unit of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import css, href
from quire.functions.text import ascii_lower, utf16_len
from quire.sources.htmltree import Element, parse_html
from quire.sources.package import Reader
from quire.sources.xmldoc import decode_markup
from quire.sources.zipdir import Fatal, read_entry

#: Limits. Fixed values.
MAX_SHEET, MAX_SECTION = 1 << 20, 4 << 20
MAX_SHEETS, MAX_ATTEMPTS, MAX_IMPORT_DEPTH = 64, 256, 8
MAX_RULES, MAX_DEPTH, BUDGET, MAX_STYLE = 20_000, 256, 1 << 22, 8192
UA, AUTHOR, IMPORTANT = 0, 1, 2
_HINT_SPEC, _HINT_SEQ = 1 << 10, 1 << 40
_LISTS = {"ul", "ol", "menu", "dir"}

STYLE = [p for p in css.LONGHANDS if p not in ("text-decoration", "float", "position", "column-count", "column-width", "writing-mode")]
INITIAL = {
    "display": "inline", "white-space": "normal", "direction": "ltr", "vertical-align": "baseline", "list-style-type": "disc", "break-before": "auto", "break-after": "auto", "break-inside": "auto",
    "width": None, "height": None, "text-align": "start", "font-style": "normal", "font-weight": 400.0, "font-variant": "normal", "text-transform": "none", "font-size": "same", "text-indent": 0.0,
    **{f"{k}-{s}": 0.0 for k in ("margin", "padding") for s in css.SIDES}, "underline": False, "line-through": False,
}


@lru_cache(maxsize=256)
def parsed(text: str) -> css.Sheet:
    """A sheet, parsed once in a worker however many sections link it."""
    return css.parse_sheet(text)


@lru_cache(maxsize=4096)
def parsed_style(text: str) -> tuple[css.Declaration, ...]:
    return tuple(css.parse_style(text))


@dataclass
class Loaded:
    """A section's sheets in cascade order, and what was ignored on the way."""

    sheets: list[tuple[str, str]] = field(default_factory=list)
    diagnostics: list[tuple[str, str | None, str]] = field(default_factory=list)

    def say(self, code: str, path: str | None, reason: str) -> None:
        if (code, path, reason) not in self.diagnostics:
            self.diagnostics.append((code, path, reason))


def load_sheets(root: Element, section: str, fetch: Callable[[str], bytes | None]) -> Loaded:
    """Sheets of link and style elements in document order; what a sheet imports comes before it.

    Imports go 8 deep and never in a circle; the numbers and sizes of sheets
    are limited; media that a screen doesn't meet leave a sheet out.
    """
    out, attempts, size = Loaded(), 0, 0

    def add(text: str, path: str, name: str, trail: tuple[str, ...]) -> None:
        nonlocal size
        size += utf16_len(text)
        if len(out.sheets) >= MAX_SHEETS or size > MAX_SECTION:
            out.say("stylesheetIgnored", name, "limit")
            return
        sheet = parsed(text)
        if sheet.media_ignored:
            out.say("stylesheetMediaIgnored", name, "media")
        for (reason, key), (_, n) in sheet.issues.items():
            out.say("cssRuleIgnored", name, f"{reason}:{key}:{n}")
        for ref, ok in sheet.imports:
            if ok:
                load(ref, path, trail)
        out.sheets.append((name, text))

    def load(ref: str, base: str, trail: tuple[str, ...]) -> None:
        nonlocal attempts
        attempts += 1
        path = href.normalize(href.dirname(base), ref)
        if attempts > MAX_ATTEMPTS or path is None:
            out.say("stylesheetIgnored", path or ref, "limit" if path else "href")
            return
        data = found = None
        for found in href.candidates(path):
            data = fetch(found)
            if data is not None:
                break
        if data is None or len(data) > MAX_SHEET:
            out.say("stylesheetIgnored", path, "missing" if data is None else "too-large")
        elif ascii_lower(found) in trail or len(trail) > MAX_IMPORT_DEPTH:
            out.say("stylesheetIgnored", found, "cycle" if ascii_lower(found) in trail else "depth")
        else:
            text, wrong = css.decode_sheet(data)
            if wrong:
                out.say("encodingFallback", found, "latin1")
            add(text, found, found, (*trail, ascii_lower(found)))

    for e in root.walk(frozenset({"template"})):
        if e.tag == "link" and css.is_stylesheet_link(e.attrs):
            load(e.attrs["href"], section, ())
        elif e.tag == "style" and ascii_lower(e.attrs.get("type", "").strip()) in ("", "text/css"):
            text = e.text()
            if utf16_len(text) > MAX_SHEET:
                out.say("stylesheetIgnored", section, "too-large")
            elif css.media_matches(list(css.tokenize(e.attrs.get("media", "")))):
                add(text, section, section, ())
            else:
                out.say("stylesheetMediaIgnored", section, "media")
    return out


class Index:
    """Rules by what an element must have at least; seq counts declarations, one number a rule."""

    def __init__(self, sheets: list[css.Sheet]):
        self.by: dict[tuple[str, str], list[tuple[css.Selector, int, css.Rule]]] = {}
        self.truncated, seq, n = False, 0, 0
        for sheet in sheets:
            for rule in sheet.rules:
                if n >= MAX_RULES:
                    self.truncated = True
                    return
                n += 1
                for s in rule.selectors:
                    self.by.setdefault(s.bucket, []).append((s, seq, rule))
                seq += len(rule.declarations)

    def candidates(self, e: Node) -> Iterator[tuple[css.Selector, int, css.Rule]]:
        for key in (("id", e.id), *(("class", c) for c in e.classes), ("tag", e.tag), ("any", "")):
            yield from self.by.get(key, ())


@dataclass
class Node:
    """An element as selectors see it."""

    element: Element
    parent: Node | None
    previous: Node | None
    index: int
    siblings: int
    depth: int
    lists: int

    def __post_init__(self):
        a = self.element.attrs
        self.tag, self.id = self.element.tag, a.get("id")
        self.classes = list(dict.fromkeys(a.get("class", "").split()))


def _fits(c: css.Compound, e: Node) -> bool:
    return (
        not c.impossible
        and (c.id is None or c.id == e.id)
        and (c.tag is None or ascii_lower(c.tag) == e.tag)
        and all(k in e.classes for k in c.classes)
        and all(e.element.attrs.get(k) == v for k, v in c.attrs)
        and (not c.first or e.index == 1)
        and (not c.last or e.index == e.siblings)
        and (c.nth is None or c.nth == e.index)
    )


def matches(s: css.Selector, e: Node, spend: Callable[[int], None] = lambda n: None) -> bool:
    """Whether a selector fits an element: for each combinator the set of nodes that may stand before it."""
    if not _fits(s.compounds[-1], e):
        return False
    now = {id(e): e}
    for k in range(len(s.combinators) - 1, -1, -1):
        before: dict[int, Node] = {}
        for n in now.values():
            at = n.previous if s.combinators[k] == "+" else n.parent
            while at is not None:
                spend(1)
                if id(at) in before:
                    break
                if _fits(s.compounds[k], at):
                    before[id(at)] = at
                at = at.parent if s.combinators[k] == " " else None
        if not before:
            return False
        now = before
    return True


class OutOfBudget(Exception):
    pass


class Cascade:
    """Computed styles of a section. With too much work the author's rules are left out from there on."""

    def __init__(self, sheets: list[css.Sheet], budget: int = BUDGET):
        self.ua, self.author = Index([parsed(css.USER_AGENT)]), Index(sheets)
        self.left, self.exhausted = budget, False
        self.degraded: dict[str, str] = {}
        self.style_too_large = False

    def _spend(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise OutOfBudget

    def run(self, root: Element) -> Iterator[tuple[Node, dict, dict]]:
        """(element, style, origin of each declared property) in document order."""
        top = list(root.elements())
        stack = [_Level(iter(top), None, INITIAL, len(top))]
        while stack:
            level = stack[-1]
            element = next(level.rest, None)
            if element is None:
                stack.pop()
                continue
            up = level.parent
            lists = up.lists + (up.tag in _LISTS) if up else 0
            level.last = node = Node(element, up, level.last, level.last.index + 1 if level.last else 1, level.total, len(stack), lists)
            style, origin = (self._resolve(node, {}, level.style), {}) if node.depth > MAX_DEPTH else self._style(node, level.style)
            yield node, style, origin
            children = list(element.elements())
            stack.append(_Level(iter(children), node, style, len(children)))

    def _style(self, e: Node, parent: dict) -> tuple[dict, dict]:
        winners = None
        if not self.exhausted:
            try:
                winners = self._winners(e, True)
            except OutOfBudget:
                self.exhausted = True
        if winners is None:
            winners = self._winners(e, False)
        return self._resolve(e, {p: w[1] for p, w in winners.items()}, parent), {p: w[2] for p, w in winners.items()}

    def _winners(self, e: Node, author: bool) -> dict[str, tuple]:
        best: dict[str, tuple] = {}

        def offer(p: str, value: tuple, rank: tuple, origin: str) -> None:
            if p not in best or rank > best[p][0]:
                best[p] = (rank, value, origin)

        for s, seq, rule in self.ua.candidates(e):
            if matches(s, e):
                for k, d in enumerate(rule.declarations):
                    offer(d.property, d.value, (UA, 0, s.specificity, seq, k), "userAgent")
        self._hints(e, offer)
        if author:
            for s, seq, rule in self.author.candidates(e):
                self._spend(1)
                if matches(s, e, self._spend):
                    self._spend(len(rule.declarations))
                    for k, d in enumerate(rule.declarations):
                        offer(d.property, d.value, (IMPORTANT if d.important else AUTHOR, 0, s.specificity, seq, k), "author")
        text = e.element.attrs.get("style")
        if text is not None and utf16_len(text) > MAX_STYLE:
            self.style_too_large = True
        elif text is not None:
            for k, d in enumerate(parsed_style(text)):
                offer(d.property, d.value, (IMPORTANT if d.important else AUTHOR, 1, 0, k, 0), "styleAttribute")
        return best

    @staticmethod
    def _hints(e: Node, offer) -> None:
        a = e.element.attrs
        if "hidden" in a and ascii_lower(a["hidden"]) != "until-found":
            offer("display", ("keyword", "none"), (UA, 0, _HINT_SPEC, _HINT_SEQ, 0), "userAgent")
        if (way := ascii_lower(a.get("dir", ""))) in ("ltr", "rtl"):
            offer("direction", ("keyword", way), (UA, 0, _HINT_SPEC, _HINT_SEQ + 1, 0), "userAgent")
        if e.lists and e.tag in _LISTS - {"ol"}:
            offer("list-style-type", ("keyword", "circle" if e.lists == 1 else "square"), (UA, 0, min(e.lists, 2) + 1, _HINT_SEQ + 2, 0), "userAgent")

    def _resolve(self, e: Node, won: dict[str, tuple], parent: dict) -> dict:
        style = {}
        for p in STYLE:
            v = won.get(p)
            kind = v[0] if v else None
            fallback = parent[p] if p in css.INHERITED else INITIAL[p]
            if kind in (None, "wide"):
                wide = v[1] if v else "unset"
                style[p] = parent[p] if wide == "inherit" and p != "font-size" else INITIAL[p] if wide == "initial" else fallback
            elif kind in ("keyword", "step"):
                style[p] = v[1]
            elif kind in ("em", "percent") and p in ("width", "height"):
                style[p] = f"{v[1]:g}{'em' if kind == 'em' else '%'}"
            elif kind in ("em", "weight"):
                style[p] = float(v[1])
            elif kind == "auto":
                style[p] = None
            elif kind in ("bolder", "lighter"):
                style[p] = relative_weight(parent[p], kind)
            elif kind == "unknown-list":
                style[p] = "decimal" if e.tag == "ol" or (e.tag == "li" and e.parent is not None and e.parent.tag == "ol") else "disc"
            else:
                style[p] = fallback
        line = won.get("text-decoration", ("decoration", False, False))
        drawn = line[1:] if line[0] == "decoration" else (False, False)
        style["underline"], style["line-through"] = parent["underline"] or drawn[0], parent["line-through"] or drawn[1]
        for p, name in (("float", "float"), ("position", "position"), ("column-count", "columns"), ("column-width", "columns"), ("writing-mode", "writing-mode")):
            v = won.get(p)
            if v and v[0] == "degraded" and v[1]:
                self.degraded.setdefault(name, v[2])
        return style


@dataclass
class _Level:
    """Children of one element that are still to come."""

    rest: Iterator[Element]
    parent: Node | None
    style: dict
    total: int
    last: Node | None = None


def relative_weight(parent: float, kind: str) -> float:
    """What bolder and lighter make of a weight."""
    if kind == "bolder":
        return 400.0 if parent < 350 else 700.0 if parent < 550 else max(900.0, parent)
    return parent if parent < 100 else 100.0 if parent < 550 else 400.0 if parent < 750 else 700.0


def text_align(style: dict) -> str:
    """left and right as start and end of the reading direction."""
    a = style["text-align"]
    return a if a not in ("left", "right") else "start" if (a == "left") == (style["direction"] == "ltr") else "end"


COMPUTED = "key bigint, eid int, parent int, tag string, depth int, sibling int, siblings int, display string, white_space string, direction string, text_align string, font_style string, bold boolean, font_size string, list_style_type string, underline boolean, line_through boolean, margin_top double, margin_left double, padding_left double, text_indent double, origins map<string,string>"


def computed_styles(pages: DataFrame) -> DataFrame:
    """A row for each element of pages(key, html), styled by the page's own style elements and attributes."""
    arrow = to_arrow_schema(StructType.fromDDL(COMPUTED))

    def one(key: int, html: str | None) -> Iterator[dict]:
        root = parse_html(html or "")
        sheets = [parsed(t) for _, t in load_sheets(root, "", lambda path: None).sheets]
        for row in _style_rows(Cascade(sheets), root):
            yield {"key": key, **row}

    return pages.mapInArrow(_each_row(one, arrow), COMPUTED)


def _style_rows(cascade: Cascade, root: Element) -> Iterator[dict]:
    ids: dict[int, int] = {}
    for n, (node, s, origin) in enumerate(cascade.run(root)):
        ids[id(node)] = n
        yield {
            "eid": n, "parent": ids[id(node.parent)] if node.parent else None, "tag": node.tag, "depth": node.depth, "sibling": node.index, "siblings": node.siblings, "display": s["display"], "white_space": s["white-space"], "direction": s["direction"], "text_align": text_align(s),
            "font_style": s["font-style"], "bold": s["font-weight"] >= 600, "font_size": s["font-size"], "list_style_type": s["list-style-type"], "underline": s["underline"], "line_through": s["line-through"], "margin_top": s["margin-top"], "margin_left": s["margin-left"], "padding_left": s["padding-left"], "text_indent": s["text-indent"],
            "origins": list(origin.items()),
        }


def _each_row(one: Callable[..., Iterator[dict]], arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := list(one(*row)):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _sections(data: bytes) -> Iterator[tuple[int, str, Element, Callable[[str], bytes | None]]]:
    """(position, path, tree, reader of other entries) of a book's readable sections."""
    book = Reader(data).read()
    if book.fatal:
        return

    def fetch(path: str) -> bytes | None:
        e = book.directory.find(path)
        try:
            return read_entry(data, e)[0] if e else None
        except Fatal:
            return None

    for s in book.spine:
        raw = fetch(s["content_path"]) if s["local"] and s["kind"] == "xhtml" else None
        if raw is not None:
            yield s["pos"], s["content_path"], parse_html(decode_markup(raw, html=True)[0]), fetch


def book_styles(books: DataFrame) -> DataFrame:
    """A row for each element of each section of books(book_id, content), styled by all sheets that the section brings."""
    schema = "book_id string, pos int, path string, " + COMPUTED.removeprefix("key bigint, ")

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        for pos, path, root, fetch in _sections(content or b""):
            sheets = [parsed(t) for _, t in load_sheets(root, path, fetch).sheets]
            for row in _style_rows(Cascade(sheets), root):
                yield {"book_id": book_id, "pos": pos, "path": path, **row}

    return books.select("book_id", "content").mapInArrow(_each_row(one, to_arrow_schema(StructType.fromDDL(schema))), schema)


def style_diagnostics(books: DataFrame) -> DataFrame:
    """(book_id, pos, path, code, href, reason): what of the sections' styles was ignored or can't be laid out, once each."""
    schema = "book_id string, pos int, path string, code string, href string, reason string"

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        for pos, path, root, fetch in _sections(content or b""):
            loaded = load_sheets(root, path, fetch)
            cascade = Cascade([parsed(t) for _, t in loaded.sheets])
            for _ in cascade.run(root):
                pass
            found = [*loaded.diagnostics, *(("unsupportedLayout", path, f"{k}:{v}") for k, v in cascade.degraded.items())]
            found += [("stylesheetIgnored", path, "style-attribute")] * cascade.style_too_large + [("cssRuleIgnored", path, "budget")] * cascade.exhausted + [("cssRuleIgnored", path, "rules")] * cascade.author.truncated
            for code, ref, reason in found:
                yield {"book_id": book_id, "pos": pos, "path": path, "code": code, "href": ref, "reason": reason}

    return books.select("book_id", "content").mapInArrow(_each_row(one, to_arrow_schema(StructType.fromDDL(schema))), schema)


RULES = "key bigint, ord int, selectors int, specificity bigint, bucket string, property string, value string, important boolean"


def sheet_rules(sheets: DataFrame) -> DataFrame:
    """A row for each declaration of sheets(key, css): parsed once for each distinct text."""
    arrow = to_arrow_schema(StructType.fromDDL(RULES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, rule in enumerate(parsed(text or "").rules):
                    top = max(rule.selectors, key=lambda s: s.specificity)
                    rows += [{"key": key, "ord": k, "selectors": len(rule.selectors), "specificity": top.specificity, "bucket": ":".join(top.bucket), "property": d.property, "value": " ".join(map(str, d.value)), "important": d.important} for d in rule.declarations]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sheets.mapInArrow(run, RULES)
