"""Style sheets: tokens, rules, selectors and typed declarations. Pure Python, one pass, no recursion on input depth."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from quire.functions.text import ascii_lower, sample, tokens

#: Limits. Fixed values.
MAX_NESTING, MAX_COMPOUNDS, MAX_SIMPLE, MAX_NAME, MAX_NUMBER = 32, 32, 32, 256, 64


@dataclass(frozen=True)
class Token:
    kind: str
    value: str = ""
    number: float = 0.0
    unit: str = ""
    integer: bool = False
    is_id: bool = False


_ESC = r"\\(?:[0-9a-fA-F]{1,6}[ \t\n]?|[^\n0-9a-fA-F])"
_NAME_START = rf"(?:[a-zA-Z_\u0080-\U0010ffff]|{_ESC})"
_NAME_CHAR = rf"(?:[a-zA-Z0-9_\-\u0080-\U0010ffff]|{_ESC})"
_IDENT = rf"(?:--{_NAME_CHAR}*|-?{_NAME_START}{_NAME_CHAR}*)"
_NUMBER = r"[+-]?(?:\d*\.)?\d+(?:[eE][+-]?\d+)?"
_SCAN = re.compile(
    rf"""(?P<comment>/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))|(?P<space>[ \t\n]+)|(?P<string>"(?:[^"\\\n]|\\(?:.|\n|\Z))*(?:"|\Z)|'(?:[^'\\\n]|\\(?:.|\n|\Z))*(?:'|\Z))"""
    rf"""|(?P<badstring>"(?:[^"\\\n]|\\(?:.|\n))*(?=\n)|'(?:[^'\\\n]|\\(?:.|\n))*(?=\n))|(?P<hash>\#{_NAME_CHAR}+)|(?P<cdo><!--)|(?P<cdc>-->)"""
    rf"""|(?P<number>{_NUMBER})(?P<tail>%|{_IDENT})?|(?P<at>@{_IDENT})|(?P<ident>{_IDENT})(?P<paren>\()?|(?P<other>.)""",
    re.S,
)
_URL = re.compile(rf"""[ \t\n]*(?P<url>(?:[^"'() \t\n\\\x00-\x08\x0b\x0e-\x1f\x7f]|{_ESC})*)[ \t\n]*(?:\)|\Z)""")
_PUNCTUATION = {":": "colon", ";": "semicolon", ",": "comma", "[": "[", "]": "]", "(": "(", ")": ")", "{": "{", "}": "}"}
_CLOSER = {"(": ")", "function": ")", "[": "]", "{": "}"}


def _plain(s: str) -> str:
    """Escapes undone."""

    def one(m: re.Match) -> str:
        code = m[1]
        if not code:
            return "" if m[2] == "\n" else m[2]
        n = int(code, 16)
        return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)

    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|(.|\n))", one, s, flags=re.S) if "\\" in s else s


def tokenize(text: str) -> Iterator[Token]:
    """Tokens of a sheet; comments are left out. Never fails."""
    text = re.sub("\r\n|\r|\f", "\n", text).replace("\0", "�")
    at = 0
    while at < len(text):
        m = _SCAN.match(text, at)
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("tail", "paren") else {"tail": "number", "paren": "ident"}[m.lastgroup]
        raw = m[kind]
        if kind == "comment":
            continue
        if kind == "string":
            yield Token("string", _plain(raw[1:-1] if len(raw) > 1 and raw[-1] == raw[0] else raw[1:]))
        elif kind == "badstring":
            yield Token("bad-string")
        elif kind == "hash":
            yield Token("hash", _plain(raw[1:]), is_id=re.fullmatch(_IDENT, raw[1:]) is not None)
        elif kind == "at":
            yield Token("at", _plain(raw[1:]))
        elif kind == "number":
            value = float(raw) if len(raw) <= MAX_NUMBER else math.nan
            whole, tail = re.fullmatch(r"[+-]?\d+", raw) is not None, m["tail"]
            if tail is None:
                yield Token("number", raw, value, integer=whole)
            else:
                yield Token("percentage", raw, value) if tail == "%" else Token("dimension", raw, value, ascii_lower(_plain(tail)), whole)
        elif kind == "ident" and m["paren"]:
            name = _plain(raw)
            if ascii_lower(name) == "url" and not re.match(r"""[ \t\n]*["']""", text[at:]):
                u = _URL.match(text, at)
                if u:
                    at = u.end()
                    yield Token("url", _plain(u["url"]))
                else:
                    end = re.compile(r"(?:[^)\\]|\\(?:.|\n))*(?:\)|\Z)", re.S).match(text, at)
                    at = end.end() if end else len(text)
                    yield Token("bad-url")
            else:
                yield Token("function", name)
        elif kind == "ident":
            yield Token("ident", _plain(raw))
        elif kind in ("space", "cdo", "cdc"):
            yield Token(kind)
        else:
            yield Token(_PUNCTUATION.get(raw, "delim"), raw)


def _strip(ts: list[Token]) -> list[Token]:
    a, b = 0, len(ts)
    while a < b and ts[a].kind == "space":
        a += 1
    while b > a and ts[b - 1].kind == "space":
        b -= 1
    return ts[a:b]


def _split(ts: list[Token], kind: str) -> list[list[Token]]:
    """Parts between top-level tokens of a kind."""
    out, depth = [[]], []
    for t in ts:
        if t.kind in _CLOSER:
            depth.append(_CLOSER[t.kind])
        elif depth and t.kind == depth[-1]:
            depth.pop()
        if t.kind == kind and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


# Selectors


@dataclass
class Compound:
    tag: str | None = None
    id: str | None = None
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str]] = field(default_factory=list)
    first: bool = False
    last: bool = False
    nth: int | None = None
    impossible: bool = False

    @property
    def specificity(self) -> tuple[int, int, int]:
        pseudo = self.first + self.last + (self.nth is not None)
        return int(self.id is not None), len(self.classes) + len(self.attrs) + pseudo, int(self.tag is not None)


@dataclass
class Selector:
    """Compounds from left to right and the combinators between them (' ', '>', '+')."""

    compounds: list[Compound]
    combinators: list[str]

    @property
    def specificity(self) -> int:
        """Counts of ids, classes and tags, each at most 1023, packed in one number."""
        a, b, c = (min(1023, sum(x)) for x in zip(*(k.specificity for k in self.compounds), strict=True))
        return a << 20 | b << 10 | c

    @property
    def bucket(self) -> tuple[str, str]:
        """What an element must have at least: the right-most compound's id, else first class, else tag."""
        c = self.compounds[-1]
        return ("id", c.id) if c.id is not None else ("class", c.classes[0]) if c.classes else ("tag", ascii_lower(c.tag)) if c.tag else ("any", "")


class Invalid(ValueError):
    """The whole rule goes."""


class Unsupported(ValueError):
    """This selector goes."""


#: Pseudo-classes and elements that are known and not supported. Fixed values.
_KNOWN_PSEUDO = set("active any-link autofill blank checked current default defined dir disabled empty enabled first first-of-type focus focus-visible focus-within fullscreen future has host host-context hover in-range indeterminate invalid is lang last-of-type left link local-link modal not nth-last-child nth-last-of-type nth-of-type only-child only-of-type optional out-of-range past paused picture-in-picture placeholder-shown playing popover-open read-only read-write required right root scope target target-within user-invalid user-valid valid visited where before after first-line first-letter".split())
_ANB = re.compile(r"(?:(even|odd)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))", re.I)


def selector_list(ts: list[Token], namespaces: set[str] = frozenset()) -> tuple[list[Selector], int]:
    """Supported selectors of a list and how many were not. Invalid if any is malformed."""
    good, dropped = [], 0
    for part in _split(ts, "comma"):
        part = _strip(part)
        if not part:
            raise Invalid("empty selector")
        try:
            good.append(_selector(part, namespaces))
        except Unsupported:
            dropped += 1
    return good, dropped


def _selector(ts: list[Token], namespaces: set[str]) -> Selector:
    compounds, combinators, i, unsupported = [], [], 0, None
    while i < len(ts):
        try:
            compound, i = _compound(ts, i, namespaces)
            compounds.append(compound)
        except Unsupported as u:
            unsupported = u
            i = u.args[1]
            compounds.append(Compound())
        space = False
        while i < len(ts) and ts[i].kind == "space":
            space, i = True, i + 1
        if i == len(ts):
            break
        if ts[i].kind == "delim" and ts[i].value in ">+~|":
            mark, i = ts[i].value, i + 1
            while i < len(ts) and ts[i].kind == "space":
                i += 1
            if i == len(ts):
                raise Invalid("combinator at the end")
            if mark in "~|":
                unsupported = Unsupported("combinator")
            combinators.append(mark)
        elif space:
            combinators.append(" ")
        else:
            raise Invalid("no combinator")
    if unsupported or len(compounds) > MAX_COMPOUNDS:
        raise Unsupported("selector")
    return Selector(compounds, combinators)


def _compound(ts: list[Token], i: int, namespaces: set[str]) -> tuple[Compound, int]:
    c, n, start, later = Compound(), 0, i, None
    is_star = lambda t: t.kind == "delim" and t.value == "*"
    if ts[i].kind == "ident" or is_star(ts[i]) or (ts[i].kind == "delim" and ts[i].value == "|"):
        bar = next((k for k in (i, i + 1) if k + 1 < len(ts) and ts[k].kind == "delim" and ts[k].value == "|" and (ts[k + 1].kind == "ident" or is_star(ts[k + 1]))), None)
        if bar is not None:
            if bar > i and ts[i].kind == "ident" and ts[i].value not in namespaces:
                raise Invalid("namespace")
            later = None if bar > i and is_star(ts[i]) else "namespace"
            i = bar + 1
        if ts[i].kind == "delim" and not is_star(ts[i]):
            raise Invalid("type")
        c.tag = None if is_star(ts[i]) else ts[i].value
        i, n = i + 1, 1
    while i < len(ts):
        t = ts[i]
        if t.kind == "hash":
            if not t.is_id:
                raise Invalid("id")
            c.impossible |= c.id not in (None, t.value)
            c.id, i = t.value, i + 1
        elif t.kind == "delim" and t.value == "." and i + 1 < len(ts) and ts[i + 1].kind == "ident":
            c.classes.append(ts[i + 1].value)
            i += 2
        elif t.kind == "[":
            end = next((k for k in range(i, len(ts)) if ts[k].kind == "]"), None)
            if end is None:
                raise Invalid("attribute")
            pair = _attribute(_strip(ts[i + 1 : end]), namespaces)
            if pair is None:
                later = "attribute"
            else:
                c.attrs.append(pair)
            i = end + 1
        elif t.kind == "colon":
            i, word = _pseudo(ts, i, c)
            later = later or word
        else:
            break
        n += 1
    if i == start:
        raise Invalid("compound")
    if later or n > MAX_SIMPLE or any(len(x) > MAX_NAME for x in (c.tag or "", c.id or "", *c.classes)):
        raise Unsupported(later or "limit", i)
    return c, i


def _attribute(ts: list[Token], namespaces: set[str]) -> tuple[str, str] | None:
    """(name, value) of an equality test; None for tests that aren't supported."""
    rest = [t for t in ts if t.kind != "space"]
    name = ""
    if len(rest) > 2 and rest[0].kind == "ident" and rest[1].value == "|" and rest[2].kind == "ident" and not (len(rest) > 3 and rest[2].value == "="):
        if rest[0].value not in namespaces and rest[0].value != "epub":
            raise Invalid("namespace")
        name, rest = f"{rest[0].value}:{rest[2].value}", rest[3:]
    elif rest and rest[0].kind == "ident":
        name, rest = rest[0].value, rest[1:]
    else:
        raise Invalid("attribute")
    if not rest:
        return None
    if rest[0].value in ("~", "|", "^", "$", "*") and len(rest) > 2 and rest[1].value == "=":
        if rest[2].kind not in ("ident", "string"):
            raise Invalid("attribute")
        return None
    if rest[0].value != "=" or len(rest) < 2 or rest[1].kind not in ("ident", "string"):
        raise Invalid("attribute")
    if len(rest) > 2:
        if rest[2].kind == "ident" and ascii_lower(rest[2].value) in ("i", "s") and len(rest) == 3:
            return None
        raise Invalid("attribute")
    return (name, rest[1].value) if ":" not in name or name == "epub:type" else None


def _pseudo(ts: list[Token], i: int, c: Compound) -> tuple[int, str | None]:
    """Reads a pseudo-class into c; the place after it and, if it isn't supported, its name."""
    double = i + 1 < len(ts) and ts[i + 1].kind == "colon"
    i += 1 + double
    if i >= len(ts) or ts[i].kind not in ("ident", "function"):
        raise Invalid("pseudo")
    name = ascii_lower(ts[i].value)
    if ts[i].kind == "ident":
        if not double and name in ("first-child", "last-child"):
            c.first, c.last = c.first or name[0] == "f", c.last or name[0] == "l"
            return i + 1, None
        if not (double or name in _KNOWN_PSEUDO or name.startswith("-")):
            raise Invalid(name)
        return i + 1, name
    depth, k = 1, i + 1
    while k < len(ts) and depth:
        depth += (ts[k].kind in _CLOSER) - (ts[k].kind in (")", "]", "}"))
        k += 1
    inner = _strip(ts[i + 1 : k - 1])
    if depth or not inner:
        raise Invalid(name)
    if name == "nth-child" and not double:
        m = _ANB.fullmatch("".join(t.value + t.unit if t.kind == "dimension" else " " if t.kind == "space" else t.value for t in inner))
        if not m:
            raise Invalid(name)
        if m[5] is None:
            return k, name
        n = int(m[5])
        c.impossible |= not 0 < n < 1 << 30 or c.nth not in (None, n)
        c.nth = n
        return k, None
    if not (double or name in _KNOWN_PSEUDO or name.startswith("-")):
        raise Invalid(name)
    return k, name


# Declarations: a value is a tuple that begins with its kind


@dataclass(frozen=True)
class Declaration:
    property: str
    value: tuple
    important: bool = False


def _words(pairs: str) -> dict[str, str]:
    return dict(p.split("=") if "=" in p else (p, p) for p in pairs.split())


#: Keywords of each property and what they come to. Fixed values.
KEYWORDS = {
    "display": _words("inline inline-block=inline inline-flex=inline inline-grid=inline inline-table=inline block flex=block grid=block flow-root=block table=block table-row-group=block table-header-group=block table-footer-group=block table-row=block table-cell=block table-column-group=block table-column=block table-caption=block list-item none"),
    "white-space": _words("normal pre nowrap pre-wrap pre-line break-spaces=pre-wrap"),
    "direction": _words("ltr rtl"),
    "text-align": _words("left right center justify=start start end"),
    "vertical-align": _words("baseline super sub top=baseline text-top=baseline middle=baseline bottom=baseline text-bottom=baseline"),
    "list-style-type": _words("disc circle square decimal lower-alpha lower-latin=lower-alpha upper-alpha upper-latin=upper-alpha lower-roman upper-roman none"),
    "break": _words("auto avoid avoid-page=avoid page left=page right=page recto=page verso=page always=page column=auto avoid-column=auto region=auto avoid-region=auto"),
    "page-break": _words("auto always=page avoid left=page right=page"),
    "break-inside": _words("auto avoid avoid-page=avoid avoid-column=avoid avoid-region=avoid"),
    "page-break-inside": _words("auto avoid"),
    "text-transform": _words("none uppercase lowercase capitalize"),
    "float": _words("left=1 right=1 inline-start=1 inline-end=1 none=0"),
    "position": _words("absolute=1 fixed=1 sticky=1 static=0 relative=0"),
    "writing-mode": _words("vertical-rl=1 vertical-lr=1 sideways-rl=1 sideways-lr=1 tb=1 tb-rl=1 horizontal-tb=0 lr=0 lr-tb=0 rl=0 rl-tb=0"),
    "font-variant-caps": _words("normal small-caps all-small-caps=small-caps petite-caps=normal all-petite-caps=normal unicase=normal titling-caps=normal"),
}
SIDES = ("top", "right", "bottom", "left")
LONGHANDS = [
    "display", "white-space", "direction", "vertical-align", "list-style-type", "break-before", "break-after", "break-inside", "width", "height", "text-align", "text-decoration", "font-style", "font-weight", "font-variant", "text-transform", "font-size",
    *(f"margin-{s}" for s in SIDES), *(f"padding-{s}" for s in SIDES), "text-indent", "float", "position", "column-count", "column-width", "writing-mode",
]
INHERITED = {"white-space", "direction", "list-style-type", "text-align", "font-style", "font-weight", "font-variant", "text-transform", "text-indent", "writing-mode"}
EXPANDS = {
    **{p: [p] for p in LONGHANDS},
    "list-style": ["list-style-type"],
    "page-break-before": ["break-before"],
    "page-break-after": ["break-after"],
    "page-break-inside": ["break-inside"],
    "font-variant-caps": ["font-variant"],
    "text-decoration-line": ["text-decoration"],
    "font": ["font-style", "font-variant", "font-weight", "font-size"],
    "margin": [f"margin-{s}" for s in SIDES],
    "padding": [f"padding-{s}" for s in SIDES],
    "columns": ["column-count", "column-width"],
    "-epub-writing-mode": ["writing-mode"],
    "-webkit-writing-mode": ["writing-mode"],
    "all": [p for p in LONGHANDS if p != "direction"],
}

#: Ems of a unit; 16 px are an em.
EM = {"em": 1, "rem": 1, "ex": 0.5, "ch": 0.5, "px": 1 / 16, "pt": 1 / 12, "pc": 1, "in": 6, "cm": 6 / 2.54, "mm": 6 / 25.4, "q": 6 / 101.6}
_OTHER_UNITS = set("vw vh vmin vmax vi vb svw svh lvw lvh dvw dvh cqw cqh cqi cqb cqmin cqmax lh rlh cap ic rex rch rcap ric".split())
_DEGREES = {"deg": 1, "grad": 0.9, "rad": 180 / math.pi, "turn": 360}
_SIZE_WORDS = set("xx-small x-small small medium large x-large xx-large xxx-large".split())
_STRETCH = set("ultra-condensed extra-condensed condensed semi-condensed semi-expanded expanded extra-expanded ultra-expanded".split())
_SYSTEM_FONTS = set("caption icon menu message-box small-caption status-bar".split())
_NO_FAMILY = set("inherit initial unset revert revert-layer default".split())
_LINES = {"underline", "overline", "line-through", "blink"}
_LINE_STYLES = {"solid", "double", "dotted", "dashed", "wavy"}
_MATH = {"calc", "min", "max", "clamp"}
_COLOR_FUNCTIONS = set("rgb rgba hsl hsla hwb lab lch oklab oklch color color-mix light-dark".split())
#: Named and system colours. Fixed values.
_COLORS = set(
    "transparent currentcolor aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange darkorchid darkred darksalmon darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey dodgerblue firebrick floralwhite forestgreen fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki lavender lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink lightsalmon lightseagreen lightskyblue lightslategray lightslategrey lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue mediumspringgreen mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange orangered orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple rebeccapurple red rosybrown royalblue saddlebrown salmon sandybrown seagreen seashell sienna silver skyblue slateblue slategray slategrey snow springgreen steelblue tan teal thistle tomato turquoise violet wheat white whitesmoke yellow yellowgreen "
    "accentcolor accentcolortext activetext buttonborder buttonface buttontext canvas canvastext field fieldtext graytext highlight highlighttext linktext mark marktext selecteditem selecteditemtext visitedtext".split()
)
#: Groups of font-variant words, of which each may be given once.
_VARIANTS = {
    w: group
    for group, listed in {
        "caps": "small-caps all-small-caps petite-caps all-petite-caps unicase titling-caps", "common": "common-ligatures no-common-ligatures", "discretionary": "discretionary-ligatures no-discretionary-ligatures",
        "historical": "historical-ligatures no-historical-ligatures", "contextual": "contextual no-contextual", "figure": "lining-nums oldstyle-nums", "spacing": "proportional-nums tabular-nums",
        "fraction": "diagonal-fractions stacked-fractions", "ordinal": "ordinal", "zero": "slashed-zero", "form": "jis78 jis83 jis90 jis04 simplified traditional", "width": "full-width proportional-width",
        "ruby": "ruby", "forms": "historical-forms", "position": "sub super", "emoji": "text emoji unicode",
    }.items()
    for w in listed.split()
}
_VARIANT_FUNCTIONS = set("stylistic styleset character-variant swash ornaments annotation".split())

Parsed = list[tuple[str, tuple]] | None


def _word(c: list[Token]) -> str | None:
    return ascii_lower(c[0].value) if len(c) == 1 and c[0].kind == "ident" else None


def _is_length(t: Token) -> bool:
    return (t.kind == "dimension" and math.isfinite(t.number) and (t.unit in EM or t.unit in _OTHER_UNITS)) or (t.kind == "number" and t.number == 0)


def _em(t: Token, percent: float | None) -> float | None:
    v = t.number * EM[t.unit] if t.kind == "dimension" and t.unit in EM else t.number * percent if t.kind == "percentage" and percent else 0.0 if t.kind == "number" and t.number == 0 else None
    return v if v is not None and math.isfinite(v) else None


def _clamp(v: float | None, low: float, high: float) -> tuple | None:
    return None if v is None else ("em", min(max(v, low), high))


def _edge(kind: str, t: Token) -> tuple | None:
    if kind == "margin" and t.kind == "ident":
        return ("em", 0.0) if ascii_lower(t.value) == "auto" else None
    v = _em(t, 0.3)
    return None if v is None or (kind == "padding" and v < 0) else _clamp(v, 0, 8)


def _box(name: str, c: list[Token]) -> Parsed:
    if not 1 <= len(c) <= 4:
        return None
    v = [_edge(name, t) for t in c]
    order = {1: (0, 0, 0, 0), 2: (0, 1, 0, 1), 3: (0, 1, 2, 1), 4: (0, 1, 2, 3)}[len(v)]
    return None if None in v else [(f"{name}-{s}", v[k]) for s, k in zip(SIDES, order, strict=True)]


def _size(c: list[Token]) -> tuple | None:
    if _word(c) == "auto":
        return ("auto",)
    if len(c) != 1:
        return None
    percent = c[0].kind == "percentage"
    v = c[0].number if percent else _em(c[0], None)
    return None if v is None or not math.isfinite(v) or v < 0 else ("percent" if percent else "em", min(v, 100.0))


def _angle(t: Token) -> bool:
    return t.kind == "dimension" and t.unit in _DEGREES and -90 <= t.number * _DEGREES[t.unit] <= 90


def _font_style(c: list[Token]) -> tuple | None:
    first = ascii_lower(c[0].value) if c and c[0].kind == "ident" else None
    if len(c) == 1:
        return {"normal": ("keyword", "normal"), "italic": ("keyword", "italic"), "oblique": ("keyword", "italic")}.get(first)
    return ("keyword", "italic") if len(c) == 2 and first == "oblique" and _angle(c[1]) else None


def _weight(t: Token) -> tuple | None:
    if t.kind == "number":
        return ("weight", t.number) if 1 <= t.number <= 1000 else None
    return {"normal": ("weight", 400.0), "bold": ("weight", 700.0), "bolder": ("bolder",), "lighter": ("lighter",)}.get(ascii_lower(t.value)) if t.kind == "ident" else None


def _font_size(t: Token) -> tuple | None:
    """A step against the parent; ('absolute',) for sizes that are valid and dropped."""
    word = ascii_lower(t.value) if t.kind == "ident" else None
    if word in ("smaller", "larger"):
        return ("step", word)
    if word in _SIZE_WORDS or (t.kind == "number" and t.number == 0):
        return ("absolute",)
    relative = {"em": 1, "rem": 1, "ex": 0.5, "ch": 0.5}.get(t.unit) if t.kind == "dimension" else 0.01 if t.kind == "percentage" else None
    if t.kind not in ("dimension", "percentage") or not math.isfinite(t.number) or t.number < 0:
        return None
    if relative is None:
        return ("absolute",) if _is_length(t) else None
    ratio = t.number * relative
    return ("step", "smaller" if ratio < 0.95 else "larger" if ratio > 1.05 else "same")


def _font(c: list[Token]) -> Parsed:
    if not c or _word(c) in _SYSTEM_FONTS:
        return None
    style, variant, weight, stretch, i = None, None, None, False, 0
    for _ in range(4):
        if i >= len(c):
            break
        t, w = c[i], ascii_lower(c[i].value) if c[i].kind == "ident" else None
        if w == "normal":
            pass
        elif w in ("italic", "oblique") and style is None:
            style = "italic"
            i += w == "oblique" and i + 1 < len(c) and _angle(c[i + 1])
        elif w == "small-caps" and variant is None:
            variant = w
        elif weight is None and (t.kind == "number" or w in ("bold", "bolder", "lighter")) and (got := _weight(t)):
            weight = got
        elif w in _STRETCH and not stretch:
            stretch = True
        else:
            break
        i += 1
    size = _font_size(c[i]) if i < len(c) else None
    if size is None:
        return None
    i += 1
    if i < len(c) and c[i].kind == "delim" and c[i].value == "/":
        h = c[i + 1] if i + 1 < len(c) else None
        fits = h is not None and ((h.kind in ("number", "percentage") and math.isfinite(h.number) and h.number >= 0) or (h.kind == "dimension" and _is_length(h) and h.number >= 0) or (h.kind == "ident" and ascii_lower(h.value) == "normal"))
        if not fits:
            return None
        i += 2
    for name in _split(c[i:], "comma"):
        kinds = {t.kind for t in name}
        if not name or kinds - {"ident", "string"} or (kinds != {"ident"} and len(name) > 1) or (len(name) == 1 and kinds == {"ident"} and ascii_lower(name[0].value) in _NO_FAMILY):
            return None
    head = [("font-style", ("keyword", style or "normal")), ("font-variant", ("keyword", variant or "normal")), ("font-weight", weight or ("weight", 400.0))]
    return head + ([("font-size", size)] if size[0] == "step" else [])


def _font_variant(c: list[Token]) -> tuple | None:
    if _word(c) in ("normal", "none"):
        return ("keyword", "normal")
    seen, small = set(), False
    for t in c:
        w = ascii_lower(t.value)
        group = _VARIANTS.get(w) if t.kind == "ident" else w if t.kind == "function" and w in _VARIANT_FUNCTIONS else None
        if group is None or group in seen:
            return None
        seen.add(group)
        small |= w in ("small-caps", "all-small-caps")
    return ("keyword", "small-caps" if small else "normal") if c else None


def _lines(words: list[str]) -> tuple:
    return ("decoration", "underline" in words, "line-through" in words)


def _decoration_line(c: list[Token]) -> tuple | None:
    words = [ascii_lower(t.value) if t.kind == "ident" else "" for t in c]
    if words == ["none"]:
        return _lines([])
    return _lines(words) if words and set(words) <= _LINES and len(set(words)) == len(words) else None


def _decoration(c: list[Token]) -> tuple | None:
    seen: dict[str, int] = {}
    lines: list[str] = []
    for at, t in enumerate(c):
        w = ascii_lower(t.value)
        if t.kind == "ident":
            kind = "none" if w == "none" else "line" if w in _LINES else "style" if w in _LINE_STYLES else "thickness" if w in ("auto", "from-font") else "color" if w in _COLORS else None
        elif t.kind == "hash":
            kind = "color" if re.fullmatch("[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8}", t.value) else None
        elif t.kind == "function":
            kind = "color" if w in _COLOR_FUNCTIONS else "thickness" if w in _MATH else None
        else:
            kind = "thickness" if _is_length(t) or (t.kind == "percentage" and math.isfinite(t.number)) else None
        if kind is None or (kind != "line" and kind in seen) or (kind == "line" and (w in lines or (lines and seen["line"] != at - 1))):
            return None
        seen[kind] = at
        if kind == "line":
            lines.append(w)
    return None if not c or ("none" in seen and lines) else _lines(lines)


def _list_type(t: Token) -> tuple | None:
    if t.kind == "string":
        return ("unknown-list",)
    known = KEYWORDS["list-style-type"].get(ascii_lower(t.value))
    return None if t.kind != "ident" else ("keyword", known) if known else ("unknown-list",)


def _list_style(c: list[Token]) -> tuple | None:
    """Type, position and image in any order; 'none' is for what isn't given."""
    kind, place, image, nones = None, False, False, 0
    for t in c:
        w = ascii_lower(t.value) if t.kind == "ident" else None
        if w == "none":
            nones += 1
        elif w in ("inside", "outside") and not place:
            place = True
        elif t.kind in ("url", "function") and not image:
            image = True
        elif t.kind in ("ident", "string") and kind is None:
            kind = ("unknown-list",) if w in ("inside", "outside") else _list_type(t)
        else:
            return None
    if not 1 <= len(c) <= 3 or nones > (kind is None) + (not image):
        return None
    return kind or ("keyword", "none" if nones else "disc")


def _column(kind: str, t: Token) -> tuple | None:
    if t.kind == "ident":
        return ("degraded", False, "auto") if ascii_lower(t.value) == "auto" else None
    if kind == "column-count":
        return ("degraded", t.number > 1, t.value) if t.kind == "number" and t.integer and t.number >= 1 else None
    return ("degraded", True, t.value + t.unit) if _is_length(t) and t.number >= 0 else None


def _columns(c: list[Token]) -> Parsed:
    if not 1 <= len(c) <= 2:
        return None
    given: dict[str, tuple | None] = {}
    for t in c:
        if t.kind == "ident" and ascii_lower(t.value) == "auto":
            continue
        kind = "column-count" if t.kind == "number" and t.number != 0 and "column-count" not in given else "column-width"
        if kind in given:
            return None
        given[kind] = _column(kind, t)
    auto = ("degraded", False, "auto")
    return None if None in given.values() else [(k, given.get(k, auto)) for k in ("column-count", "column-width")]


def _vertical(c: list[Token]) -> tuple | None:
    word = _word(c)
    if word is not None:
        return ("keyword", KEYWORDS["vertical-align"][word]) if word in KEYWORDS["vertical-align"] else None
    return ("keyword", "baseline") if len(c) == 1 and (_is_length(c[0]) or (c[0].kind == "percentage" and math.isfinite(c[0].number))) else None


def _by_keyword(table: str) -> Callable[[list[Token]], tuple | None]:
    return lambda c: ("keyword", v) if (v := KEYWORDS[table].get(_word(c) or "")) else None


def _degrading(table: str) -> Callable[[list[Token]], tuple | None]:
    return lambda c: ("degraded", v == "1", _word(c)) if (v := KEYWORDS[table].get(_word(c) or "")) else None


_ONE: dict[str, Callable[[list[Token]], tuple | None]] = {
    **{p: _by_keyword(p) for p in ("display", "white-space", "direction", "text-align", "text-transform", "break-inside", "page-break-inside", "font-variant-caps")},
    **{p: _by_keyword("break") for p in ("break-before", "break-after")},
    **{p: _by_keyword("page-break") for p in ("page-break-before", "page-break-after")},
    **{p: _degrading(p) for p in ("float", "position", "writing-mode")},
    **{p: _degrading("writing-mode") for p in ("-epub-writing-mode", "-webkit-writing-mode")},
    **{f"{k}-{s}": (lambda c, k=k: _edge(k, c[0]) if len(c) == 1 else None) for k in ("margin", "padding") for s in SIDES},
    **{p: (lambda c, p=p: _column(p, c[0]) if len(c) == 1 else None) for p in ("column-count", "column-width")},
    "width": _size,
    "height": _size,
    "vertical-align": _vertical,
    "list-style-type": lambda c: _list_type(c[0]) if len(c) == 1 else None,
    "list-style": _list_style,
    "font-style": _font_style,
    "font-weight": lambda c: _weight(c[0]) if len(c) == 1 else None,
    "font-variant": _font_variant,
    "text-decoration-line": _decoration_line,
    "text-decoration": _decoration,
    "font-size": lambda c: v if len(c) == 1 and (v := _font_size(c[0])) and v[0] == "step" else None,
    "text-indent": lambda c: _clamp(_em(c[0], 0.3), -4, 8) if len(c) == 1 else None,
}


def declare(name: str, value: list[Token], important: bool = False) -> list[Declaration]:
    """Typed longhands of a declaration; none if the property isn't known or the value isn't valid."""
    prop = ascii_lower(name)
    if prop not in EXPANDS:
        return []
    flat, depth = [], 0
    for t in value:  # a function counts as its name
        if depth == 0 and t.kind != "space":
            flat.append(t)
        if t.kind == "function" and ascii_lower(t.value) == "var":
            return []
        depth += (t.kind in _CLOSER) - (t.kind in (")", "]", "}"))
    wide = _word(flat)
    if wide in ("inherit", "initial", "unset"):
        found: Parsed = [(p, ("wide", wide)) for p in EXPANDS[prop]]
    elif prop in ("margin", "padding"):
        found = _box(prop, flat)
    elif prop in ("font", "columns"):
        found = {"font": _font, "columns": _columns}[prop](flat)
    else:
        one = _ONE[prop](flat) if prop in _ONE and flat else None
        found = [(EXPANDS[prop][0], one)] if one else None
    return [Declaration(p, v, important) for p, v in found or []]


# Sheets


@dataclass
class Rule:
    selectors: list[Selector]
    declarations: list[Declaration]


@dataclass
class Sheet:
    """Rules, imports (href, media matches) and issues (reason, key, sample, count) of a sheet."""

    rules: list[Rule] = field(default_factory=list)
    imports: list[tuple[str, bool]] = field(default_factory=list)
    issues: dict[tuple[str, str], list] = field(default_factory=dict)
    media_ignored: int = 0

    def issue(self, reason: str, key: str, text: str = "") -> None:
        self.issues.setdefault((reason, key), [sample(text), 0])[1] += 1


def _balanced(ts: list[Token], i: int, stops: tuple[str, ...]) -> int:
    """Index of the first stop outside of brackets from i on; len(ts) without one."""
    depth: list[str] = []
    while i < len(ts):
        k = ts[i].kind
        if not depth and k in stops:
            return i
        if k in _CLOSER:
            depth.append(_CLOSER[k])
        elif depth and k == depth[-1]:
            depth.pop()
        i += 1
    return i


def _block_end(ts: list[Token], i: int) -> int:
    """Index of what closes the block that opens at i."""
    return _balanced(ts, i + 1, ("}",))


def media_matches(ts: list[Token]) -> bool:
    """Whether a media query list can be met on a screen; conditions on features never are."""
    ts = _strip(ts)
    if not ts:
        return True
    for query in _split(ts, "comma"):
        words = [ascii_lower(t.value) if t.kind == "ident" else t.kind for t in query if t.kind != "space"]
        negated = words[:1] == ["not"]
        words = words[1:] if words[:1] in (["only"], ["not"]) else words
        if len(words) == 1 and words[0] not in ("(", "function") and (words[0] in ("all", "screen")) != negated:
            return True
    return False


_AT_KNOWN = set("font-face page keyframes -webkit-keyframes -moz-keyframes supports counter-style font-feature-values font-palette-values property container scope starting-style view-transition viewport -ms-viewport document -moz-document".split())


def parse_sheet(text: str) -> Sheet:
    """The sheet's rules in order. What can't be used is counted as an issue; nothing raises."""
    sheet, ts = Sheet(), list(tokenize(text))
    namespaces: set[str] = set()
    imports_open, spans = True, [(0, len(ts), 1)]
    while spans:
        i, end, depth = spans.pop()
        while i < end:
            t = ts[i]
            if t.kind in ("space", "cdo", "cdc") or (depth > 1 and t.kind in ("semicolon", "}")):
                i += 1
            elif t.kind == "at":
                name = ascii_lower(t.value)
                stop = _balanced(ts, i + 1, ("semicolon", "{", *(("}",) if depth > 1 else ())))
                prelude, block = ts[i + 1 : min(stop, end)], stop < end and ts[stop].kind == "{"
                close = _block_end(ts, stop) if block else stop
                if name == "import":
                    _import(sheet, prelude, imports_open and depth == 1 and not block)
                elif name == "media" and block:
                    imports_open = False
                    if not media_matches(prelude):
                        sheet.media_ignored += 1
                    elif depth >= MAX_NESTING:
                        sheet.issue("nesting", "media")
                    else:
                        spans.append((close + 1, end, depth))
                        i, end, depth = stop + 1, min(close, end), depth + 1
                        continue
                elif name == "layer" and block:
                    imports_open = False
                    spans.append((close + 1, end, depth))
                    i, end, depth = stop + 1, min(close, end), depth + 1
                    continue
                elif name == "namespace" and not block:
                    first = _strip(prelude)
                    if len(first) > 1 and first[0].kind == "ident":
                        namespaces.add(first[0].value)
                elif name == "charset":
                    pass
                elif name != "layer":
                    imports_open = False
                    sheet.issue("at-rule" if name in _AT_KNOWN else "unknown-at-rule", "@" + name)
                i = close + 1
            else:
                stop = _balanced(ts, i, ("{", *(("}",) if depth > 1 else ())))
                if stop >= end or ts[stop].kind != "{":
                    sheet.issue("parse", "rule")
                    i = stop + 1
                    continue
                imports_open = False
                close = _block_end(ts, stop)
                declarations = _declarations(sheet, ts[stop + 1 : min(close, end)])
                try:
                    selectors, dropped = selector_list(ts[i:stop], namespaces)
                    for _ in range(dropped):
                        sheet.issue("selector", "unsupported")
                    if selectors and declarations:
                        sheet.rules.append(Rule(selectors, declarations))
                except Invalid as error:
                    sheet.issue("selector", "invalid", str(error))
                i = close + 1
    return sheet


def _import(sheet: Sheet, prelude: list[Token], allowed: bool) -> None:
    prelude = _strip(prelude)
    ref = prelude[0] if prelude else Token("none")
    rest = prelude[1:]
    if ref.kind == "function" and ascii_lower(ref.value) == "url" and rest and rest[0].kind == "string":
        ref, rest = rest[0], rest[2:]
    rest = _strip(rest)
    if not allowed or ref.kind not in ("string", "url") or not ref.value.strip():
        sheet.issue("late-import" if ref.kind in ("string", "url") and not allowed else "unsupported-import", "@import")
    elif rest and ascii_lower(rest[0].value) in ("layer", "supports"):
        sheet.issue("unsupported-import", "@import")
    else:
        ok = media_matches(rest)
        sheet.media_ignored += not ok
        sheet.imports.append((ref.value, ok))


def _declarations(sheet: Sheet | None, ts: list[Token]) -> list[Declaration]:
    out, i = [], 0
    while i < len(ts):
        if ts[i].kind in ("space", "semicolon"):
            i += 1
            continue
        stop = _balanced(ts, i, ("semicolon",))
        part = _strip(ts[i:stop])
        if ts[i].kind == "at" or any(t.kind == "{" for t in part) and not (part[0].kind == "ident" and part[0].value.startswith("--")):
            brace = _balanced(ts, i, ("{", "semicolon"))
            i = _block_end(ts, brace) + 1 if brace < len(ts) and ts[brace].kind == "{" else brace + 1
            if sheet:
                sheet.issue("nested-rule", "rule")
            continue
        i = stop + 1
        colon = next((k for k, t in enumerate(part) if t.kind != "space" and k > 0), None)
        if part[0].kind != "ident" or colon is None or part[colon].kind != "colon":
            if sheet:
                sheet.issue("parse", "declaration")
            continue
        value = _strip(part[colon + 1 :])
        marks = [k for k, t in enumerate(value) if t.kind != "space"][-2:]
        important = len(marks) == 2 and value[marks[0]].value == "!" and value[marks[0]].kind == "delim" and value[marks[1]].kind == "ident" and ascii_lower(value[marks[1]].value) == "important"
        if important:
            value = _strip(value[: marks[0]])
        bad = not part[0].value.startswith("--") and any(t.kind in ("bad-string", "bad-url") or (t.kind == "delim" and t.value == "!") for t in value)
        if bad:
            if sheet:
                sheet.issue("parse", "declaration")
            continue
        out += declare(part[0].value, value, important)
    return out


def parse_style(text: str) -> list[Declaration]:
    """Declarations of a style attribute."""
    return _declarations(None, list(tokenize(text)))


#: The sheet under all others. A fixed value.
USER_AGENT = """
html, body, address, blockquote, center, div, figure, figcaption, footer,
header, hgroup, main, nav, section, article, aside, search, details, summary,
form, fieldset, legend, hr, p, pre, listing, xmp, plaintext,
h1, h2, h3, h4, h5, h6, dl, dt, dd, ol, ul, menu, dir,
table, caption, thead, tbody, tfoot, tr, td, th, colgroup, col { display: block }
li { display: list-item }
head, script, style, title, meta, link, base, template, area, param,
datalist, source, track, noembed, noframes { display: none }
pre, listing, xmp, plaintext { white-space: pre }
nobr { white-space: nowrap }
center, caption, th { text-align: center }
h1, h2, h3, h4, h5, h6, th { font-weight: bold }
b, strong { font-weight: bolder }
i, cite, em, var, dfn, address { font-style: italic }
u, ins { text-decoration: underline }
s, strike, del { text-decoration: line-through }
h1 { font-size: 2em }
h2 { font-size: 1.5em }
h3 { font-size: 1.17em }
h4 { font-size: 1em }
h5 { font-size: 0.83em }
h6 { font-size: 0.67em }
small, sub, sup { font-size: smaller }
big { font-size: larger }
sup { vertical-align: super }
sub { vertical-align: sub }
ul, menu, dir { list-style-type: disc }
ol { list-style-type: decimal }
ol[type="1"], li[type="1"] { list-style-type: decimal }
ol[type="a"], li[type="a"] { list-style-type: lower-alpha }
ol[type="A"], li[type="A"] { list-style-type: upper-alpha }
ol[type="i"], li[type="i"] { list-style-type: lower-roman }
ol[type="I"], li[type="I"] { list-style-type: upper-roman }
ul, ol, menu, dir { padding-left: 2.5em }
dd { margin-left: 2.5em }
blockquote { margin: 1em 2.5em }
"""


def decode_sheet(data: bytes) -> tuple[str, dict | None]:
    """Text of a sheet: byte order mark, then an exact @charset, then UTF-8; Latin-1 with a note where the bytes belie it."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace"), None
    m = re.match(rb'@charset "([^"]{1,64})";', data)
    label = m[1].decode("latin-1").strip().lower() if m else "utf-8"
    if label in ("iso-8859-1", "latin1", "windows-1252", "us-ascii"):
        return data.decode("latin-1"), None
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        return data.decode("latin-1"), {"declared": label, "used": "latin1"}


def is_stylesheet_link(attrs: dict[str, str]) -> bool:
    """Whether a link element brings a sheet that applies."""
    rel = {ascii_lower(t) for t in tokens(attrs.get("rel"))}
    kind = ascii_lower(attrs.get("type", "").partition(";")[0].strip())
    return "stylesheet" in rel and "alternate" not in rel and kind in ("", "text/css") and bool(attrs.get("href", "").strip()) and media_matches(list(tokenize(attrs.get("media", ""))))
