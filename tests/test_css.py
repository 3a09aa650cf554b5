import random

import pytest

from quire.functions import css
from quire.operators import cascade as C
from quire.sources.htmltree import parse_html


def decls(text):
    return {d.property: d.value for d in css.parse_style(text)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("margin: 1em 2px", {"margin-top": ("em", 1.0), "margin-right": ("em", 0.125), "margin-bottom": ("em", 1.0), "margin-left": ("em", 0.125)}),
        ("margin: -3em; padding: -1em", {f"margin-{s}": ("em", 0) for s in css.SIDES}),
        ("margin-top: 99em", {"margin-top": ("em", 8)}),
        ("text-indent: -9em", {"text-indent": ("em", -4)}),
        ("text-indent: 10%", {"text-indent": ("em", 3.0)}),
        ("width: 120%", {"width": ("percent", 100.0)}),
        ("width: auto; height: 2", {"width": ("auto",)}),
        ("font-size: 12pt", {}),
        ("font-size: 0.9em", {"font-size": ("step", "smaller")}),
        ("font-size: 100%", {"font-size": ("step", "same")}),
        ("font: italic bold 2em/1.5 'A B', serif", {"font-style": ("keyword", "italic"), "font-variant": ("keyword", "normal"), "font-weight": ("weight", 700.0), "font-size": ("step", "larger")}),
        ("font: caption", {}),
        ("font: 12pt inherit", {}),
        ("font-weight: 1001; font-weight: 350", {"font-weight": ("weight", 350.0)}),
        ("font-style: oblique 14deg", {"font-style": ("keyword", "italic")}),
        ("font-style: oblique 2turn", {}),
        ("text-decoration: underline red wavy", {"text-decoration": ("decoration", True, False)}),
        ("text-decoration: underline red line-through", {}),
        ("text-decoration: none", {"text-decoration": ("decoration", False, False)}),
        ("list-style: inside none", {"list-style-type": ("keyword", "none")}),
        ("list-style: url(a) square", {"list-style-type": ("keyword", "square")}),
        ("list-style: none none none", {}),
        ("list-style-type: foo", {"list-style-type": ("unknown-list",)}),
        ("columns: 2 10em", {"column-count": ("degraded", True, "2"), "column-width": ("degraded", True, "10em")}),
        ("float: LEFT", {"float": ("degraded", True, "left")}),
        ("display: var(--x)", {}),
        ("display: flex !important", {"display": ("keyword", "block")}),
        ("DISPLAY: N\\6fne", {"display": ("keyword", "none")}),
        ("all: inherit", {p: ("wide", "inherit") for p in css.EXPANDS["all"]}),
        ("break-before: recto; page-break-after: column", {"break-before": ("keyword", "page")}),
        ("vertical-align: 3px; vertical-align: super", {"vertical-align": ("keyword", "super")}),
        ("font-variant: small-caps tabular-nums", {"font-variant": ("keyword", "small-caps")}),
        ("font-variant: small-caps unicase", {}),
        ("color: red; ; bogus; display: none", {"display": ("keyword", "none")}),
    ],
)
def test_declarations(text, want):
    assert decls(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("p", 1), (".a.b", 2 << 10), ("#x p", (1 << 20) + 1), ("p:first-child", (1 << 10) + 1), ("a:hover", "unsupported"), ("a ~ b", "unsupported"), ("a::before", "unsupported"), ("a:bogus", "invalid"), ("a,", "invalid"), ("[a=b]", 1 << 10), ("[a~=b]", "unsupported"), ("[a=]", "invalid"), (":nth-child(3)", 1 << 10), (":nth-child(2n+1)", "unsupported"), (":nth-child(x)", "invalid"), ("a >", "invalid"), ("x|p", "invalid"), ("*|p", 1), ("*", 0), ("#1a", "invalid"), ("[epub|type=x]", 1 << 10)],
)
def test_selectors(text, want):
    try:
        good, dropped = css.selector_list(list(css.tokenize(text)))
        assert ("unsupported" if dropped else good[0].specificity) == want
    except css.Invalid:
        assert want == "invalid"


def test_tokens():
    assert [(t.kind, t.value, t.unit) for t in css.tokenize("a\\62 c/**/1.5e1PX '\\27' url( x ) #1a --x @m 5% <!--")] == [("ident", "abc", ""), ("dimension", "1.5e1", "px"), ("space", "", ""), ("string", "'", ""), ("space", "", ""), ("url", "x", ""), ("space", "", ""), ("hash", "1a", ""), ("space", "", ""), ("ident", "--x", ""), ("space", "", ""), ("at", "m", ""), ("space", "", ""), ("percentage", "5", ""), ("space", "", ""), ("cdo", "", "")]


def test_sheet():
    s = css.parse_sheet("@import 'a' screen; @import url(b) print; p{color:red} @import 'c'; @media screen and (x) {q{display:none}} @media all{r{display:none}} @font-face{} i,b:hover{display:none} }x{display:none}")
    assert s.imports == [("a", True), ("b", False)] and [r.selectors[0].compounds[0].tag for r in s.rules] == ["r", "i"]
    assert ("late-import", "@import") in s.issues and ("selector", "unsupported") in s.issues


@pytest.mark.parametrize(("text", "want"), [("", True), ("screen", True), ("print", False), ("not print", True), ("not screen", False), ("only screen", True), ("print, all", True), ("screen and (min-width: 1px)", False)])
def test_media(text, want):
    assert css.media_matches(list(css.tokenize(text))) is want


def styles(html, **kw):
    root = parse_html(html)
    c = C.Cascade([C.parsed(t) for _, t in C.load_sheets(root, "", lambda p: None).sheets], **kw)
    return c, [(n.element.attrs.get("id") or n.tag, s, o) for n, s, o in c.run(root)]


def test_cascade():
    _, got = styles("<style>#a{display:none}.x{display:inline!important;text-decoration:underline}p{font-weight:bold}b{font-weight:bolder}p>b:last-child{text-transform:uppercase}</style><p id=a class=x style='display:block'>1<b>2</b><i style='text-decoration:none;font-weight:inherit'>3</i><b id=z>4</b>")
    s = {k: v for k, v, _ in got}
    assert s["a"]["display"] == "inline" and s["a"]["font-weight"] == 700 and s["b"]["font-weight"] == 900
    assert s["i"]["underline"] and s["z"]["text-transform"] == "uppercase" and s["b"]["text-transform"] == "none"
    assert {k: o for k, _, o in got}["a"]["display"] == "author"


def test_hints_and_lists():
    _, got = styles("<ul id=a><li><ul id=b><li><ul id=c><ol id=d></ol></ul></ul></ul><p hidden id=e><p hidden=until-found id=f><p dir=RTL id=g style='text-align:left'>")
    s = {k: v for k, v, _ in got}
    assert [s[k]["list-style-type"] for k in "abcd"] == ["disc", "circle", "square", "decimal"]
    assert s["e"]["display"] == "none" and s["f"]["display"] == "block" and C.text_align(s["g"]) == "end"


def test_budget_and_depth():
    c, got = styles("<style>p{text-indent:1em}</style>" + "<p>x</p>" * 50, budget=20)
    assert c.exhausted and got[-1][1]["text-indent"] == 0 and got[4][1]["text-indent"] == 1
    _, deep = styles("<style>div{margin-top:1em}</style>" + "<div>" * 300)
    assert deep[-1][1]["margin-top"] == 0 and deep[100][1]["margin-top"] == 1


def test_imports():
    files = {"css/a.css": b"@import 'b.css'; p{}", "css/b.css": b"@import 'a.css'; @import '../c%20d.css'; q{display:none}", "c d.css": b"\xe9{}"}
    root = parse_html("<link rel=stylesheet href=css/a.css><link rel='alternate stylesheet' href=x><link rel=stylesheet href=gone.css><link rel=stylesheet media=print href=css/b.css>")
    out = C.load_sheets(root, "t.xhtml", files.get)
    assert [n for n, _ in out.sheets] == ["c d.css", "css/b.css", "css/a.css"]
    assert {(a, c.split(":")[0]) for a, _, c in out.diagnostics} >= {("stylesheetIgnored", "cycle"), ("stylesheetIgnored", "missing"), ("encodingFallback", "latin1")}


def test_declared_and_relational_winner_agree(spark):
    from quire.operators.relational import cascade_winner

    html = "<style>p{display:inline;text-indent:1em}.k{display:none}#q{display:block}*{text-indent:2em}</style><p class=k>1<p id=q class='k l'>2<div>3"
    root = parse_html(html)
    sheets = [C.parsed(t) for _, t in C.load_sheets(root, "", lambda p: None).sheets]
    rules = [(*s.bucket, 1, 0, s.specificity, seq * 100 + k, d.property, " ".join(map(str, d.value))) for seq, r in enumerate(sheets[0].rules) for s in r.selectors for k, d in enumerate(r.declarations)]
    nodes = [(i, n, o) for i, (n, _, o) in enumerate(C.Cascade(sheets).run(root))]
    elements = [(i, n.id, n.classes, n.tag) for i, n, _ in nodes]
    got = cascade_winner(spark.createDataFrame(elements, "eid int, id string, classes array<string>, tag string"), spark.createDataFrame(rules, "kind string, key string, layer int, attached int, spec long, seq long, property string, value string")).collect()
    want = {(i, p) for i, _, o in nodes for p, where in o.items() if where == "author"}
    assert {(r.eid, r.property) for r in got} == want


def test_hostile_input_ends():
    rng = random.Random(1)
    bits = ["{", "}", "(", ")", "[", "]", "@media", "@import ", "p", ".a", "#", "'", '"', "\\", "/*", "*/", ":", ";", "url(", "!important", "1e9", "é", "\0", "<!--", ","]
    for _ in range(400):
        css.parse_sheet("".join(rng.choice(bits) for _ in range(rng.randint(1, 80))))
    css.parse_sheet("{" * 50_000)
    css.parse_sheet("@media all{" * 500)
    css.parse_sheet("a" * 100_000 + "{display:none}")


def test_tables(spark):
    from quire.operators.cascade import computed_styles, sheet_rules

    pages = spark.createDataFrame([(1, "<style>p{margin:1em}</style><p>x"), (2, None)], "key long, html string")
    rows = computed_styles(pages).where("tag = 'p'").collect()
    assert [(r.margin_top, r.origins["margin-top"]) for r in rows] == [(1.0, "author")]
    assert sheet_rules(spark.createDataFrame([(1, "p,q{margin:0}"), (2, None)], "key long, css string")).count() == 4


def test_books(spark):
    from quire.sources.epub import BookWriter, section

    head = '<link rel="stylesheet" href="../css/a.css"/><link rel="stylesheet" href="gone.css"/>'
    w = BookWriter(sections=[("Text/a.xhtml", section("A", ["x", "y"], head))], toc=[("A", "Text/a.xhtml", 1)], extra=[("css/a.css", b"@import 'b.css'; p{margin-top:3em;float:left} p:hover{x:y}", "text/css"), ("css/b.css", b"p{margin-top:1em;text-indent:1em}", "text/css")])
    df = spark.createDataFrame([("k", bytearray(w.build())), ("bad", bytearray(b"x"))], "book_id string, content binary")
    got = C.book_styles(df).where("tag = 'p'").collect()
    assert [(r.margin_top, r.text_indent) for r in got] == [(3.0, 1.0)] * 2
    assert {(r.code, r.href, r.reason) for r in C.style_diagnostics(df).collect()} == {("stylesheetIgnored", "OEBPS/Text/gone.css", "missing"), ("unsupportedLayout", "OEBPS/Text/a.xhtml", "float:left"), ("cssRuleIgnored", "OEBPS/css/a.css", "selector:unsupported:1")}
