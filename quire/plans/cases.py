"""Registered queries over books and pages that are made to have a known answer, one for each row of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cascade
from quire.sources import books as B
from quire.sources.epub import BookWriter, section

Query = Callable[[SparkSession, str], DataFrame]

IMAGE = b"\x89PNG\r\n"


def _made(rows: DataFrame, build: Callable[[int, str], bytes]) -> DataFrame:
    """(book_id, content): a book for each row of rows(key, name).

    The rows are dealt out first: they are small and may come as one split,
    while each makes a book that has to be read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"book_id": pdf["key"].astype(str), "content": [build(int(k), n) for k, n in zip(pdf["key"], pdf["name"], strict=True)]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").mapInPandas(run, "book_id string, content binary")


def _titles(k: int) -> str:
    if k % 3 == 1:
        return f'<dc:title id="m">Main {k}</dc:title><meta refines="#m" property="title-type">Main</meta>'
    return f'<dc:title id="u">Sub {k}</dc:title><meta refines="#u" property="title-type">subtitle</meta>' if k % 3 == 2 else ""


def _people(k: int) -> str:
    role = {0: "", 1: '<meta refines="#a" property="role">aut</meta>', 2: '<meta refines="#a" property="role">ill</meta>', 3: ""}[k % 4]
    attribute = ' role="Edt"' if k % 4 == 3 else ""
    again = f'<dc:creator id="a">Second {k}</dc:creator>'  # of a repeated id only the first is refined
    return f'<dc:creator id="a"{attribute}>First {k}</dc:creator>{role}{again}<dc:contributor>Helper</dc:contributor>'


def _dates(k: int) -> str:
    given = {
        0: '<dc:date event="modification">2001-02-03</dc:date><dc:date>1999-12</dc:date>',
        1: '<dc:date>1990</dc:date><dc:date event="publication">2004-02-29T23:30:00-01:00</dc:date>',
        2: "",
        3: "<dc:date>2010-13-01</dc:date>",
    }[k % 4]
    return given + ('<meta property="dcterms:modified">2020-05-06T07:08:09Z</meta>' if k % 8 < 2 else "")


def _series(k: int) -> str:
    own = '<meta id="c" property="belongs-to-collection">Own</meta><meta refines="#c" property="group-position">2.5</meta>'
    other = '<meta name="calibre:series" content="Other"/><meta name="calibre:series_index" content="{}"/>'
    kind = '<meta refines="#c" property="collection-type">{}</meta>'
    return {0: own, 1: own + kind.format("set") + other.format(7), 2: own + kind.format("Series"), 3: other.format("many"), 4: ""}[k % 5]


def _cover(w: BookWriter, k: int) -> None:
    """An image and how the package points to it: property, id, path, a name that says so, or not at all."""
    kind = k % 6
    pictures = {0: ["a.png"], 1: ["a.png", "b.png"], 2: ["a.png", "b.png"], 3: ["a.png", "xcover1.png", "COVER.png"], 4: ["a.png", "recover.png"], 5: ["a.png"]}[kind]
    for n, p in enumerate(pictures):
        w.files.append((f"OEBPS/img/{p}", IMAGE))
        properties = ' properties="svg cover-image"' if kind == 0 else ""
        w.items += f'<item id="p{n}" href="img/{p}" media-type="image/png"{properties}/>'
    if kind in (1, 2):
        w.metadata += f'<meta name="cover" content="{"p1" if kind == 1 else "img/b.png"}"/>'


def described_book(k: int, name: str) -> bytes:
    """A book whose metadata take another form for each remainder of its key."""
    w = BookWriter(title=name, language="pt-BR" if k % 2 else "en", sections=[("c.xhtml", section("C", ["x"]))], toc=[("C", "c.xhtml", 1)])
    w.metadata = _titles(k) + _people(k) + _dates(k) + _series(k)
    w.metadata += f"<dc:identifier> isbn:{k}\n</dc:identifier><dc:publisher>House <![CDATA[& Co]]></dc:publisher><dc:subject>s{k % 5}</dc:subject><dc:subject/><dc:subject>all</dc:subject>"
    w.metadata += f'<dc:source>src{k}</dc:source><meta property="x:y">v{k % 9}</meta><meta property="x:y">w</meta><meta name="n" content="o"/>'
    w.metadata += '<meta property="rendition:layout">pre-paginated</meta>' if k % 7 == 0 else ""
    _cover(w, k)
    way = ["", ' page-progression-direction="RTL"', ' page-progression-direction="ltr"'][k % 3]
    w.opf = w.package().replace("<spine", f"<spine{way}")
    return w.build()


def epub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packages say of a book for each customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    m = B.metadata(B.read_books(_made(rows, described_book)))
    stamp = lambda c: F.unix_millis(c)
    joined = [F.array_join(c, "|").alias(c) for c in ("authors", "contributors", "subjects", "identifiers")]
    raw = F.array_join(F.transform(F.array_sort(F.map_entries("raw")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return m.select(
        F.col("book_id").cast("bigint").alias("c_custkey"), "title", "subtitle", "language", "publisher", *joined, "series", "series_index", "layout", "direction", "cover_path",
        stamp("published").alias("published"), stamp("modified").alias("modified"), raw.alias("raw"),
    )


#: Forms of damage and odd archives, by remainder of the key.
FORMS = 24
_ENCRYPTION = '<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptedData><enc:EncryptionMethod Algorithm="{}"/><enc:CipherData><enc:CipherReference URI="{}"/></enc:CipherData></enc:EncryptedData></encryption>'


def odd_book(k: int, name: str) -> bytes:
    """A book of four sections, sound or with one thing out of order."""
    parts = [(f"Text/c{n}.xhtml", section(f"C{n}", [f"Line {n}"])) for n in range(4)]
    w = BookWriter(title=name, sections=parts, toc=[(f"C{n}", f"Text/c{n}.xhtml", 1 + (n == 1)) for n in range(4)])
    meta = lambda f, text: w.files.append((f"META-INF/{f}", text.encode()))
    match k % FORMS:
        case 1:
            w.mimetype_last = True
        case 2:
            w.mimetype_packed = True
        case 3:
            w.prefix = b"junk" * (k % 7 + 1)
        case 4:
            w.zip64 = True
        case 5:
            w.crc = {"OEBPS/Text/c2.xhtml": 7}
        case 6:
            w.crc = {"OEBPS/nav.xhtml": 7}
        case 7:
            return w.build()[:-30]
        case 8:
            meta("license.lcpl", "{}")
        case 9:
            meta("rights.xml", '<r xmlns="http://ns.adobe.com/adept"/>')
        case 10:
            meta("encryption.xml", "<r")
        case 11:
            meta("encryption.xml", _ENCRYPTION.format("aes", "OEBPS/Text/c1.xhtml"))
        case 12:
            meta("encryption.xml", _ENCRYPTION.format("odd", "OEBPS/f.otf"))
            w.extra.append(("f.otf", b"OTTO", "font/otf"))
        case 13:
            w.nav, w.ncx = False, True
        case 14:
            w.nav = False
        case 15:
            w.toc = [w.toc[1][:2] + (1,), w.toc[3]]
        case 16:
            w.items = '<item id="z" href="gone.css" media-type="text/css"/><item id="z" href="nav.xhtml" media-type="text/css"/>'
        case 17:
            w.opf = w.package().replace("</spine>", '<itemref idref="s1"/><itemref idref="none"/></spine>')
        case 18:
            w.opf = w.package().replace('href="Text/c3.xhtml"', 'href="TEXT/C3.xhtml"')
        case 19:
            w.extra = [("a.pdf", b"%PDF", "application/pdf"), ("b.djvu", b"AT&T", "image/vnd.djvu")]
            w.opf = w.package().replace('id="x0"', 'id="x0" fallback="x1"').replace("</spine>", '<itemref idref="x0" linear="NO"/></spine>')
        case 20:
            w.files.append(("OEBPS\\Text/c1.xhtml", b"again"))
        case 21:
            w.opf = "<package>"
        case 22:
            w.opf = w.package().replace('<itemref idref="s0"/>', "").replace('<itemref idref="s1"/>', "").replace('<itemref idref="s2"/>', "").replace('<itemref idref="s3"/>', "")
        case 23:
            w.opf = w.package().replace('href="Text/c0.xhtml"', 'href="../../out.xhtml"').replace('href="Text/c1.xhtml"', 'href="https://x.org/c1.xhtml"')
    return w.build()


def epub_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How books with one thing out of order read: a book for each supplier."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    b = B.read_books(_made(rows, odd_book))
    toc = F.filter("nav", lambda n: n["list"] == "toc")
    codes = F.array_join(F.array_sort(F.transform("diagnostics", lambda d: F.concat_ws(":", d["code"], d["details"]["reason"]))), " ")
    return b.select(
        F.col("book_id").cast("bigint").alias("s_suppkey"), F.col("fatal.kind").alias("fatal"), F.col("fatal.scheme").alias("scheme"), codes.alias("codes"),
        F.coalesce("delta", F.lit(0).cast("bigint")).alias("delta"), F.coalesce("zip64", F.lit(False)).alias("zip64"),
        F.array_join(F.transform("spine", lambda s: F.concat(F.regexp_extract(s["content_path"], "([^/]*)$", 1), F.when(s["linear"], "").otherwise("?"))), " ").alias("spine"),
        F.array_join(F.transform(toc, lambda n: F.concat(n["title"], F.when(n["synthesized"], "+").otherwise(""))), " ").alias("toc"),
    )


#: Declarations as they may be written. Their typed forms are in the SQL.
DECLARATIONS = [
    "margin: 1em 2px",
    "margin: -3em; padding: 9em 1em 0",
    "text-indent: -9em",
    "text-indent: 10%",
    "width: 120%; height: 2",
    "width: auto",
    "font-size: 12pt",
    "font-size: 0.9em",
    "font: italic bold 2em/1.5 'A B', serif",
    "font: 12pt inherit",
    "font-weight: 1001; font-weight: 350 !important",
    "font-style: oblique 14deg",
    "font-style: oblique 2turn",
    "text-decoration: underline red wavy",
    "text-decoration: underline red line-through",
    "list-style: inside none",
    "list-style: none none none",
    "list-style-type: foo",
    "columns: 2 10em",
    "float: LEFT",
    "display: var(--x)",
    "display: flex ! IMPORTANT",
    "DISPLAY: N\\6fne",
    "break-before: recto; page-break-after: column",
    "vertical-align: 3px; vertical-align: super",
    "font-variant: small-caps tabular-nums",
    "color: red; ; bogus; display: none",
    "text-align: justify; text-align: matrix",
]

#: Selectors as they may be written: those that match nothing that is kept have no row in the SQL.
SELECTORS = ["p", ".a.b", "#x p", "p:first-child", "a:hover", "a ~ b", "a::before", "a:bogus", "a,", "[a=b]", "[a~=b]", "[a=]", ":nth-child(3)", ":nth-child(2n+1)", "a >", "x|p", "*|p", "*", "#1a", "q > .z + #y", "@media print{p{}} i"]


def css_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed declarations of a sheet for each part: a selector and declarations by its key."""
    key = F.col("p_partkey")
    pick = lambda texts, by: F.element_at(F.array(*map(F.lit, texts)), (by % len(texts) + 1).cast("int"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(key, F.concat(pick(SELECTORS, F.floor(key / len(DECLARATIONS))), F.lit("{"), pick(DECLARATIONS, key), F.lit("}")).alias("css"))
    distinct = parts.groupBy("css").agg(F.min("p_partkey").alias("key"))
    rules = cascade.sheet_rules(distinct.select("key", "css")).join(distinct, "key")
    return parts.join(rules, "css").select("p_partkey", "property", F.regexp_replace("value", r"\.0$", "").alias("value"), "important", "bucket", "specificity")


def styled_page(k: int) -> str:
    """A page whose elements p, li and q are styled by rules of every kind that can win over another."""
    return (
        "<html><head><style>"
        "p{margin-top:1em;text-indent:2em}.a{margin-top:2em}#i{margin-top:3em!important}p#i{margin-top:4em}"
        f"div > p{{padding-left:1em}}section p{{text-indent:{k % 4}em}}h2 + p{{font-weight:bold}}"
        "p:first-child{font-style:italic}p:last-child{text-decoration:underline}li:nth-child(2){list-style-type:square}"
        f"[title=x]{{display:inline}}.u{{margin:0 0 0 {k % 3}em}}p.b{{font-size:120%}}"
        "@media print{p{display:none}}@media screen{q{display:block}}.a:hover{display:none}p:bogus,p{display:none}"
        "i.none q{display:none}"
        "</style></head><body>"
        f'<div><p id="i" style="margin-top:5em">one</p></div><section><h2>head</h2><p class="a">two</p><p class="a b" style="margin-top:{k % 9}em">three</p></section>'
        '<ul><li>1</li><li>2</li><li title="x"><ul><li>4</li></ul></li></ul>'
        '<p class="u" dir="rtl" style="text-align:left">four</p><p hidden>five</p><q>six</q><b><q style="font-weight:lighter">seven</q></b>'
        f'<p style="{"margin-top:7em;" * (k % 2)}all:initial;display:block">eight</p></body></html>'
    )


def css_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed styles of a page for each supplier, by element in document order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "html": [styled_page(int(k)) for k in pdf["key"]]})

    pages = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key")).mapInPandas(run, "key long, html string")
    s = cascade.computed_styles(pages).where("tag in ('p', 'li', 'q')")
    return s.select(F.col("key").alias("s_suppkey"), "eid", "tag", "display", "margin_top", "margin_left", "padding_left", "text_indent", "bold", "font_style", "font_size", "list_style_type", "underline", "text_align", F.col("origins")["margin-top"].alias("origin"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (epub_metadata, epub_odd, css_declared, css_cascade)}
ORACLES: dict[str, str] = {
    "epub_metadata": """
SELECT k AS c_custkey, CASE WHEN k % 3 = 1 THEN 'Main ' || k ELSE c_name END AS title, CASE WHEN k % 3 = 2 THEN 'Sub ' || k END AS subtitle,
  CASE WHEN k % 2 = 1 THEN 'pt-BR' ELSE 'en' END AS language, 'House & Co' AS publisher,
  CASE WHEN k % 4 < 2 THEN 'First ' || k || '|' ELSE '' END || 'Second ' || k AS authors, CASE WHEN k % 4 < 2 THEN '' ELSE 'First ' || k || '|' END || 'Helper' AS contributors,
  's' || (k % 5) || '|all' AS subjects, 'urn:sha1:' || sha1(c_name) || '|isbn:' || k AS identifiers,
  CASE WHEN k % 5 IN (0, 2) THEN 'Own' WHEN k % 5 < 4 THEN 'Other' END AS series, CASE WHEN k % 5 IN (0, 2) THEN 2.5 WHEN k % 5 = 1 THEN 7 END::DOUBLE AS series_index,
  CASE WHEN k % 7 = 0 THEN 'pre-paginated' ELSE 'reflowable' END AS layout, ['auto', 'rtl', 'ltr'][k % 3 + 1] AS direction,
  'OEBPS/img/' || ['a.png', 'b.png', 'b.png', 'COVER.png', 'recover.png', NULL][k % 6 + 1] AS cover_path,
  CASE k % 4 WHEN 0 THEN epoch_ms(TIMESTAMP '1999-12-01') WHEN 1 THEN epoch_ms(TIMESTAMP '2004-03-01 00:30:00') END AS published,
  CASE WHEN k % 8 < 2 THEN epoch_ms(TIMESTAMP '2020-05-06 07:08:09') WHEN k % 8 = 4 THEN epoch_ms(TIMESTAMP '2001-02-03') END AS modified,
  CASE WHEN k % 5 = 1 THEN 'belongs-to-collection=Own;collection-type=set;' ELSE '' END || CASE WHEN k % 8 = 0 THEN 'date=2001-02-03;' WHEN k % 4 = 1 THEN 'date=1990;' ELSE '' END ||
  CASE WHEN k % 5 = 1 THEN 'group-position=2.5;' ELSE '' END || 'identifier=isbn:' || k || ';n=o;source=src' || k || ';' || CASE WHEN k % 3 = 1 THEN 'title=' || c_name || ';' ELSE '' END || 'x:y=v' || (k % 9) || ',w' AS raw
FROM (SELECT c_custkey AS k, c_name FROM customer)
""",
    "epub_odd": f"""
WITH form(f, fatal, scheme, codes, spine, toc) AS (VALUES
  (1, NULL, NULL, 'mimetypeIrregular:notFirst', NULL, NULL), (2, NULL, NULL, 'mimetypeIrregular:compressed', NULL, NULL), (3, NULL, NULL, 'mimetypeIrregular:prefix', NULL, NULL),
  (6, NULL, NULL, 'zipCrcMismatch:crc', NULL, NULL), (7, 'container', NULL, '', NULL, NULL), (8, 'encrypted', 'lcp', '', NULL, NULL), (9, 'encrypted', 'adobe-adept', '', NULL, NULL),
  (10, 'encrypted', 'unknown:encryption.xml-invalido', '', NULL, NULL), (11, 'encrypted', 'unknown:aes', '', NULL, NULL), (12, NULL, NULL, 'fontObfuscationUnknown', NULL, NULL),
  (14, NULL, NULL, 'tocReconciled', NULL, 'c0+ c1+ c2+ c3+'), (15, NULL, NULL, 'tocReconciled', NULL, 'c0+ C1 c2+ C3'), (16, NULL, NULL, 'resourceMissing', NULL, NULL),
  (17, NULL, NULL, 'spineItemDuplicate spineItemUnresolved', NULL, NULL), (18, NULL, NULL, '', 'c0.xhtml c1.xhtml c2.xhtml C3.xhtml', NULL), (19, NULL, NULL, '', 'c0.xhtml c1.xhtml c2.xhtml c3.xhtml b.djvu?', NULL),
  (20, NULL, NULL, 'zipDuplicateEntry', NULL, NULL), (21, 'package', NULL, '', NULL, NULL), (22, 'package', NULL, '', NULL, NULL), (23, NULL, NULL, 'resourceMissing resourceMissing:remote', 'out.xhtml c1.xhtml c2.xhtml c3.xhtml', NULL)
)
SELECT s_suppkey, fatal, scheme, coalesce(codes, '') AS codes, CASE WHEN s_suppkey % {FORMS} = 3 THEN 4 * (s_suppkey % 7 + 1) ELSE 0 END::BIGINT AS delta, s_suppkey % {FORMS} = 4 AS zip64,
  CASE WHEN fatal IS NULL THEN coalesce(spine, 'c0.xhtml c1.xhtml c2.xhtml c3.xhtml') ELSE '' END AS spine, CASE WHEN fatal IS NULL THEN coalesce(toc, 'C0 C1 C2 C3') ELSE '' END AS toc
FROM supplier LEFT JOIN form ON f = s_suppkey % {FORMS}
""",
    "css_declared": f"""
WITH d(i, property, value, important) AS (VALUES
  (0, 'margin-top', 'em 1', false), (0, 'margin-right', 'em 0.125', false), (0, 'margin-bottom', 'em 1', false), (0, 'margin-left', 'em 0.125', false),
  (1, 'margin-top', 'em 0', false), (1, 'margin-right', 'em 0', false), (1, 'margin-bottom', 'em 0', false), (1, 'margin-left', 'em 0', false),
  (1, 'padding-top', 'em 8', false), (1, 'padding-right', 'em 1', false), (1, 'padding-bottom', 'em 0', false), (1, 'padding-left', 'em 1', false),
  (2, 'text-indent', 'em -4', false), (3, 'text-indent', 'em 3', false), (4, 'width', 'percent 100', false), (5, 'width', 'auto', false), (7, 'font-size', 'step smaller', false),
  (8, 'font-size', 'step larger', false), (8, 'font-style', 'keyword italic', false), (8, 'font-variant', 'keyword normal', false), (8, 'font-weight', 'weight 700', false),
  (10, 'font-weight', 'weight 350', true), (11, 'font-style', 'keyword italic', false), (13, 'text-decoration', 'decoration True False', false), (15, 'list-style-type', 'keyword none', false),
  (17, 'list-style-type', 'unknown-list', false), (18, 'column-count', 'degraded True 2', false), (18, 'column-width', 'degraded True 10em', false), (19, 'float', 'degraded True left', false),
  (21, 'display', 'keyword block', true), (22, 'display', 'keyword none', false), (23, 'break-before', 'keyword page', false), (24, 'vertical-align', 'keyword baseline', false),
  (24, 'vertical-align', 'keyword super', false), (25, 'font-variant', 'keyword small-caps', false), (26, 'display', 'keyword none', false), (27, 'text-align', 'keyword start', false)
), s(j, bucket, ids, classes, tags) AS (VALUES
  (0, 'tag:p', 0, 0, 1), (1, 'class:a', 0, 2, 0), (2, 'tag:p', 1, 0, 1), (3, 'tag:p', 0, 1, 1), (9, 'any:', 0, 1, 0), (12, 'any:', 0, 1, 0), (16, 'tag:p', 0, 0, 1), (17, 'any:', 0, 0, 0), (19, 'id:y', 1, 1, 1), (20, 'tag:i', 0, 0, 1)
)
SELECT p_partkey, property, value, important, bucket, (ids * 1048576 + classes * 1024 + tags)::BIGINT AS specificity
FROM part JOIN d ON i = p_partkey % {len(DECLARATIONS)} JOIN s ON j = p_partkey // {len(DECLARATIONS)} % {len(SELECTORS)}
""",
    "css_cascade": """
WITH e(eid, tag, display, margin_top, margin_left, padding_left, text_indent, bold, font_style, font_size, list_style_type, underline, text_align, origin) AS (VALUES
  (5, 'p', 'block', 3, 0, 1, 2, false, 'italic', 'same', 'disc', true, 'start', 'author'),
  (8, 'p', 'block', 2, 0, 0, NULL, true, 'normal', 'same', 'disc', false, 'start', 'author'),
  (9, 'p', 'block', NULL, 0, 0, NULL, false, 'normal', 'larger', 'disc', true, 'start', 'styleAttribute'),
  (11, 'li', 'list-item', 0, 0, 0, 0, false, 'normal', 'same', 'disc', false, 'start', NULL),
  (12, 'li', 'list-item', 0, 0, 0, 0, false, 'normal', 'same', 'square', false, 'start', NULL),
  (13, 'li', 'inline', 0, 0, 0, 0, false, 'normal', 'same', 'disc', false, 'start', NULL),
  (15, 'li', 'list-item', 0, 0, 0, 0, false, 'normal', 'same', 'circle', false, 'start', NULL),
  (16, 'p', 'block', 0, NULL, 0, 2, false, 'normal', 'same', 'disc', false, 'end', 'author'),
  (17, 'p', 'none', 1, 0, 0, 2, false, 'normal', 'same', 'disc', false, 'start', 'author'),
  (18, 'q', 'block', 0, 0, 0, 0, false, 'normal', 'same', 'disc', false, 'start', NULL),
  (20, 'q', 'block', 0, 0, 0, 0, false, 'normal', 'same', 'disc', false, 'start', NULL),
  (21, 'p', 'block', 0, 0, 0, 0, false, 'normal', 'same', 'disc', false, 'start', 'styleAttribute')
)
SELECT s_suppkey, eid, tag, display, coalesce(margin_top, s_suppkey % 9)::DOUBLE AS margin_top, coalesce(margin_left, s_suppkey % 3)::DOUBLE AS margin_left, padding_left::DOUBLE AS padding_left,
  coalesce(text_indent, s_suppkey % 4)::DOUBLE AS text_indent, bold, font_style, font_size, list_style_type, underline, text_align, origin
FROM supplier CROSS JOIN e
""",
}
