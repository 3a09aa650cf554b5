import hashlib
import random
import struct
import zlib

import pyarrow as pa
import pytest

from quire.plans import cases
from quire.sources import books as B
from quire.sources import xmldoc as X
from quire.sources.epub import BookWriter, section, zip_bytes
from quire.sources.htmltree import blocks, navigation, parse_html
from quire.sources.package import Reader
from quire.sources.zipdir import Fatal, mark_overlaps, read_directory, read_entry

PARAGRAPHS = ["Hello <world> & all.", "Second line."]
ENC = '<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptedData><enc:EncryptionMethod Algorithm="{}"/><enc:CipherData><enc:CipherReference URI="{}"/></enc:CipherData></enc:EncryptedData></encryption>'


def book(**kw):
    w = BookWriter(sections=[(f"Text/c{k}.xhtml", section(f"C{k}", PARAGRAPHS)) for k in range(1, 7)], toc=[(f"C{k}", f"Text/c{k}.xhtml", 1) for k in range(1, 7)])
    for k, v in kw.items():
        setattr(w, k, v)
    return w.build()


def codes(data):
    b = Reader(data).read()
    return sorted({d["code"] for d in b.diagnostics}), b.fatal and (b.fatal["kind"], b.fatal["scheme"])


FONT = b"OTTO" + bytes(range(256)) * 8
CASES = {
    "plain": (book(), [], None),
    "zip64": (book(zip64=True), [], None),
    "prefix": (book(prefix=b"junk" * 9), ["mimetypeIrregular"], None),
    "mimetype-last": (book(mimetype_last=True), ["mimetypeIrregular"], None),
    "mimetype-packed": (book(mimetype_packed=True), ["mimetypeIrregular"], None),
    "cut": (book()[:900], [], ("container", None)),
    "empty": (b"", [], ("container", None)),
    "bad-crc-nav": (book(crc={"OEBPS/nav.xhtml": 1}), ["zipCrcMismatch"], None),
    "no-spine": (book(opf='<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest/><spine/></package>'), [], ("package", None)),
    "not-xml": (book(opf="<package>"), [], ("package", None)),
    "lcp": (book(files=[("META-INF/license.lcpl", b"{}")]), [], ("encrypted", "lcp")),
    "rights": (book(files=[("META-INF/rights.xml", b'<r xmlns="http://ns.adobe.com/adept"/>')]), [], ("encrypted", "adobe-adept")),
    "rights-bad": (book(files=[("META-INF/rights.xml", b"<r")]), [], ("encrypted", "unknown:rights.xml")),
    "encryption-bad": (book(files=[("META-INF/encryption.xml", b"<r")]), [], ("encrypted", "unknown:encryption.xml-invalido")),
    "aes": (book(files=[("META-INF/encryption.xml", ENC.format("aes", "OEBPS/Text/c1.xhtml").encode())]), [], ("encrypted", "unknown:aes")),
    "odd-font": (book(files=[("META-INF/encryption.xml", ENC.format("odd", "OEBPS/f.otf").encode())], extra=[("f.otf", FONT, "font/otf")]), ["fontObfuscationUnknown"], None),
    "font-on-content": (book(files=[("META-INF/encryption.xml", ENC.format(X.IDPF, "OEBPS/f.otf").encode())], extra=[("f.otf", FONT, "text/css")]), [], ("encrypted", "unknown:obfuscation-on-content")),
    "orphans": (book(toc=[(f"C{k}", f"Text/c{k}.xhtml", 1) for k in (1, 3, 5)]), ["tocReconciled"], None),
    "ncx-only": (book(nav=False, ncx=True), [], None),
    "no-nav": (book(nav=False), ["tocReconciled"], None),
    "missing-item": (book(items='<item id="z" href="gone.css" media-type="text/css"/>'), ["resourceMissing"], None),
    "case": (book(items='<item id="z" href="TEXT/C1.xhtml" media-type="text/css"/>'), [], None),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    data, want, fatal = CASES[name]
    assert codes(data) == (want, fatal)


def test_orphans_come_back_in_place():
    b = Reader(CASES["orphans"][0]).read()
    assert [(n["title"], n["synthesized"]) for n in b.nav if n["list"] == "toc"] == [("C1", False), ("c2", True), ("C3", False), ("c4", True), ("C5", False), ("c6", True)]


def test_deep_toc_keeps_parents():
    b = Reader(book(toc=[("A", "Text/c1.xhtml", 1), ("B", "Text/c2.xhtml", 2), ("C", "Text/c3.xhtml", 3), ("D", "Text/c4.xhtml", 2), ("E", "Text/c5.xhtml", 1), ("F", "Text/c6.xhtml#x", 2)])).read()
    assert [(n["title"], n["parent_id"], n["root_ord"], n["fragment"]) for n in b.nav] == [("A", None, 0, None), ("B", 0, 0, None), ("C", 1, 0, None), ("D", 0, 0, None), ("E", None, 1, None), ("F", 4, 1, "x")]


def test_metadata(spark):
    meta = (
        '<dc:title id="t2">Sub</dc:title><meta refines="#t2" property="title-type">subtitle</meta><dc:creator id="c" role="aut">Ann</dc:creator><dc:creator id="d">Bob</dc:creator><meta refines="#d" property="role">ill</meta>'
        '<dc:date>2001-02-03T04:05:06+02:00</dc:date><meta property="dcterms:modified">2010-13-01</meta><meta name="calibre:series" content="S"/><meta name="calibre:series_index" content="1.5"/><dc:subject>x</dc:subject><dc:subject>y</dc:subject><dc:source>src</dc:source>'
    )
    df = spark.createDataFrame([("a", bytearray(book(metadata=meta))), ("bad", bytearray(b"x")), ("null", None)], "book_id string, content binary")
    read = B.read_books(df)
    m = B.metadata(read).collect()
    assert len(m) == 1
    r = m[0]
    assert (r.title, r.subtitle, r.authors, r.contributors, r.series, r.series_index, r.subjects) == ("Book", "Sub", ["Ann"], ["Bob"], "S", 1.5, ["x", "y"])
    assert r.published is not None and r.modified is None and r.raw["source"] == ["src"]
    assert {x.book_id: x.kind for x in read.select("book_id", "fatal.kind").collect()} == {"a": None, "bad": "container", "null": "container"}
    assert B.exploded(read, "spine").count() == 6 and B.exploded(read, "manifest").count() == 7 and B.exploded(read, "entries").count() == 10


def test_blocks_resources_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(book())), ("b", bytearray(book(crc={"OEBPS/Text/c1.xhtml": 7})))], "book_id string, content binary")
    got = B.read_blocks(df).where("pos = 0 and book_id = 'a'").orderBy("ord").collect()
    assert [(r.tag, r.text) for r in got] == [("p", "Hello <world> & all."), ("p", "Second line.")]
    bad = B.read_resources(df).where("not crc_ok").collect()
    assert [(r.book_id, r.path, r.problem) for r in bad] == [("b", "OEBPS/Text/c1.xhtml", "crc")]
    B.write_tables({"spine": B.exploded(B.read_books(df), "spine")}, str(tmp_path))
    B.write_tables({"spine": B.exploded(B.read_books(df.where("book_id = 'a'")), "spine")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/spine").count() == 12
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "x.epub").write_bytes(book())
    assert B.read_books(B.read_files(spark, str(tmp_path / "lib"))).where("fatal is null").count() == 1


def test_fonts(spark):
    key = hashlib.sha1(("urn:sha1:" + hashlib.sha1(b"Book").hexdigest()).encode()).digest()
    hidden = bytes(a ^ key[i % 20] if i < 1040 else a for i, a in enumerate(FONT))
    data = book(files=[("META-INF/encryption.xml", ENC.format(X.IDPF, "OEBPS/f.otf").encode())], extra=[("f.otf", hidden, "font/otf")])
    r = B.clear_fonts(spark.createDataFrame([("a", bytearray(data))], "book_id string, content binary")).collect()
    assert len(r) == 1 and bytes(r[0].bytes) == FONT and r[0].is_font
    uuid = "urn:uuid:00010203-0405-0607-0809-0a0b0c0d0e0f"
    assert X.clear_font(X.clear_font(FONT, "adobe", [], [uuid]), "adobe", [], ["x", uuid]) == FONT
    assert X.clear_font(FONT, "idpf", [" \n"], []) is None and X.clear_font(FONT, "adobe", [], ["no"]) is None


def test_strict():
    assert Reader(book(mimetype_last=True), strict=True).read().fatal["message"] == "mimetypeIrregular"
    assert Reader(book(), strict=True).read().fatal is None


def test_overlaps_are_greedy():
    d = read_directory(zip_bytes([(f"f{k}", b"x" * 100) for k in range(4)], stored={f"f{k}" for k in range(4)}))
    from dataclasses import replace

    e = [replace(x, lho=at, csize=size) for x, at, size in zip(d.entries, (0, 50, 200, 135), (70, 500, 10, 10), strict=True)]
    assert [x.invalid for x in mark_overlaps(e)] == [None, "overlap", None, None]


def test_bomb_is_stopped():
    data = bytearray(zip_bytes([("a", b"\0" * 1_000_000)]))
    at = data.rfind(b"PK\1\2")
    data[at + 24 : at + 28] = struct.pack("<I", 10)
    with pytest.raises(Fatal):
        read_entry(bytes(data), read_directory(bytes(data)).entries[0])


def test_random_damage_never_escapes():
    rng = random.Random(1)
    base = book(ncx=True, files=[("META-INF/encryption.xml", ENC.format(X.IDPF, "OEBPS/f.otf").encode())], extra=[("f.otf", FONT, "font/otf")])
    for _ in range(300):
        data = bytearray(base)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        Reader(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])])).read()


def test_xml():
    root = X.parse_xml('<!DOCTYPE r [<!ENTITY big "boom">]><r xmlns:a="u" a:k="v"><a:b>x<![CDATA[<y>]]></a:b>&nbsp;&big;</r>')
    assert root.attrs == {"k": "v"} and root.child("b").ns == "u" and root.child("b").text == "x<y>"
    assert "boom" not in root.text
    with pytest.raises(X.XmlError):
        X.parse_xml("<a><b></a>")
    deep = X.parse_xml("<a>" * 20_000 + "</a>" * 20_000)
    assert sum(1 for _ in deep.walk()) == 19_999
    assert X.cipher_reference("a%20b") == "a b" and X.cipher_reference("a%E9") == "a%E9" and X.cipher_reference("a%2") == "a%2"


@pytest.mark.parametrize(
    ("data", "text", "wrong"),
    [(b"\xef\xbb\xbf\xc3\xa9", "é", False), (b"\xff\xfea\0", "a", False), ('<?xml version="1.0" encoding="ISO-8859-1"?>é'.encode("latin-1"), '<?xml version="1.0" encoding="ISO-8859-1"?>é', False), (b"caf\xe9", "café", True), (b"", "", False)],
)
def test_encodings(data, text, wrong):
    got, problem = X.decode_markup(data)
    assert got == text and (problem is not None) == wrong


def test_html():
    tree = parse_html("<p>one<p>two <b>x</b><ul><li>a<li>b<ul><li>c</ul></ul><pre> k\n l</pre><table><tr><td>1<td>2</table><script>'</p>'</script>&eacute;")
    assert blocks(tree) == [("p", "one"), ("p", "two x"), ("li", "a"), ("li", "c"), ("pre", " k\n l"), ("td", "1"), ("td", "2")]
    assert blocks(parse_html("<div>" * 30_000 + "<p>deep")) == [("p", "deep")]
    nav, cut = navigation('<nav epub:type="toc x"><h1>t</h1><ol><li><a href="a"> A <b>b</b></a><ol><li><span><img alt="pic"></span></li></ol></li></ol></nav><nav epub:type="toc"><ol><li><a href="z">z</a></ol></nav>')
    assert [(e["depth"], e["title"], e["href"]) for e in nav["toc"]] == [(1, "A b", "a"), (2, "pic", None)] and not cut
    deep = "<ol><li><a href='a'>x</a>" * 70
    assert navigation(f'<nav epub:type="toc">{deep}</nav>')[1]


def test_references_without_semicolon():
    html = "<h1>a &amp; b &lt;&#x27;&notit; &eacute;&amp</h1><p>&#x2</p>"
    assert blocks(parse_html(html)) == [("h1", "a & b <'\u00acit; \u00e9&")]
    assert blocks(parse_html(html, lenient=False)) == [("h1", "a & b <'&notit; \u00e9&amp"), ("p", "&#x2")]


def test_many_books_are_dealt_out_and_leave_in_batches(spark):
    rows = spark.range(400).selectExpr("id as key", "'n' as name").coalesce(1)
    assert cases._made(rows, cases.described_book).rdd.getNumPartitions() == 4
    run = B._rows(lambda k: [{"k": k, "b": b"x" * (k % 7)}], "k bigint, b binary")
    given = [pa.RecordBatch.from_pydict({"k": list(range(i, i + 150))}) for i in (0, 150, 300)]
    out = list(run(iter(given)))
    assert [b.num_rows for b in out] == [200, 200, 50] and [k for b in out for k in b["k"].to_pylist()] == list(range(450))
    large = B._rows(lambda k: [{"k": k, "b": b"x" * B.BATCH_BYTES}], "k bigint, b binary")
    assert [b.num_rows for b in large(iter(given[:1]))] == [1] * 150


def test_crc_is_zlib():
    assert zlib.crc32(b"123456789") == 3421780262


def test_provided(spark):
    data = book(toc=[("C1", "Text/c1.xhtml", 1)])
    d = read_directory(data)
    files = {e.name: read_entry(data, e)[0] for e in d.entries}
    files["META-INF/encryption.xml"] = b"<broken"
    rows = [("p", k, bytearray(v)) for k, v in files.items()] + [("q", "x", None), ("p", None, None)]
    read = B.read_provided(spark.createDataFrame(rows, "book_id string, href string, bytes binary"))
    got = {r.book_id: r for r in read.collect()}
    assert got["p"].fatal is None and len(got["p"].spine) == 6 and {x.code for x in got["p"].diagnostics} == {"encryptionIgnored", "tocReconciled"}
    assert got["q"].fatal.kind == "container"


def test_places_and_links(spark):
    from quire.operators import locator

    one = section("1", []).replace("<body>", '<body><h1 id="t">Title</h1><p>See <a epub:type="noteref" href="b.xhtml#n1">1</a> and <a href="#t">up</a>, <a href="b.xhtml#gone">x</a> <a href="http://x/">y</a></p><span epub:type="pagebreak" title="7"></span><p>end</p>')
    two = section("2", []).replace("<body>", '<body><p>first</p><aside id="n1"><p>The note.</p></aside>')
    w = BookWriter(sections=[("a.xhtml", one), ("b.xhtml", two)], toc=[("A", "a.xhtml", 1), ("B", "b.xhtml", 1)])
    df = spark.createDataFrame([("k", bytearray(w.build()))], "book_id string, content binary")
    places = B.read_places(df)
    assert [(r.name, r.at) for r in places.where("kind = 'pagebreak'").collect()] == [("7", 24)]
    blocks = locator.block_offsets(B.read_blocks(df), ["book_id", "path"])
    links = locator.resolve_links(places, B.read_blocks(df).select("book_id", "path"))
    got = {(r.name, r.kind, r.at): (r.to_path, r.to_at, r.found) for r in links.collect()}
    assert got == {("1", "noteref", 10): ("OEBPS/b.xhtml", 6, True), ("up", "link", 16): ("OEBPS/a.xhtml", 0, True), ("x", "link", 20): ("OEBPS/b.xhtml", 0, False)}
    assert [r.note for r in locator.note_texts(links, blocks).collect()] == ["The note."]
