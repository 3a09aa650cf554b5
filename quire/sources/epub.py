"""Writing packaged books: fixtures and books made from tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from html import escape


def zip_bytes(files: list[tuple[str, bytes]], stored: set[str] = frozenset({"mimetype"}), crc: dict[str, int] | None = None, zip64: bool = False, prefix: bytes = b"") -> bytes:
    """An archive with fixed dates; crc overrides what is written as checksum, zip64 writes the 64-bit records."""
    out, directory = bytearray(), bytearray()
    for name, data in files:
        raw, method = name.encode(), 0 if name in stored else 8
        packed = data if method == 0 else (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(data) + c.flush()
        check = (crc or {}).get(name, zlib.crc32(data))
        at = len(out)
        common = struct.pack("<5H3I2H", 20, 0x800, method, 0, 0x21, check, len(packed), len(data), len(raw), 0)
        out += b"PK\3\4" + common + raw + packed
        extra = struct.pack("<2HQ", 1, 8, at) if zip64 else b""
        directory += b"PK\1\2" + struct.pack("<H", 20) + common[:-2] + struct.pack("<4H2I", len(extra), 0, 0, 0, 0, 0xFFFFFFFF if zip64 else at) + raw + extra
    start, size, n = len(out), len(directory), len(files)
    out += directory
    if zip64:
        end = len(out)
        out += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, size, start, 0)
    return prefix + bytes(out)


CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{}" media-type="application/oebps-package+xml"/></rootfiles></container>'


@dataclass
class BookWriter:
    """A book of XHTML sections; what isn't set is as a plain, valid book has it."""

    title: str = "Book"
    language: str = "en"
    sections: list[tuple[str, str]] = field(default_factory=list)
    toc: list[tuple[str, str, int]] = field(default_factory=list)
    extra: list[tuple[str, bytes, str]] = field(default_factory=list)
    files: list[tuple[str, bytes]] = field(default_factory=list)
    metadata: str = ""
    items: str = ""
    opf: str | None = None
    ncx: bool = False
    nav: bool = True
    mimetype_last: bool = False
    mimetype_packed: bool = False
    crc: dict[str, int] = field(default_factory=dict)
    zip64: bool = False
    prefix: bytes = b""

    def nav_text(self) -> str:
        out, depth = ['<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc">'], 0
        for title, ref, level in self.toc:
            if level > depth:
                out.append("<ol>")
            else:
                out.append("</li>" + "</ol></li>" * (depth - level))
            out.append(f'<li><a href="{escape(ref)}">{escape(title)}</a>')
            depth = level
        return "".join(out) + "</li></ol>" * depth + "</nav></body></html>"

    def ncx_text(self) -> str:
        points = "".join(f'<navPoint><navLabel><text>{escape(t)}</text></navLabel><content src="{escape(r)}"/></navPoint>' for t, r, _ in self.toc)
        return f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>'

    def package(self) -> str:
        ident = hashlib.sha1(self.title.encode()).hexdigest()
        items = [f'<item id="s{k}" href="{escape(p)}" media-type="application/xhtml+xml"/>' for k, (p, _) in enumerate(self.sections)]
        items += [f'<item id="x{k}" href="{escape(p)}" media-type="{m}"/>' for k, (p, _, m) in enumerate(self.extra)]
        items += ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'] * self.nav
        items += ['<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'] * self.ncx
        refs = "".join(f'<itemref idref="s{k}"/>' for k in range(len(self.sections)))
        toc = ' toc="ncx"' if self.ncx else ""
        return (
            '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">'
            f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:sha1:{ident}</dc:identifier><dc:title>{escape(self.title)}</dc:title><dc:language>{self.language}</dc:language>{self.metadata}</metadata>'
            f"<manifest>{''.join(items)}{self.items}</manifest><spine{toc}>{refs}</spine></package>"
        )

    def build(self) -> bytes:
        kind = [("mimetype", b"application/epub+zip")]
        files = [("META-INF/container.xml", CONTAINER.format("OEBPS/content.opf").encode()), *self.files]
        files.append(("OEBPS/content.opf", (self.opf if self.opf is not None else self.package()).encode()))
        files += [("OEBPS/nav.xhtml", self.nav_text().encode())] * self.nav
        files += [("OEBPS/toc.ncx", self.ncx_text().encode())] * self.ncx
        files += [(f"OEBPS/{p}", t.encode()) for p, t in self.sections]
        files += [(f"OEBPS/{p}", b) for p, b, _ in self.extra]
        files = files + kind if self.mimetype_last else kind + files
        return zip_bytes(files, set() if self.mimetype_packed else {"mimetype"}, self.crc, self.zip64, self.prefix)


def section(title: str, paragraphs: list[str], head: str = "") -> str:
    body = "".join(f"<p>{escape(p, quote=False)}</p>" for p in paragraphs)
    return f'<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="utf-8"/><title>{escape(title)}</title>{head}</head><body>{body}</body></html>'
