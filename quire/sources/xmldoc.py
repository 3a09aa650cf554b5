"""Small XML trees by expat, without entity expansion; the XML files of a container."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes
from xml.parsers import expat

from quire.functions.text import trim
from quire.sources.zipdir import Fatal, entry_name

#: Names that the formats fix.
OPF_MEDIA_TYPE = "application/oebps-package+xml"
ADEPT = "http://ns.adobe.com/adept"
LCP_KEY = "http://readium.org/2014/01/lcp#EncryptedContentKey"
XMLENC = "http://www.w3.org/2001/04/xmlenc#"
IDPF = "http://www.idpf.org/2008/embedding"
ADOBE = "http://ns.adobe.com/pdf/enc#RC"
FONT_SUFFIXES = (".ttf", ".otf", ".ttc", ".otc", ".woff", ".woff2")
FONT_MAGIC = {"00010000", "4F54544F", "74727565", "74746366", "774F4646", "774F4632"}


class XmlError(ValueError):
    pass


@dataclass
class Node:
    """An element: names without prefix, attributes by local name, texts and children in order."""

    ns: str
    local: str
    prefix: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)

    def elements(self, local: str | None = None) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node) and local in (None, c.local))

    def child(self, local: str) -> Node | None:
        return next(self.elements(local), None)

    def walk(self) -> Iterator[Node]:
        """Descendants in document order, however deep."""
        stack = [self.elements()]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            else:
                yield node
                stack.append(node.elements())

    def attr(self, local: str) -> str | None:
        value = self.attrs.get(local)
        return None if value is None else trim(value)

    @property
    def text(self) -> str:
        """Its own text, without that of its children."""
        return trim("".join(c for c in self.children if isinstance(c, str)))


def parse_xml(text: str) -> Node:
    """The root element. Entities that a document declares are never expanded; unknown ones stay as written."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.namespace_prefixes = True
    parser.buffer_text = True
    parser.UseForeignDTD(True)
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    root: list[Node] = []
    stack: list[Node] = []

    def split(name: str) -> tuple[str, str, str]:
        parts = name.split(" ")
        return (parts[0], parts[1], parts[2] if len(parts) > 2 else "") if len(parts) > 1 else ("", name, "")

    def start(name: str, attrs: dict[str, str]) -> None:
        ns, local, prefix = split(name)
        node = Node(ns, local, prefix, {})
        for k, v in attrs.items():
            node.attrs.setdefault(split(k)[1], v)
        (stack[-1].children if stack else root).append(node)
        stack.append(node)

    def add(data: str) -> None:
        if stack:
            stack[-1].children.append(data)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: stack.pop()
    parser.CharacterDataHandler = add
    parser.SkippedEntityHandler = lambda name, is_parameter: add(f"&{name};") if not is_parameter else None
    parser.EntityDeclHandler = lambda *a: None
    parser.DefaultHandler = lambda data: add(data) if data.startswith("&") and data.endswith(";") else None
    parser.ExternalEntityRefHandler = lambda *a: 1
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", text.lstrip("﻿")).encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeEncodeError) as error:
        raise XmlError(str(error)) from error
    return root[0]


def rootfiles(text: str) -> list[str]:
    """Paths of package documents that container.xml names, in order."""
    try:
        root = parse_xml(text)
    except XmlError as error:
        raise Fatal("container", "container.xml is not XML", href="META-INF/container.xml") from error
    found = [n for n in (root, *root.walk()) if n.local == "rootfile" and (n.attr("media-type") or "").lower() == OPF_MEDIA_TYPE]
    paths = [p for n in found if (p := n.attr("full-path"))]
    if not paths:
        raise Fatal("container", "container.xml names no package document", href="META-INF/container.xml")
    return paths


@dataclass(frozen=True)
class Encrypted:
    algorithm: str
    uri: str
    lcp: bool
    adept: bool


def _names_adept(info: Node) -> bool:
    stack = [info]
    while stack:
        node = stack.pop()
        if node.ns == ADEPT:
            return True
        stack += [c for c in node.elements() if node is info or node.local != "EncryptedData"]
    return False


def cipher_reference(uri: str) -> str:
    """A reference with escapes undone, or as it is if they are malformed; then a name as the directory has it."""
    try:
        if re.search("%(?![0-9A-Fa-f]{2})", uri):
            raise UnicodeDecodeError("utf-8", b"", 0, 1, "escape")
        return entry_name(unquote_to_bytes(uri).decode("utf-8"))
    except UnicodeDecodeError:
        return entry_name(uri)


def encrypted_items(text: str) -> list[Encrypted]:
    """Resources that encryption.xml says are encrypted. XmlError if it isn't XML."""
    root = parse_xml(text)
    out = []
    for data in (root, *root.walk()):
        cipher = data.child("CipherData") if data.local == "EncryptedData" else None
        reference = cipher.child("CipherReference") if cipher else None
        if reference is None or "URI" not in reference.attrs:
            continue
        method = data.child("EncryptionMethod")
        infos = list(data.elements("KeyInfo"))
        lcp = any(r.attrs.get("Type") == LCP_KEY for i in infos for r in i.elements("RetrievalMethod"))
        out.append(Encrypted(method.attrs.get("Algorithm", "") if method else "", cipher_reference(reference.attrs["URI"]), lcp, any(map(_names_adept, infos))))
    return out


def rights_scheme(text: str) -> str:
    try:
        root = parse_xml(text)
    except XmlError:
        return "unknown:rights.xml"
    return "adobe-adept" if any(n.ns == ADEPT for n in (root, *root.walk())) else "unknown:rights.xml"


def is_font_path(path: str) -> bool:
    return path.lower().endswith(FONT_SUFFIXES)


def is_font_media(media: str) -> bool:
    return media.startswith(("font/", "application/font-", "application/x-font-")) or media in ("application/vnd.ms-opentype", "application/octet-stream")


def obfuscation(algorithm: str) -> str:
    return {IDPF: "idpf", ADOBE: "adobe"}.get(algorithm, "unknown")


def clear_font(data: bytes, kind: str, unique: list[str], identifiers: list[str]) -> bytes | None:
    """An obfuscated font made plain by the book's identifiers; None if they give no key."""
    if kind == "idpf":
        joined = re.sub("[ \t\r\n]", "", "".join(unique))
        key, length = (hashlib.sha1(joined.encode()).digest(), 1040) if joined else (b"", 0)
    else:
        plain = (re.sub("^urn:uuid:", "", trim(i), flags=re.I).replace("-", "") for i in identifiers)
        found = next((h for h in plain if re.fullmatch("[0-9a-fA-F]{32}", h)), "")
        key, length = bytes.fromhex(found), 1024
    if not key:
        return None
    head = data[:length]
    mask = (key * (length // len(key) + 1))[: len(head)]
    return bytes(a ^ b for a, b in zip(head, mask, strict=True)) + data[length:]


def looks_like_font(data: bytes) -> bool:
    return data[:4].hex().upper() in FONT_MAGIC


_ASCII = bytes(b if b < 0x80 else ord("?") for b in range(256))
_DECLARED = re.compile(r"""^\s*<\?xml\s[^>]*?encoding\s*=\s*["']([^"']*)["']""")
_META = re.compile(r"""<meta\s[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_.:\-]+)""", re.I)


def decode_markup(data: bytes, html: bool = False) -> tuple[str, dict | None]:
    """Text of an XML or HTML file and, where its bytes belied the encoding, what was declared.

    Byte order mark, XML declaration, then (for HTML) a meta element in the
    first 1024 bytes; UTF-8 without any. What can't be decoded is Latin-1.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return _decoded(data[len(mark) :], name)
    head = data[:1024].translate(_ASCII, b"\0").decode("ascii")
    m = _DECLARED.search(head) or (_META.search(head) if html else None)
    return _decoded(data, trim(m[1]).lower() if m else None)


def _decoded(data: bytes, label: str | None) -> tuple[str, dict | None]:
    if label in ("iso-8859-1", "latin1", "windows-1252", "us-ascii"):
        return data.decode("latin-1"), None
    codec = {"utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(label or "", "utf-8")
    try:
        return data.decode(codec, "strict" if codec == "utf-8" or len(data) % 2 else "surrogatepass"), None
    except UnicodeDecodeError:
        return data.decode("latin-1"), {"declared": label or "", "used": "latin1"}
