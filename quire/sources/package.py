"""Reading one packaged book: container, package document, navigation, table of contents, cover."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.functions import href as H
from quire.functions.text import collapse_xml, tokens, trim
from quire.sources import xmldoc as X
from quire.sources.htmltree import MAX_DEPTH, MAX_ENTRIES, navigation
from quire.sources.zipdir import MAX_METADATA, Directory, Entry, Fatal, mimetype_problem, read_directory, read_entry

#: Severities of diagnostics; all others are warnings. Fixed values.
INFO = {"mimetypeIrregular", "zipDuplicateEntry", "pathCaseMismatch", "encryptionIgnored", "encodingFallback", "tocReconciled", "coverHeuristic", "navIgnored", "spineItemDuplicate", "stylesheetMediaIgnored", "cssRuleIgnored"}
MAX_DOCUMENT = 4 << 20
MAX_FALLBACK = 16
DC = "http://purl.org/dc/elements/1.1/"
NCX_MEDIA = "application/x-dtbncx+xml"


@dataclass
class Book:
    """What was read of a book; fatal says why the rest is missing."""

    directory: Directory | None = None
    fatal: dict | None = None
    diagnostics: list[dict] = field(default_factory=list)
    obfuscation: dict[str, str] = field(default_factory=dict)
    opf_path: str | None = None
    info: dict = field(default_factory=dict)
    manifest: list[dict] = field(default_factory=list)
    spine: list[dict] = field(default_factory=list)
    nav: list[dict] = field(default_factory=list)

    def say(self, code: str, href: str | None = None, **details: object) -> None:
        self.diagnostics.append({"seq": len(self.diagnostics), "code": code, "severity": "info" if code in INFO else "warning", "href": href, "details": {k: str(v) for k, v in details.items() if v is not None}})


class Reader:
    """Reads a packaged book from its bytes."""

    def __init__(self, data: bytes, strict: bool = False):
        self.data, self.strict, self.book = data, strict, Book()

    def read(self) -> Book:
        """All of a book. Whatever is wrong becomes a diagnostic or the fatal reason, never an exception."""
        b = self.book
        try:
            self._container()
            self._package()
        except Fatal as f:
            b.fatal = {"kind": f.kind, "message": f.message, "scheme": f.scheme, "href": f.href}
        if self.strict and b.fatal is None:
            bad = next((d for d in b.diagnostics if d["severity"] == "warning" or d["code"] == "mimetypeIrregular"), None)
            if bad:
                b.fatal = {"kind": "strict", "message": bad["code"], "scheme": None, "href": bad["href"]}
        return b

    # Container

    def _container(self) -> None:
        b = self.book
        b.directory = read_directory(self.data)
        for e in b.directory.duplicates:
            b.say("zipDuplicateEntry", e.name, rawName=e.raw_name)
        self._encryption()
        if b.directory.delta > 0:
            b.say("mimetypeIrregular", None, reason="prefix", delta=b.directory.delta)
        if reason := mimetype_problem(self.data, b.directory):
            b.say("mimetypeIrregular", "mimetype", reason=reason)

    def _fetch(self, path: str) -> tuple[Entry, bytes] | None:
        e = self.book.directory.find(path)
        if e is None:
            return None
        if e.name != path:
            self.book.say("pathCaseMismatch", path, actual=e.name)
        out, problem = read_entry(self.data, e)
        if problem:
            self.book.say("zipCrcMismatch", e.name, **problem)
        return e, out

    def _plain(self, path: str) -> str | None:
        """Small text of the container's own; None if it is too large or can't be read."""
        e = self.book.directory.find(path)
        if e is None or e.usize > MAX_METADATA:
            return None
        try:
            return self._fetch(path)[1].decode("utf-8", "replace")
        except Fatal:
            return None

    def _encryption(self) -> None:
        b = self.book
        find = b.directory.find
        if find("META-INF/license.lcpl"):
            raise Fatal("encrypted", "licence", "lcp")
        if find("META-INF/rights.xml"):
            text = self._plain("META-INF/rights.xml")
            raise Fatal("encrypted", "rights", X.rights_scheme(text) if text is not None else "unknown:rights.xml", "META-INF/rights.xml")
        if not find("META-INF/encryption.xml"):
            return
        text = self._plain("META-INF/encryption.xml")
        try:
            items = X.encrypted_items(text) if text is not None else None
        except X.XmlError:
            items = None
        if items is None:
            raise Fatal("encrypted", "encryption.xml unreadable", "unknown:encryption.xml-invalido", "META-INF/encryption.xml")
        if any(i.lcp for i in items):
            raise Fatal("encrypted", "key", "lcp")
        if any(i.adept for i in items):
            raise Fatal("encrypted", "key", "adobe-adept")
        for i in items:
            if not X.is_font_path(self._named(i.uri)):
                raise Fatal("encrypted", "resource", f"unknown:{i.algorithm}", self._named(i.uri))
        self._obfuscated(items)

    def _named(self, uri: str) -> str:
        e = self.book.directory.find(uri)
        return e.name if e else uri

    def _obfuscated(self, items: list[X.Encrypted]) -> None:
        b = self.book
        for path, algorithm in ((self._named(i.uri), i.algorithm) for i in items):
            b.obfuscation[path] = X.obfuscation(algorithm)
            if b.obfuscation[path] == "unknown":
                b.say("fontObfuscationUnknown", path, algorithm=algorithm)

    # Package document

    def _decode(self, data: bytes, path: str, html: bool = False) -> str:
        text, wrong = X.decode_markup(data, html)
        if wrong:
            self.book.say("encodingFallback", path, **wrong)
        return text

    def _document(self, path: str, kind: str) -> tuple[str, str]:
        got = self._fetch(path)
        if got is None:
            raise Fatal(kind, f"{path} is missing", href=path)
        if got[0].usize > MAX_DOCUMENT:
            raise Fatal(kind, f"{path} is too large", href=path)
        return got[0].name, self._decode(got[1], got[0].name)

    def _package(self) -> None:
        b, find = self.book, self.book.directory.find
        roots = X.rootfiles(self._document("META-INF/container.xml", "container")[1])
        places = (c for r in roots if (n := H.normalize("", r)) for c in H.candidates(n) if find(c))
        where = next(places, None)
        if where is None:
            raise Fatal("package", "package document is missing", href=roots[0])
        b.opf_path, text = self._document(where, "package")
        try:
            root = X.parse_xml(text)
        except X.XmlError as error:
            raise Fatal("package", "package document is not XML", href=b.opf_path) from error
        manifest, spine = root.child("manifest"), root.child("spine")
        if root.local != "package" or manifest is None or spine is None:
            raise Fatal("package", "no package, manifest or spine", href=b.opf_path)
        refs, items = self._items(manifest, spine)
        meta = Metadata(root.child("metadata"), root.attr("unique-identifier"))
        for item in items:
            b.manifest.append(self._located(item))
        for item in b.manifest:
            if not item["missing"] and not item["remote"] and item["path"] in b.obfuscation and not X.is_font_media(item["media_type"]):
                raise Fatal("encrypted", "obfuscation on content", "unknown:obfuscation-on-content", item["path"])
        self._spine(refs)
        ways = {"ltr": "ltr", "rtl": "rtl"}
        b.info = {"version": trim(root.attrs.get("version", "")), "direction": ways.get((spine.attr("page-progression-direction") or "").lower(), "auto"), **meta.fields}
        self._navigation(root, spine.attr("toc"))
        b.info["cover_path"] = self._cover(meta.cover)

    def _items(self, manifest: X.Node, spine: X.Node) -> tuple[list[tuple[str, bool]], list[dict]]:
        b, items = self.book, {}
        for e in manifest.elements("item"):
            name, where = e.attr("id"), e.attrs.get("href")
            if not name or where is None:
                b.say("resourceMissing", None, reason="no-href" if name else "no-id", id=name or None)
            elif name not in items:
                items[name] = {"id": name, "href": where, "media_type": e.attr("media-type") or "", "properties": tokens(e.attr("properties")), "fallback": e.attr("fallback")}
        refs: dict[str, bool] = {}
        for e in spine.elements("itemref"):
            name = e.attr("idref") or ""
            if name not in items:
                b.say("spineItemUnresolved", b.opf_path, idref=name)
            elif name in refs:
                b.say("spineItemDuplicate", b.opf_path, idref=name)
            else:
                refs[name] = (e.attr("linear") or "").lower() != "no"
        return list(refs.items()), list(items.values())

    def _located(self, raw: dict) -> dict:
        """A manifest item with its path in the container, and whether it is missing or remote."""
        b, ref = self.book, raw["href"]
        media = trim(raw["media_type"].partition(";")[0]).lower()
        kind = "xhtml" if media in ("application/xhtml+xml", "text/html", "text/x-oeb1-document") else "image" if media.startswith("image/") else "unsupported"
        item = {**raw, "media_type": media, "kind": kind, "path": ref, "missing": False, "remote": False}
        if H.is_remote(ref):
            return {**item, "remote": True}
        path = H.normalize(H.dirname(b.opf_path), ref)
        if path is None:
            b.say("resourceMissing", None, id=raw["id"], raw=ref)
            return {**item, "missing": True}
        options = H.candidates(path)
        to_self = b.opf_path.lower() in (o.lower() for o in options)
        to_directory = trim(ref).partition("#")[0].partition("?")[0].endswith(("/", "\\"))
        if to_self or to_directory:
            b.say("resourceMissing", options[0], id=raw["id"], reason="opf" if to_self else "directory")
            return {**item, "path": options[0], "missing": True}
        found = next((o for o in options if b.directory.find(o)), None)
        if found is None:
            b.say("resourceMissing", options[0], id=raw["id"])
        return {**item, "path": found or options[0], "missing": found is None}

    def _spine(self, refs: list[tuple[str, bool]]) -> None:
        b = self.book
        by_id = {i["id"]: i for i in b.manifest}
        seen: set[str] = set()
        for name, linear in refs:
            item = by_id[name]
            if item["path"].lower() in seen:
                b.say("spineItemDuplicate", b.opf_path, idref=name)
                continue
            seen.add(item["path"].lower())
            content = self._content(item, by_id)
            b.spine.append({"pos": len(b.spine), "idref": name, "path": item["path"], "content_id": content["id"], "content_path": content["path"], "kind": content["kind"], "linear": linear, "local": not content["missing"] and not content["remote"]})
        if not b.spine:
            raise Fatal("package", "empty spine", href=b.opf_path)

    def _content(self, item: dict, by_id: dict[str, dict]) -> dict:
        """The item, or the first along its fallbacks that can be shown."""
        shown = lambda i: not i["missing"] and not i["remote"] and i["kind"] != "unsupported"
        at, seen = item, {item["id"]}
        for _ in range(MAX_FALLBACK + 1):
            if shown(at):
                return at
            at = by_id.get(at["fallback"])
            if at is None or at["id"] in seen:
                break
            seen.add(at["id"])
        if item["remote"]:
            self.book.say("resourceMissing", item["path"], id=item["id"], reason="remote")
        if item["kind"] == "unsupported":
            self.book.say("unsupportedMediaType", item["path"], mediaType=item["media_type"])
        return item

    # Navigation

    def _navigation(self, root: X.Node, spine_toc: str | None) -> None:
        b = self.book
        nav: dict[str, list[dict]] = {}
        b.info["nav_path"] = b.info["ncx_path"] = None
        item = next((i for i in b.manifest if "nav" in i["properties"]), None)
        if item and (text := self._nav_text(item, True)) is not None:
            nav, cut = navigation(text)
            b.info["nav_path"] = item["path"]
            if not nav.get("toc"):
                b.say("navIgnored", item["path"], reason="no-toc")
            if cut:
                b.say("navIgnored", item["path"], reason="truncated")
        ncx: dict[str, list[dict]] = {}
        if not nav.get("toc") or not nav.get("page-list"):
            listed = [i for i in b.manifest if i["media_type"] == NCX_MEDIA]
            item = next((i for i in listed if i["id"] == spine_toc), next(iter(listed), None))
            if item and (text := self._nav_text(item, False)) is not None:
                try:
                    ncx, cut = ncx_lists(text)
                    b.info["ncx_path"] = item["path"]
                    if cut:
                        b.say("navIgnored", item["path"], reason="truncated")
                except X.XmlError:
                    b.say("navIgnored", item["path"], reason="invalid")
        self._index()
        for kind in ("toc", "page-list"):
            entries, where, own = (nav[kind], b.info["nav_path"], True) if nav.get(kind) else (ncx.get(kind, []), b.info["ncx_path"], False)
            points = [self._point(e, where, own) for e in entries]
            self._keep(kind, reconcile(points, b.spine, b.say) if kind == "toc" else points)
        guide = root.child("guide")
        marks = [{"depth": 1, "title": e.attr("title") or "", "href": e.attrs["href"], "type": e.attr("type") or ""} for e in (guide.elements("reference") if guide else ()) if "href" in e.attrs]
        self._keep("landmarks", [self._point(e, b.info["nav_path"], True) for e in nav["landmarks"]] if nav.get("landmarks") else [self._point(e, b.opf_path, False) for e in marks])

    def _nav_text(self, item: dict, html: bool) -> str | None:
        b = self.book
        if item["missing"] or item["remote"]:
            b.say("navIgnored", item["path"], reason="missing")
            return None
        try:
            got = self._fetch(item["path"])
        except Fatal as f:
            b.say("resourceUnreadable", item["path"], reason="unreadable", exception=f.message)
            b.say("navIgnored", item["path"], reason="unreadable")
            return None
        if got is None or got[0].usize > MAX_DOCUMENT:
            b.say("navIgnored", item["path"], reason="too-large" if got else "missing")
            return None
        return self._decode(got[1], item["path"], html)

    def _index(self) -> None:
        local = [i for i in self.book.manifest if not i["remote"]]
        in_spine = {s["path"] for s in self.book.spine}
        self.folded: dict[str, str] = {}
        for i in sorted(local, key=lambda i: i["path"] not in in_spine):
            self.folded.setdefault(i["path"].lower(), i["path"])
        self.exact = {i["path"]: self.folded[i["path"].lower()] for i in local}

    def _point(self, entry: dict, document: str | None, own: bool) -> dict:
        """An entry with its target, or without one if it leads nowhere in the book."""
        path = fragment = None
        ref = trim(entry["href"]) if entry["href"] is not None else None
        if ref is not None and not H.has_scheme(ref):
            fragment = H.split_fragment(ref)[1]
            if ref.startswith("#"):
                path = document if own else None
            elif (normal := H.normalize(H.dirname(document or ""), ref)) is not None:
                plain = H.decode_path(normal)
                keys = [k for k in (plain, normal) if k is not None]
                path = next((self.exact[k] for k in keys if k in self.exact), None) or next((self.folded[k.lower()] for k in keys if k.lower() in self.folded), None) or keys[0]
        title = entry["title"] or (H.stem(path) if path else "")
        return {"depth": entry["depth"], "title": title, "path": path, "fragment": fragment if path else None, "type": entry["type"], "synthesized": False}

    def _keep(self, kind: str, points: list[dict]) -> None:
        """Points as rows that know their parent, order and root."""
        parents: list[int] = []
        root = -1
        for k, p in enumerate(points):
            del parents[p["depth"] - 1 :]
            root += p["depth"] == 1
            self.book.nav.append({"list": kind, "node_id": k, "parent_id": parents[-1] if parents else None, "root_ord": root, **p})
            parents.append(k)

    # Cover

    def _cover(self, cover: str | None) -> str | None:
        b = self.book
        images = [i for i in b.manifest if not i["missing"] and not i["remote"] and i["media_type"].startswith("image/")]
        if marked := next((i for i in images if "cover-image" in i["properties"]), None):
            return marked["path"]
        if cover:
            named = next((i for i in b.manifest if i["id"] == cover), None)
            path = None if named else H.normalize(H.dirname(b.opf_path), cover)
            hit = next((i for i in images if i is named or (path is not None and i["path"] == path)), None)
            if hit:
                return hit["path"]
        hinted = [i for i in images if "cover" in i["id"].lower() or "cover" in i["path"].lower()]
        best = next((i for i in hinted if H.stem(i["path"]).lower() == "cover"), next(iter(hinted), None))
        if best is None:
            return None
        b.say("coverHeuristic", best["path"], id=best["id"])
        return best["path"]


class ProviderReader(Reader):
    """Reads a book whose resources come one by one and in the clear.

    Encryption can't be fatal then: what encryption.xml says of fonts counts,
    except for real ciphers, and one that can't be read is ignored. Names are
    matched as they are.
    """

    def __init__(self, resources: dict[str, bytes], strict: bool = False):
        super().__init__(b"", strict)
        self.resources = resources

    def _container(self) -> None:
        b = self.book
        b.directory = Directory([Entry(k, name, name, len(name), 0, 0, len(data), len(data), 0, 0, None) for k, (name, data) in enumerate(self.resources.items())], 0, False)
        b.directory.by_folded = {}
        data = self.resources.get("META-INF/encryption.xml")
        if data is None:
            return
        try:
            items = X.encrypted_items(data.decode("utf-8", "replace")) if len(data) <= MAX_METADATA else None
        except X.XmlError:
            items = None
        if items is None:
            b.say("encryptionIgnored", "META-INF/encryption.xml", reason="too-large" if len(data) > MAX_METADATA else "invalid-xml")
            return
        self._obfuscated([i for i in items if X.is_font_path(i.uri) and not (i.lcp or i.adept or i.algorithm.startswith(X.XMLENC))])

    def _fetch(self, path: str) -> tuple[Entry, bytes] | None:
        e = self.book.directory.by_name.get(path)
        return None if e is None else (e, self.resources[path])


def reconcile(toc: list[dict], spine: list[dict], say) -> list[dict]:
    """The table of contents with an entry for each linear section it leaves out, where reading order puts it."""
    index: dict[str, int] = {}
    for column in ("path", "content_path"):
        for s in spine:
            index.setdefault(s[column], s["pos"])
    covered = {p["path"] for p in toc}
    earliest: list[int] = []  # by root, the first section that it or what it holds leads to
    for p in toc:
        if p["depth"] == 1:
            earliest.append(len(spine))
        earliest[-1] = min(earliest[-1], index.get(p["path"], len(spine)))
    missing: dict[str, int] = {}
    for s in spine:
        if s["linear"] and s["local"] and not {s["path"], s["content_path"]} & covered and index[s["path"]] == s["pos"]:
            missing.setdefault(s["content_path"], s["pos"])
    if not missing:
        return toc
    slots: dict[int, list[dict]] = {}
    for path, pos in missing.items():
        slot = max((r for r, first in enumerate(earliest) if first < pos), default=-1) + 1
        slots.setdefault(slot, []).append({"depth": 1, "title": H.stem(path), "path": path, "fragment": None, "type": None, "synthesized": True})
    out, root = [], 0
    for p in toc:
        if p["depth"] == 1:
            out += slots.get(root, [])
            root += 1
        out.append(p)
    say("tocReconciled", None, orphans=len(missing))
    return out + slots.get(root, [])


def ncx_lists(text: str) -> tuple[dict[str, list[dict]], bool]:
    """Lists of an NCX file as flat entries, and whether one was cut."""
    root, out, cut = X.parse_xml(text), {}, False
    for kind, holder, item in (("toc", "navMap", "navPoint"), ("page-list", "pageList", "pageTarget")):
        out[kind] = []
        top = root.child(holder)
        todo = [(e, 1) for e in reversed(list(top.elements(item)))] if top else []
        while todo:
            e, depth = todo.pop()
            if depth > MAX_DEPTH or len(out[kind]) >= MAX_ENTRIES:
                cut = True
                break
            label, content = e.child("navLabel"), e.child("content")
            words = label.child("text") if label else None
            title = collapse_xml("".join(c for c in words.children if isinstance(c, str))) if words else ""
            out[kind].append({"depth": depth, "title": title, "href": content.attrs.get("src") if content else None, "type": None})
            if kind == "toc":
                todo += [(c, depth + 1) for c in reversed(list(e.elements(item)))]
    return out, cut


class Metadata:
    """Fields of a package's metadata; what no field takes stays in raw, in document order."""

    def __init__(self, element: X.Node | None, unique_id: str | None):
        found = [e for e in (element.walk() if element else ()) if self._is_dc(e) or e.local == "meta"]
        self.dc = [e for e in found if self._is_dc(e)]
        self.meta = [e for e in found if not self._is_dc(e)]
        self.owner: dict[str, X.Node] = {}
        for e in found:
            if e.attr("id"):
                self.owner.setdefault(e.attr("id"), e)
        self.used: set[int] = set()
        self.cover: str | None = None
        self.fields = self._fields(unique_id)
        raw: dict[str, list[str]] = {}
        for e in found:
            if id(e) not in self.used:
                key = e.local.lower() if self._is_dc(e) else e.attr("property") or e.attr("name")
                value = e.text if self._is_dc(e) else (e.text or e.attr("content")) if e.attr("property") else e.attr("content")
                if key and value:
                    raw.setdefault(key, []).append(value)
        self.fields["raw"] = raw

    @staticmethod
    def _is_dc(e: X.Node) -> bool:
        return e.ns == DC or e.prefix == "dc"

    def _use(self, e: X.Node | None) -> X.Node | None:
        if e is not None:
            self.used.add(id(e))
        return e

    def _all(self, name: str) -> list[X.Node]:
        return [e for e in self.dc if e.local.lower() == name and e.text]

    def _refining(self, e: X.Node, prop: str) -> list[X.Node]:
        """What refines e; of several elements with one id only the first is refined."""
        mine = e.attr("id")
        if not mine or self.owner.get(mine) is not e:
            return []
        return [m for m in self.meta if (m.attr("refines") or "").removeprefix("#") == mine and m.attr("property") == prop and m.text]

    def _metas(self, **want: str) -> list[X.Node]:
        return [m for m in self.meta if not m.attr("refines") and all(m.attr(k) == v for k, v in want.items())]

    def _one(self, name: str) -> str | None:
        e = self._use(next(iter(self._all(name)), None))
        return e.text if e else None

    def _fields(self, unique_id: str | None) -> dict:
        ids = self._all("identifier")
        unique = self._use(next((e for e in ids if unique_id is not None and e.attr("id") == unique_id), next(iter(ids), None)))
        kinds = {}
        titles = self._all("title")
        for t in titles:
            r = self._use(next(iter(self._refining(t, "title-type")), None))
            kinds[id(t)] = r.text.lower() if r else None
        pick = lambda ok: next((t for t in titles if ok(kinds[id(t)])), None)
        title = self._use(pick(lambda k: k == "main") or pick(lambda k: k not in ("subtitle", "expanded")) or next(iter(titles), None))
        subtitle = self._use(next((t for t in titles if t is not title and kinds[id(t)] == "subtitle"), None))
        people: dict[bool, list[str]] = {True: [], False: []}
        for e in self.dc:
            if e.text and e.local.lower() in ("creator", "contributor"):
                refined = self._refining(e, "role")
                roles = ([e.attr("role").lower()] if e.attr("role") is not None else []) + [self._use(r).text.lower() for r in refined]
                people[e.local.lower() == "creator" and (not roles or "aut" in roles)].append(self._use(e).text)
        dates = self._all("date")
        event = lambda d: (d.attr("event") or "").lower()
        published = next((d for d in dates if event(d) == "publication"), next((d for d in dates if event(d) != "modification"), None))
        modified = next((m for m in self._metas(property="dcterms:modified") if m.text), next((d for d in dates if event(d) == "modification"), None))
        layout = self._use(next(iter(self._metas(property="rendition:layout")), None))
        cover = self._use(next((m for m in self._metas(name="cover") if m.attr("content")), None))
        self.cover = cover.attr("content") if cover else None
        series, index = self._series()
        return {
            "title": title.text if title else None,
            "subtitle": subtitle.text if subtitle else None,
            "authors": people[True],
            "contributors": people[False],
            "language": self._one("language"),
            "publisher": self._one("publisher"),
            "identifier": unique.text if unique else None,
            "identifiers": [e.text for e in ids],
            "description": self._one("description"),
            "published": self._use(published).text if published else None,
            "modified": self._use(modified).text if modified else None,
            "subjects": [self._use(s).text for s in self._all("subject")],
            "rights": self._one("rights"),
            "series": series,
            "series_index": index,
            "layout": "pre-paginated" if layout is not None and layout.text == "pre-paginated" else "reflowable",
        }

    def _series(self) -> tuple[str | None, str | None]:
        for c in self._metas(property="belongs-to-collection"):
            kinds = self._refining(c, "collection-type")
            if c.text and (not kinds or any(k.text.lower() == "series" for k in kinds)):
                for k in kinds:
                    self._use(k)
                place = self._use(next(iter(self._refining(c, "group-position")), None))
                return self._use(c).text, place.text if place else None
        calibre = next((m for m in self._metas(name="calibre:series") if m.attr("content")), None)
        if calibre is None:
            return None, None
        place = self._use(next(iter(self._metas(name="calibre:series_index")), None))
        return self._use(calibre).attr("content"), place.attr("content") if place else None
