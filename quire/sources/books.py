"""Books as tables: a row for each book, exploded into entries, manifest, spine, navigation, diagnostics and blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import href
from quire.functions.dates import publication_date
from quire.functions.text import finite_double_col
from quire.sources import xmldoc
from quire.sources.htmltree import blocks, parse_html, places
from quire.sources.package import Book, ProviderReader, Reader
from quire.sources.zipdir import Fatal, read_directory, read_entry

ENTRY = "ord int, name string, raw_name string, name_len int, flags int, method int, csize bigint, usize bigint, lho bigint, crc32 bigint, invalid string, is_dir boolean"
ITEM = "id string, href string, path string, media_type string, kind string, properties array<string>, fallback string, missing boolean, remote boolean"
SPINE = "pos int, idref string, path string, content_id string, content_path string, kind string, linear boolean, local boolean"
POINT = "list string, node_id int, parent_id int, root_ord int, depth int, title string, path string, fragment string, type string, synthesized boolean"
DIAGNOSTIC = "seq int, code string, severity string, href string, details map<string,string>"
INFO = "version string, title string, subtitle string, authors array<string>, contributors array<string>, language string, publisher string, identifier string, identifiers array<string>, description string, published string, modified string, subjects array<string>, rights string, series string, series_index string, layout string, direction string, nav_path string, ncx_path string, cover_path string, raw map<string,array<string>>"
FATAL = "kind string, message string, scheme string, href string"
BOOK = f"book_id string, opf_path string, delta bigint, zip64 boolean, fatal struct<{FATAL.replace(' ', ':').replace(',:', ',')}>, info struct<{INFO.replace(', ', ',').replace(' ', ':')}>, entries array<struct<{ENTRY.replace(', ', ',').replace(' ', ':')}>>, manifest array<struct<{ITEM.replace(', ', ',').replace(' ', ':')}>>, spine array<struct<{SPINE.replace(', ', ',').replace(' ', ':')}>>, nav array<struct<{POINT.replace(', ', ',').replace(' ', ':')}>>, diagnostics array<struct<{DIAGNOSTIC.replace('string,string', 'string;string').replace(', ', ',').replace(' ', ':').replace(';', ',')}>>"

#: Rows, and bytes about, that leave a parser together; an item of a list counts for so many bytes.
BATCH_ROWS, BATCH_BYTES, NESTED_BYTES = 200, 1 << 20, 200


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("book_id"), "content")


def _rows(run, schema: str):
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for row in run(*(c[k].as_py() for c in batch.columns)):
                    held.append(row)
                    size += sum(len(v) if isinstance(v, (str, bytes)) else NESTED_BYTES * len(v) for v in row.values() if hasattr(v, "__len__"))
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return batches_of


def _dict(e) -> dict:
    return {"ord": e.ord, "name": e.name, "raw_name": e.raw_name, "name_len": e.name_len, "flags": e.flags, "method": e.method, "csize": e.csize, "usize": e.usize, "lho": e.lho, "crc32": e.crc32, "invalid": e.invalid, "is_dir": e.is_dir}


def read_books(books: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each book of books(book_id, content): all that its container and package say.

    A book that can't be read has ``fatal``, with kind, message, scheme and
    href, and what was read before; nothing makes a task fail. A null content
    is an empty file. With strict, a warning is fatal.
    """

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        yield _book_row(book_id, Reader(content or b"", strict).read())

    return books.select("book_id", "content").mapInArrow(_rows(one, BOOK), BOOK)


def read_provided(resources: DataFrame, strict: bool = False) -> DataFrame:
    """The same rows for books whose files are rows already: resources(book_id, href, bytes), in the clear.

    A book's resources come together in one task, as one archive's would. Of
    repeated names the first in order of bytes counts; null bytes are empty.
    """

    def one(book_id: str, found: list[dict]) -> Iterator[dict]:
        files: dict[str, bytes] = {}
        for r in found:
            files.setdefault(r["href"], r["bytes"] or b"")
        yield _book_row(book_id, ProviderReader(files, strict).read())

    listed = resources.where("href is not null").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("href", "bytes"))).alias("files"))
    return listed.mapInArrow(_rows(one, BOOK), BOOK)


def _book_row(book_id: str, b: Book) -> dict:
    info = {k: (list(v.items()) if k == "raw" else v) for k, v in b.info.items()} or None
    diagnostics = [{**d, "details": list(d["details"].items())} for d in b.diagnostics]
    return {"book_id": book_id, "opf_path": b.opf_path, "delta": b.directory.delta if b.directory else None, "zip64": b.directory.zip64 if b.directory else None, "fatal": b.fatal, "info": info, "entries": [_dict(e) for e in b.directory.entries] if b.directory else [], "manifest": b.manifest, "spine": b.spine, "nav": b.nav, "diagnostics": diagnostics}


def exploded(read: DataFrame, column: str) -> DataFrame:
    """One of a read book's lists as a table, ``ord`` its order where it has none of its own."""
    rows = read.select("book_id", F.posexplode(column).alias("ord_", "x"))
    out = rows.select("book_id", "ord_", "x.*")
    return out.drop("ord_") if column in ("entries", "nav", "diagnostics", "spine") else out.withColumnRenamed("ord_", "ord")


def metadata(read: DataFrame) -> DataFrame:
    """(book_id, opf_path, …) of books without fatal errors, dates and numbers typed; those that are malformed are null."""
    number: Column = finite_double_col(F.col("series_index"))
    return read.where("fatal is null").select("book_id", "opf_path", "info.*").withColumns({"published": publication_date(F.col("published")), "modified": publication_date(F.col("modified")), "series_index": number})


def read_resources(books: DataFrame) -> DataFrame:
    """(book_id, path, bytes, crc_ok, problem) of every readable or unreadable entry: first of each name, no directories."""

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        data = content or b""
        try:
            directory = read_directory(data)
        except Fatal:
            return
        for e in directory.by_name.values():
            try:
                out, problem = read_entry(data, e)
                yield {"book_id": book_id, "path": e.name, "bytes": out, "crc_ok": problem is None, "problem": problem and problem["reason"]}
            except Fatal as f:
                yield {"book_id": book_id, "path": e.name, "bytes": None, "crc_ok": False, "problem": f.message}

    schema = "book_id string, path string, bytes binary, crc_ok boolean, problem string"
    return books.select("book_id", "content").mapInArrow(_rows(one, schema), schema)


def read_blocks(books: DataFrame) -> DataFrame:
    """(book_id, pos, path, ord, tag, text): leaf blocks of the sections in reading order; a section that can't be read has one block 'unreadable'."""

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        data = content or b""
        b = Reader(data).read()
        if b.fatal:
            return
        for s in b.spine:
            if not s["local"] or s["kind"] != "xhtml":
                continue
            try:
                raw, _ = read_entry(data, b.directory.find(s["content_path"]))
                found = blocks(parse_html(xmldoc.decode_markup(raw, html=True)[0]))
            except Fatal as f:
                found = [("unreadable", f.message)]
            for k, (tag, text) in enumerate(found):
                yield {"book_id": book_id, "pos": s["pos"], "path": s["content_path"], "ord": k, "tag": tag, "text": text}

    schema = "book_id string, pos int, path string, ord int, tag string, text string"
    return books.select("book_id", "content").mapInArrow(_rows(one, schema), schema)


def read_places(books: DataFrame) -> DataFrame:
    """(book_id, pos, path, kind, name, target, at): anchors, links and page marks of the sections, at offsets of the canonical text.

    A row of kind 'anchor' has its id as name; of kind 'link' or 'noteref', the
    text as name and where it leads as target, path and fragment; of kind
    'pagebreak' the page's label.
    """

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        data = content or b""
        b = Reader(data).read()
        if b.fatal:
            return
        for s in b.spine:
            if not s["local"] or s["kind"] != "xhtml":
                continue
            try:
                raw, _ = read_entry(data, b.directory.find(s["content_path"]))
            except Fatal:
                continue
            for kind, name, ref, at in places(parse_html(xmldoc.decode_markup(raw, html=True)[0])):
                target = None
                if ref is not None and not href.has_scheme(ref):
                    path, fragment = href.split_fragment(ref)
                    to = s["content_path"] if not path else href.normalize(href.dirname(s["content_path"]), path)
                    target = to and (href.decode_path(to) or to) + ("#" + fragment if fragment else "")
                yield {"book_id": book_id, "pos": s["pos"], "path": s["content_path"], "kind": kind, "name": name, "target": target, "at": at}

    schema = "book_id string, pos int, path string, kind string, name string, target string, at bigint"
    return books.select("book_id", "content").mapInArrow(_rows(one, schema), schema)


def clear_fonts(books: DataFrame) -> DataFrame:
    """(book_id, path, kind, bytes, is_font) of the obfuscated fonts, made plain where the book has the key."""

    def one(book_id: str, content: bytes | None) -> Iterator[dict]:
        data = content or b""
        b = Reader(data).read()
        if b.fatal:
            return
        for path, kind in b.obfuscation.items():
            e = b.directory.find(path)
            if e is None or kind == "unknown":
                continue
            try:
                raw = read_entry(data, e)[0]
            except Fatal:
                continue
            plain = xmldoc.clear_font(raw, kind, [b.info["identifier"]] if b.info["identifier"] else [], b.info["identifiers"])
            yield {"book_id": book_id, "path": path, "kind": kind, "bytes": plain, "is_font": plain is not None and xmldoc.looks_like_font(plain)}

    schema = "book_id string, path string, kind string, bytes binary, is_font boolean"
    return books.select("book_id", "content").mapInArrow(_rows(one, schema), schema)


def page_blocks(pages: DataFrame, lenient: bool = True) -> DataFrame:
    """(page_id, ord, tag, text): leaf blocks of pages(page_id, html); unless lenient, references without a semicolon stay as they are."""

    def one(page_id: int, html: str | None) -> Iterator[dict]:
        for k, (tag, text) in enumerate(blocks(parse_html(html or "", lenient))):
            yield {"page_id": page_id, "ord": k, "tag": tag, "text": text}

    schema = "page_id bigint, ord int, tag string, text string"
    return pages.select("page_id", "html").mapInArrow(_rows(one, schema), schema)


def write_tables(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Parquet tables partitioned by a hash of book_id; writing books again replaces their partitions only."""
    for name, df in tables.items():
        df.withColumn("part", F.pmod(F.xxhash64("book_id"), F.lit(buckets))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")
