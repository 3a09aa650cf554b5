"""Places in a publication: canonical text, offsets, locators, search and repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

#: Characters of a locator's highlight and of its context, and how far a repair looks around. Fixed values.
HIGHLIGHT, CONTEXT, AROUND = 64, 32, 2000
#: Own upper-case forms of one character that make several. Fixed values.
SPECIAL_UPPER = {"ß": "SS", "ﬀ": "FF", "ﬁ": "FI", "ﬂ": "FL", "ﬃ": "FFI", "ﬄ": "FFL", "ﬅ": "ST", "ﬆ": "ST"}


def canonical_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, text, total_chars) of blocks(keys…, ord, text): blocks in order, a line feed after each."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "")
    return blocks.groupBy(*keys).agg(joined.alias("text")).withColumn("total_chars", F.length("text").cast("bigint"))


def block_offsets(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with start and end: offsets in their section's canonical text."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("bigint")
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def resolve_links(places: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, path, at, name, kind, to_path, to_at, found): where links and note references lead.

    places as read_places gives them, sections(book_id, path). A fragment that
    isn't there leads to its section's start, with found false; a target
    outside of the sections has no to_at.
    """
    links = places.where("kind in ('link', 'noteref') and target is not null").withColumns({"to_path": F.substring_index("target", "#", 1), "fragment": F.when(F.col("target").contains("#"), F.substring_index("target", "#", -1))})
    anchors = places.where("kind = 'anchor'").groupBy("book_id", F.col("path").alias("to_path"), F.col("name").alias("fragment")).agg(F.min("at").alias("anchor_at"))
    known = sections.select("book_id", F.col("path").alias("to_path")).distinct().withColumn("known", F.lit(True))
    out = links.join(anchors, ["book_id", "to_path", "fragment"], "left").join(known, ["book_id", "to_path"], "left")
    at = F.when(F.col("known"), F.coalesce("anchor_at", F.lit(0).cast("bigint")))
    return out.select("book_id", "path", "at", "name", "kind", "to_path", at.alias("to_at"), (F.col("known").isNotNull() & (F.col("fragment").isNull() | F.col("anchor_at").isNotNull())).alias("found"))


def note_texts(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """links of kind noteref with the text of the block that they lead to: blocks(book_id, path, start, end, text)."""
    notes = links.where("kind = 'noteref' and to_at is not null")
    b = blocks.select(F.col("book_id").alias("b_"), F.col("path").alias("p_"), "start", "end", F.col("text").alias("note"))
    return notes.join(b, (notes.book_id == F.col("b_")) & (notes.to_path == F.col("p_")) & (notes.to_at >= F.col("start")) & (notes.to_at <= F.col("end"))).drop("b_", "p_", "start", "end")


def locator(text: Column, start: Column, end: Column, ref: Column) -> Column:
    """A locator as JSON: reference, offset, and the text at, before and after it."""
    first, last = F.greatest(start - CONTEXT, F.lit(0)), F.least(end, start + HIGHLIGHT)
    return F.to_json(
        F.struct(
            ref.alias("href"),
            F.struct(start.alias("charOffset"), (start / F.greatest(F.length(text), F.lit(1))).alias("progression")).alias("locations"),
            F.struct(F.substring(text, (first + 1).cast("int"), (start - first).cast("int")).alias("before"), F.substring(text, (start + 1).cast("int"), (last - start).cast("int")).alias("highlight"), F.substring(text, (end + 1).cast("int"), F.lit(CONTEXT)).alias("after")).alias("text"),
        )
    )


def find_all(texts: DataFrame, query: str, case_sensitive: bool = True) -> DataFrame:
    """(key, at, locator) of every place, not overlapping, where texts(key, text) hold the query."""
    if not query:
        raise ValueError("empty query")
    schema = StructType([StructField("key", texts.schema["key"].dataType), *StructType.fromDDL("at bigint, of bigint, before string, highlight string, after string").fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query if case_sensitive else query.lower()
        for batch in batches:
            whose, rows = [], []
            for k, text in enumerate(batch.column(1)):
                t = text.as_py() or ""
                folded = t if case_sensitive else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                at = folded.find(q)
                while at >= 0:
                    end = at + len(q)
                    whose.append(k)
                    rows.append((at, len(t), t[max(0, at - CONTEXT) : at], t[at : min(end, at + HIGHLIGHT)], t[end : end + CONTEXT]))
                    at = folded.find(q, end)
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(kinds)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), *columns], schema.names)

    found = texts.select("key", "text").mapInArrow(run, schema)
    place = F.struct(F.col("at").alias("charOffset"), (F.col("at") / F.greatest("of", F.lit(1))).alias("progression"))
    said = F.to_json(F.struct(F.col("key").cast("string").alias("href"), place.alias("locations"), F.struct("before", "highlight", "after").alias("text")))
    return found.select("key", "at", said.alias("locator"))


def repair(text: str, offset: int, before: str, highlight: str, after: str) -> tuple[int, float]:
    """Where a locator's text is now, and how sure: at its place 1.0; moved, with both contexts 0.9, with one 0.7, with none 0.5; only a context 0.3; else its offset, 0.0."""
    if highlight and text.startswith(highlight, offset) and text.endswith(before, 0, offset) and text.startswith(after, offset + len(highlight)):
        return offset, 1.0
    best: tuple[float, int, int] = (0.0, 0, min(max(offset, 0), len(text)))
    low, high = max(0, offset - AROUND), min(len(text), offset + AROUND)
    if highlight:
        at = text.find(highlight, low)
        while 0 <= at < high:
            sides = bool(before) and text.endswith(before, 0, at), bool(after) and text.startswith(after, at + len(highlight))
            best = max(best, ({2: 0.9, 1: 0.7, 0: 0.5}[sum(sides)], -abs(at - offset), at))
            at = text.find(highlight, at + 1)
    if best[0] == 0.0:
        for words, shift in ((before, len(before)), (after, 0)):
            if words and 0 <= (at := text.find(words, low)) < high:
                best = max(best, (0.3, -abs(at + shift - offset), at + shift))
    return best[2], best[0]


def display_text(text: str, uppercase: bool = False, soft_hyphens: tuple[int, ...] = ()) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Text as shown and where it differs: (canonical start, display start, canonical length, display length) of each change."""
    out, changes, at = [], [], 0
    for i, c in enumerate(text):
        if i in soft_hyphens:
            changes.append((i, at, 0, 1))
            out.append("­")
            at += 1
        shown = (SPECIAL_UPPER.get(c) or (c.upper() if len(c.upper()) == 1 else c)) if uppercase else c
        if len(shown) != 1:
            changes.append((i, at, 1, len(shown)))
        out.append(shown)
        at += len(shown)
    return "".join(out), changes


def to_display(changes: list[tuple[int, int, int, int]], offset: int) -> int:
    """Display offset of a canonical one; inside of a change, its start."""
    shift = 0
    for c, d, n, m in changes:
        if c + n > offset or (n == 0 and c > offset):
            break
        shift = d + m - (c + n)
    return offset + shift


def to_canonical(changes: list[tuple[int, int, int, int]], offset: int) -> int:
    """Canonical offset of a display one; inside of a change, its start."""
    shift = 0
    for c, d, n, m in changes:
        if d > offset:
            break
        if offset < d + m:
            return c
        shift = c + n - (d + m)
    return offset + shift


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)
