"""Pages from measured lines, and table grids: folds over one section or one table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Lines of a paragraph that stay together at a page's foot and head, and page heights under which that is given up.
ORPHANS, WIDOWS, SMALL_PAGE = 2, 2, 6.0


def legal_breaks(kind: list[str], block: list[int], at: list[int], size: list[int], forced: list[bool], relaxed: bool = False) -> np.ndarray:
    """Whether a page may begin at each line: not inside a heading or right after one, not leaving too few lines of a paragraph on either side."""
    ok = np.ones(len(kind), bool)
    for i in range(1, len(kind)):
        if forced[i] or relaxed:
            continue
        if block[i] == block[i - 1]:
            ok[i] = kind[i] == "paragraph" and at[i] >= ORPHANS and size[i] - at[i] >= WIDOWS
        else:
            ok[i] = kind[i - 1] != "heading"
    return ok


def fill_pages(height: list[float], ok: np.ndarray, forced: list[bool], page: float, start: int = 0) -> list[tuple[int, int]]:
    """[first, end) of each page from line start on: as many lines as fit, back to the last place where a page may begin; a line that doesn't fit alone has its page."""
    out, i, n = [], start, len(height)
    while i < n:
        used, j = 0.0, i
        while j < n and (j == i or (used + height[j] <= page + 1e-9 and not forced[j])):
            used += height[j]
            j += 1
        cut = j
        if j < n and not forced[j]:
            while cut > i + 1 and not ok[cut]:
                cut -= 1
            if not ok[cut]:
                cut = j
        out.append((i, cut))
        i = cut
    return out


def fill_back(height: list[float], ok: np.ndarray, forced: list[bool], page: float, end: int) -> list[tuple[int, int]]:
    """Pages that end at a line, filled from there to the front; in order."""
    out, j = [], end
    while j > 0:
        used, i = 0.0, j
        while i > 0 and (i == j or used + height[i - 1] <= page + 1e-9) and not (i < j and forced[i]):
            used += height[i - 1]
            i -= 1
        first = i
        while first < j - 1 and first > 0 and not ok[first]:
            first += 1
        if first and not ok[first]:
            first = i
        out.append((first, j))
        j = first
    return out[::-1]


def anchored_pages(height: list[float], ok: np.ndarray, forced: list[bool], page: float, anchor: int) -> list[tuple[int, int]]:
    """Pages of which one begins at the anchor line, or at the nearest place before it where one may."""
    while anchor > 0 and not ok[anchor]:
        anchor -= 1
    return fill_back(height, ok, forced, page, anchor) + fill_pages(height, ok, forced, page, anchor)


def paginate(lines: DataFrame, page_height: float, anchors: DataFrame | None = None) -> DataFrame:
    """(section, page, first_line, end_line, height, legal) of lines(section, line, block, line_in_block, kind, height, break_before).

    A section's lines are a unit, since every page depends on the one before.
    anchors(section, anchor), one row a section, makes a page begin there.
    """
    line = F.struct("line", "block", "line_in_block", "kind", "height", "break_before")
    rows = lines.groupBy("section").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = rows.join(anchors, "section", "left") if anchors is not None else rows.withColumn("anchor", F.lit(None).cast("int"))

    def pages(section, found: list[dict], anchor: int | None) -> Iterator[dict]:
        of = {k: [x[k] for x in found] for k in found[0]}
        size = Counter(of["block"])
        height, forced = of["height"], of["break_before"]
        ok = legal_breaks(of["kind"], of["block"], of["line_in_block"], [size[b] for b in of["block"]], forced, page_height < SMALL_PAGE)
        cut = fill_pages(height, ok, forced, page_height) if anchor is None else anchored_pages(height, ok, forced, page_height, min(anchor, len(height) - 1))
        for k, (a, b) in enumerate(cut):
            yield {"section": section, "page": k, "first_line": a, "end_line": b, "height": float(sum(height[a:b])), "legal": bool(ok[a])}

    kind = lines.schema["section"].dataType.simpleString()
    return _each(rows.select("section", "lines", F.col("anchor").cast("int")), pages, f"section {kind}, page int, first_line int, end_line int, height double, legal boolean")


def _each(rows: DataFrame, run: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Rows that run gives for each row: a unit of work comes as one row with its parts in a list."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in run(*row)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(batches_of, schema)


def place_cells(cells: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(row, ord, col, col_span, row_span) of cells(row, ord, col_span, row_span) in a table's grid.

    A cell takes the first free column of its row; spans are cut where a cell
    from above stands in the way and at the last row.
    """
    taken: set[tuple[int, int]] = set()
    last = max((r for r, *_ in cells), default=-1)
    out = []
    for row, order, cols, rows in sorted(cells):
        col = 0
        while (row, col) in taken:
            col += 1
        width = next((k for k in range(1, max(cols, 1)) if (row, col + k) in taken), max(cols, 1))
        height = min(max(rows, 1), last - row + 1)
        taken |= {(row + r, col + c) for r in range(height) for c in range(width)}
        out.append((row, order, col, width, height))
    return out


def table_grid(cells: DataFrame) -> DataFrame:
    """(table_id, row, ord, col, col_span, row_span) of cells(table_id, row, ord, col_span, row_span); a table is a unit."""

    def grid(table, found: list[dict]) -> Iterator[dict]:
        for row, order, col, cols, rows in place_cells([(c["row"], c["ord"], c["col_span"], c["row_span"]) for c in found]):
            yield {"table_id": table, "row": row, "ord": order, "col": col, "col_span": cols, "row_span": rows}

    kind = cells.schema["table_id"].dataType.simpleString()
    listed = cells.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "ord", "col_span", "row_span"))).alias("cells"))
    return _each(listed, grid, f"table_id {kind}, row int, ord int, col int, col_span int, row_span int")


def column_widths(low: list[float], high: list[float], room: float, floor: float = 0.8) -> tuple[list[float], bool]:
    """Widths of columns between their least and greatest, and whether they overflow.

    All greatest if they fit; else the least and a share of what is left in
    proportion to how much each would like; else the least times room over
    their sum, down to a floor, under which the table overflows.
    """
    least, most = sum(low), sum(high)
    if most <= room:
        return list(high), False
    if least <= room:
        spare = (room - least) / max(most - least, 1e-12)
        return [a + (b - a) * spare for a, b in zip(low, high, strict=True)], False
    scale = max(room / least, floor)
    return [a * scale for a in low], scale * least > room + 1e-9


def span_minimums(cells: list[tuple[int, int, float]], columns: int) -> list[float]:
    """Least width of each column for cells(col, span, width): single columns first, then what wider cells lack, by ascending span."""
    out = [0.0] * columns
    for col, span, width in sorted(cells, key=lambda c: (c[1], c[0])):
        span = min(span, columns - col)
        if span == 1:
            out[col] = max(out[col], width)
        elif (lack := width - sum(out[col : col + span])) > 0:
            for k in range(col, col + span):
                out[k] += lack / span
    return out


def row_heights(cells: list[tuple[int, int, float]], rows: int) -> list[float]:
    """Height of each row for cells(row, row_span, height): cells of one row first; the last row of a span grows by what is lacking, by ascending span."""
    out = [0.0] * rows
    for row, span, height in sorted(cells, key=lambda c: (c[1], c[0])):
        last = min(row + span, rows) - 1
        out[last] += max(0.0, height - sum(out[row : last + 1]))
    return out


def paginate_table(heights: list[float], groups: list[int], header: int, page: float) -> Iterator[tuple[int, int, bool]]:
    """(first row, end row, header repeated) of a table's pages: rows of one group stay together if a page can hold them."""
    head = sum(heights[:header])
    i = 0
    while i < len(heights):
        repeat = i >= header > 0 and head < page / 2
        room, j = page - (head if repeat else 0), i
        while j < len(heights):
            end = next((k for k in range(j + 1, len(heights)) if groups[k] != groups[j]), len(heights))
            need = sum(heights[j:end])
            if need > room and j > i:
                break
            if need > room:
                end = j + 1
                while end < len(heights) and groups[end] == groups[j] and sum(heights[j : end + 1]) <= room:
                    end += 1
                j = end
                break
            room, j = room - need, end
        yield i, j, repeat
        i = j
