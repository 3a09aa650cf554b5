"""Registered queries over styles, layout and places in texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import style_columns
from quire.operators import cascade, layout, locator
from quire.sources import books as B

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def css_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the pages' style elements; each distinct sheet is parsed once and joined back."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<style>([^<]*)</style>"), 1)).alias("ord", "css"))
    distinct = pages.groupBy("css").agg(F.min("page_id").alias("key"))
    rules = cascade.sheet_rules(distinct.select("key", "css")).join(distinct, "key").select("css", "property", "value", "bucket", "specificity")
    return pages.join(rules, "css").select("page_id", F.col("ord").cast("bigint").alias("sheet"), "property", "value", "bucket", "specificity")


def css_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page's elements: how many there are and what the cascade made of them."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "html")
    s = cascade.computed_styles(pages)
    return s.groupBy(F.col("key").alias("page_id")).agg(
        F.count_if(F.col("tag") == "p").alias("paragraphs"),
        F.count_if((F.col("tag") == "p") & (F.col("margin_top") == 0) & (F.col("display") == "block") & (F.col("origins")["margin-top"] == "author")).alias("styled"),
        F.count_if((F.col("tag") == "h1") & F.col("bold") & (F.col("font_size") == "larger")).alias("headings"),
        F.count_if((F.col("tag") == "li") & (F.col("display") == "list-item") & (F.col("list_style_type") == "disc")).alias("items"),
    )


def style_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct styles of all elements, and how many elements have each."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "html")
    s = cascade.computed_styles(pages)
    return s.groupBy("display", "white_space", "text_align", "font_style", "bold", "font_size", "list_style_type", "underline", "margin_top", "margin_left", "padding_left").agg(F.count("*").alias("elements"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as measured lines: a paragraph for each line of text, 60 characters a line; a short line alone is a heading."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block", "t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / 60)).cast("int")
    kind = F.when(F.length("t") < 12, "heading").otherwise("paragraph")
    return d.select("section", "block", kind.alias("kind"), F.explode(F.sequence(F.lit(0), n - 1)).alias("line_in_block")).select("section", (F.col("block") * F.lit(1 << 32) + F.col("line_in_block")).alias("line"), "block", "line_in_block", "kind", F.lit(1.0).alias("height"), F.lit(False).alias("break_before"))


def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paginate(_lines(spark, sf_dir), 30.0).select("section", "page", "first_line", "end_line")


def pagination_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is on one page, and no page holds more than it can."""
    return layout.paginate(_lines(spark, sf_dir), 30.0).groupBy("section").agg(F.sum(F.col("end_line") - F.col("first_line")).cast("bigint").alias("lines"), (F.max("height") <= 30).alias("fits"))


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as cells of a table: rows of return flags, spans of quantities."""
    cells = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    c = cells.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") % 3).cast("int").alias("row"), F.col("l_linenumber").alias("ord"), (F.col("q") % 3 + 1).cast("int").alias("col_span"), (F.col("p") % 3 + 1).cast("int").alias("row_span"))
    return layout.table_grid(c)


def canonical_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every paragraph in its document's canonical text."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return locator.block_offsets(d, ["doc_id"]).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "start", "end")


def search_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the texts hold a word, with what stands around it."""
    found = locator.find_all(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), "stupid")
    return found.select(F.col("key").alias("doc_id"), "at", F.get_json_object("locator", "$.text.before").alias("before"), F.get_json_object("locator", "$.text.after").alias("after"))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_blocks(_read(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def style_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style arithmetic over all line items: quantities as lengths and weights, flags as keywords."""
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    unit = F.element_at(F.array(*map(F.lit, ["px", "em", "%", "pt", "vw", ""])), (F.col("l_linenumber") % 6 + 1).cast("int"))
    em = style_columns.em_length(q, unit, 0.3)
    weight = style_columns.relative_weight(q * 20, F.when(flag == "A", "bolder").when(flag == "N", "lighter").otherwise("normal"))
    align = style_columns.text_align(F.when(flag == "A", "left").when(flag == "N", "right").otherwise("center"), F.when(F.col("l_linestatus") == "O", "ltr").otherwise("rtl"))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", style_columns.clamped(em, -4.0, 8.0).alias("indent"), weight.alias("weight"), align.alias("align"), style_columns.font_size_step(q / 25).alias("step"))
    return rows.groupBy("align", "weight", "step", F.round("indent", 6).alias("indent")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (css_rules, css_computed, style_scalars, style_dictionary, pagination, pagination_coverage, table_grid, canonical_offsets, search_locators, block_kinds)}

_SPLIT = "string_split(coalesce(text, ''), chr(10))"
ORACLES: dict[str, str] = {
    "style_scalars": """
WITH r AS (
  SELECT l_orderkey, l_quantity AS q, l_returnflag AS f, l_linestatus AS s, ['px', 'em', '%', 'pt', 'vw', ''][l_linenumber % 6 + 1] AS u, l_quantity * 20 AS w FROM lineitem
), v AS (
  SELECT l_orderkey, CASE u WHEN 'px' THEN q / 16 WHEN 'em' THEN q WHEN '%' THEN q * 0.3::DOUBLE WHEN 'pt' THEN q / 12 END AS em,
    CASE f WHEN 'A' THEN CASE WHEN w < 350 THEN 400 WHEN w < 550 THEN 700 ELSE greatest(900, w) END WHEN 'N' THEN CASE WHEN w < 100 THEN w WHEN w < 550 THEN 100 WHEN w < 750 THEN 400 ELSE 700 END ELSE w END::DOUBLE AS weight,
    CASE WHEN f NOT IN ('A', 'N') THEN 'center' WHEN (f = 'A') = (s = 'O') THEN 'start' ELSE 'end' END AS align,
    CASE WHEN q / 25 < 0.95 THEN 'smaller' WHEN q / 25 > 1.05 THEN 'larger' ELSE 'same' END AS step
  FROM r)
SELECT align, weight, step, round(CASE WHEN em IS NOT NULL THEN greatest(-4, least(8, em)) END, 6)::DOUBLE AS indent, count(*) AS n, min(l_orderkey) AS first FROM v GROUP BY ALL
""",
    "css_rules": "SELECT page_id, unnest(range(n)) AS sheet, 'margin-' || side AS property, 'em 0.0' AS value, 'tag:p' AS bucket, 1::BIGINT AS specificity FROM (SELECT page_id, len(regexp_extract_all(html, '<style>p\\{margin:0\\}</style>')) AS n, unnest(['top', 'right', 'bottom', 'left']) AS side FROM pages)",
    "css_computed": "SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, len(regexp_extract_all(html, '<p>'))::BIGINT AS styled, len(regexp_extract_all(html, '<h1>'))::BIGINT AS headings, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages",
    "pagination_coverage": f"SELECT doc_id AS section, sum(greatest(1, ceil(length(t) / 60)))::BIGINT AS lines, true AS fits FROM (SELECT doc_id, unnest({_SPLIT}) AS t FROM documents) GROUP BY doc_id",
    "pagination": f"""
WITH RECURSIVE b AS (
  SELECT doc_id AS section, block, greatest(1, ceil(length(t) / 60))::INT AS n, length(t) < 12 AS heading
  FROM (SELECT doc_id, unnest({_SPLIT}) AS t, unnest(range(len({_SPLIT}))) AS block FROM documents)
), s AS (
  SELECT *, (sum(n) OVER w)::INT - n AS first, lag(heading, 1, false) OVER (PARTITION BY section ORDER BY block) AS after FROM b WINDOW w AS (PARTITION BY section ORDER BY block)
), l AS (
  SELECT section, first + i AS line, CASE WHEN i = 0 THEN NOT after ELSE NOT heading AND i >= 2 AND n - i >= 2 END AS ok
  FROM (SELECT *, unnest(range(n))::INT AS i FROM s)
), k AS (
  SELECT section, line, max(CASE WHEN ok THEN line END) OVER (PARTITION BY section ORDER BY line) AS legal FROM l
), e AS (SELECT section, sum(n)::INT AS lines FROM b GROUP BY section),
p AS (
  SELECT section, -1 AS page, 0 AS first_line, 0 AS end_line FROM e
  UNION ALL
  SELECT p.section, page + 1, end_line, CASE WHEN end_line + 30 >= lines THEN lines WHEN k.legal > end_line THEN k.legal ELSE end_line + 30 END
  FROM p JOIN e USING (section) LEFT JOIN k ON k.section = p.section AND k.line = p.end_line + 30 WHERE end_line < lines
)
SELECT section, page, first_line, end_line FROM p WHERE page >= 0
""",
    "table_grid": """
WITH RECURSIVE c AS (
  SELECT l_orderkey AS table_id, l_linenumber % 3 AS r, l_linenumber AS o, (max(l_quantity)::INT % 3 + 1)::INT AS w, (max(l_partkey) % 3 + 1)::INT AS h FROM lineitem GROUP BY ALL
), n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY r, o) AS k, max(r) OVER (PARTITION BY table_id) AS last FROM c),
g AS (
  SELECT table_id, 0::BIGINT AS k, []::INT[] AS taken, NULL::INT AS r, NULL::INT AS o, NULL::INT AS col, NULL::INT AS w, NULL::INT AS h FROM (SELECT DISTINCT table_id FROM c)
  UNION ALL
  SELECT table_id, k, list_concat(taken, flatten(list_transform(range(h), lambda y: list_transform(range(w), lambda x: ((r + y) * 1000 + col + x)::INT)))), r, o, col, w, h
  FROM (
    SELECT table_id, k, taken, r, o, col, least(h, last - r + 1)::INT AS h,
      coalesce(list_filter(range(1, w), lambda x: list_contains(taken, (r * 1000 + col + x)::INT))[1], w)::INT AS w
    FROM (
      SELECT g.table_id, n.k, taken, n.r, n.o, n.h, n.w, last, list_filter(range(100), lambda x: NOT list_contains(taken, (n.r * 1000 + x)::INT))[1] AS col
      FROM g JOIN n ON n.table_id = g.table_id AND n.k = g.k + 1
    )
  )
)
SELECT table_id, r::INT AS "row", o AS ord, col::INT AS col, w AS col_span, h AS row_span FROM g WHERE k > 0
""",
    "canonical_offsets": f"""
SELECT doc_id, ord, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  (coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t))::BIGINT AS "end"
FROM (SELECT doc_id, unnest({_SPLIT}) AS t, unnest(range(len({_SPLIT}))) AS ord FROM documents)
""",
    "search_locators": """
SELECT doc_id, pos AS "at", substr(text, greatest(pos - 32, 0) + 1, pos - greatest(pos - 32, 0)) AS before, substr(text, pos + 7, 32) AS after FROM (
  SELECT doc_id, text, (sum(length(p) + 6) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT - 6 AS pos, k, n
  FROM (SELECT doc_id, text, unnest(string_split(text, 'stupid')) AS p, unnest(range(len(string_split(text, 'stupid')))) AS k, len(string_split(text, 'stupid')) AS n FROM documents WHERE contains(text, 'stupid')))
WHERE k < n - 1
""",
}
