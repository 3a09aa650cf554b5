"""Registered relational queries over the whole of their tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import dates, href, text
from quire.operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_suppkey) AS rn FROM lineitem
) WHERE rn = 1
""")
def first_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return R.first_wins(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"]).select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT code, href, min(event_id) AS seq, arg_max(value, event_id) AS severity, arg_max(props, event_id) AS message, count(*) AS n
FROM (SELECT event_id, event_type AS code, CASE WHEN user_id % 7 <> 0 THEN 'u' || user_id END AS href, value, props FROM events) GROUP BY code, href
""")
def diagnostics_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("code"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("u"), F.col("user_id"))).alias("href"), F.col("event_id").alias("seq"), F.col("value").alias("severity"), F.col("props").alias("message"))
    return R.diagnostics_rollup(rows)


@query("""
SELECT event_type AS code, user_id % 5 AS reason, substr(props, 1, 7) AS key, min(event_id) AS seq, arg_min(props, event_id) AS sample, count(*)::BIGINT AS discarded
FROM events GROUP BY 1, 2, 3
""")
def issue_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("code"), (F.col("user_id") % 5).alias("reason"), F.substring("props", 1, 7).alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("sample"), F.lit(1).cast("bigint").alias("n"))
    return R.issue_rollup(rows)


#: Rules of the cascade query: kind and key of the selector, layer, attached, specificity, sequence, property, value.
RULES = [
    ("any", "", 0, 0, 0, 1, "display", "block"),
    ("tag", "ECONOMY", 1, 0, 1, 2, "display", "inline"),
    ("tag", "PROMO", 1, 0, 1, 3, "font-weight", "700"),
    ("class", "widget", 1, 0, 1024, 4, "display", "list-item"),
    ("class", "small", 1, 0, 1024, 5, "font-weight", "400"),
    ("class", "cold", 2, 0, 1024, 6, "font-weight", "bolder"),
    ("id", "Brand#5", 1, 0, 1048576, 7, "display", "none"),
    ("id", "Brand#13", 3, 1, 0, 8, "font-weight", "inherit"),
]


@query(f"""
WITH r(kind, key, layer, att, spec, seq, property, value) AS (VALUES {", ".join(map(str, RULES))}),
k AS (
  SELECT p_partkey, 'id' AS kind, p_brand AS key FROM part UNION ALL SELECT p_partkey, 'tag', p_type FROM part
  UNION ALL SELECT p_partkey, 'any', '' FROM part UNION ALL SELECT p_partkey, 'class', unnest(string_split(p_name, ' ')) FROM part
), m AS (SELECT k.p_partkey, r.*, row_number() OVER (PARTITION BY p_partkey, property ORDER BY layer DESC, att DESC, spec DESC, seq DESC) AS rn FROM k JOIN r USING (kind, key))
SELECT p_partkey AS eid, property, value FROM m WHERE rn = 1
""")
def cascade_winner(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "kind string, key string, layer int, attached int, spec int, seq int, property string, value string")
    p = read(spark, sf_dir, "part")
    return R.cascade_winner(p.select(F.col("p_partkey").alias("eid"), F.col("p_brand").alias("id"), F.split("p_name", " ").alias("classes"), F.col("p_type").alias("tag")), rules)


@query("""
SELECT c_custkey, coalesce(e.n_nationkey, i.n_nationkey) AS found FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey ELSE 'nation_' || c_nationkey END AS raw FROM customer) c
LEFT JOIN nation e ON e.n_name = c.raw LEFT JOIN nation i ON lower(i.n_name) = lower(c.raw)
""")
def priority_join(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("nation_"), F.col("c_nationkey")))
    left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lid"), raw.alias("raw"))
    n = read(spark, sf_dir, "nation")
    right = n.select(F.concat(F.lit("="), F.col("n_name")).alias("key"), F.col("n_nationkey").alias("value")).unionByName(n.select(F.concat(F.lit("~"), F.lower("n_name")).alias("key"), F.col("n_nationkey").alias("value")))
    found = R.priority_join(left, right, [F.concat(F.lit("="), F.col("raw")), F.concat(F.lit("~"), F.lower("raw"))], "found")
    return found.select(F.col("lid").alias("c_custkey"), "found")


@query("""
WITH RECURSIVE i AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 > 0 THEN (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) END AS next, p_size % 10 = 0 AS ok FROM part),
w AS (
  SELECT id AS start, id, ok, next, [id] AS seen, 0 AS step FROM i
  UNION ALL
  SELECT w.start, i.id, i.ok, i.next, list_append(w.seen, i.id), step + 1 FROM w JOIN i ON i.id = w.next WHERE NOT w.ok AND step < 16 AND NOT list_contains(w.seen, i.id)
)
SELECT start AS id, min(CASE WHEN ok THEN id END) AS content FROM w GROUP BY start
""")
def fallback_chain(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    n = p.count()
    items = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 > 0, (F.col("p_partkey") * 7 + F.col("p_size")) % n).alias("fallback"), (F.col("p_size") % 10 == 0).alias("renderable"))
    return R.fallback_chain(items)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def toc_orphans(spark, sf_dir):
    entries = read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("item"), F.lit(None).cast("int").alias("content"))
    other = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.lit(None).cast("bigint").alias("item"), F.col("s_nationkey").alias("content"))
    return R.uncovered(read(spark, sf_dir, "customer"), entries.unionByName(other), [("c_custkey", "item"), ("c_nationkey", "content")]).select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, 1 + coalesce(max(CASE WHEN o_totalprice > 200000 THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS slot FROM orders
""")
def orphan_slot(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    root = F.max(F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey"))).over(w)
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.coalesce(root, F.lit(-1)) + 1).alias("slot"))


@query("""
SELECT e.event_id, m.event_id AS mark FROM (SELECT * FROM events WHERE event_type <> 'signup') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) m ON e.user_id = m.user_id AND e.ts >= m.ts
""")
def page_mark_asof(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    points = e.where("event_type <> 'signup'").select("user_id", "ts", "event_id")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("mark"))
    return R.last_mark(points, marks, "user_id", "ts", "mark").select("event_id", "mark")


@query("""
SELECT source, doc_id, (sum(n_chars) OVER w)::BIGINT AS before, n_chars,
  CASE WHEN sum(n_chars) OVER p > 0 THEN sum(n_chars) OVER w / sum(n_chars) OVER p END AS progress
FROM (SELECT source, doc_id, length(coalesce(text, '')) AS n_chars FROM documents)
WINDOW p AS (PARTITION BY source), w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)
""".replace("(sum(n_chars) OVER w)::BIGINT AS before", "coalesce(sum(n_chars) OVER w, 0)::BIGINT AS before").replace("sum(n_chars) OVER w / sum", "coalesce(sum(n_chars) OVER w, 0) / sum"))
def progress(spark, sf_dir):
    d = _sized(spark, sf_dir)
    total = d.groupBy(F.col("source").alias("of")).agg(F.sum("n_chars").alias("total"))
    return R.running_sum(d, "source", "doc_id", "n_chars", "before").join(total, F.col("source").eqNullSafe(F.col("of"))).select("source", "doc_id", "before", "n_chars", F.when(F.col("total") > 0, F.col("before") / F.col("total")).alias("progress"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))


@query("""
SELECT doc_id, 1 + coalesce(sum(blocks) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position, blocks::BIGINT AS blocks
FROM (SELECT source, doc_id, greatest(1, ceil(length(coalesce(text, '')) / 1024)) AS blocks FROM documents)
""")
def readium_position(spark, sf_dir):
    d = _sized(spark, sf_dir).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1024)).cast("bigint"))
    return R.running_sum(d, "source", "doc_id", "blocks", "before").select("doc_id", (F.col("before") + 1).cast("bigint").alias("position"), "blocks")


@query("""
WITH r AS (SELECT source, doc_id AS rid, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo, n FROM (SELECT source, doc_id, length(coalesce(text, '')) AS n FROM documents)),
p AS (SELECT event_id, 'src' || (user_id % 20) AS source, (event_id * 37) % 60000 AS pos FROM events)
SELECT event_id, rid FROM p JOIN r USING (source) WHERE pos >= lo AND pos < lo + n
""")
def page_of_offset(spark, sf_dir):
    ranges = R.running_sum(_sized(spark, sf_dir), "source", "doc_id", "n_chars", "lo").select("source", F.col("doc_id").alias("rid"), "lo", (F.col("lo") + F.col("n_chars")).alias("hi"))
    points = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), ((F.col("event_id") * 37) % 60000).alias("at"))
    return R.containing(points, ranges, "source").select("event_id", "rid")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber * 10 + l_suppkey % 7 AS lo, l_linenumber * 10 + l_suppkey % 7 + l_quantity::INT AS hi, l_partkey FROM lineitem),
d AS (SELECT l_orderkey, lo, max(hi) AS hi FROM s GROUP BY ALL),
n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM d)
SELECT l_orderkey, lo, hi, (sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY lo ROWS UNBOUNDED PRECEDING))::BIGINT AS grp FROM n
""")
def row_groups(spark, sf_dir):
    lo = (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7).alias("lo")
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", lo, (lo + F.col("l_quantity").cast("int")).alias("hi")).groupBy("l_orderkey", "lo").agg(F.max("hi").alias("hi"))
    return R.row_groups(spans, "l_orderkey", "lo", "hi")


@query("""
WITH RECURSIVE s AS (
  SELECT l_orderkey AS g, l_linenumber * 8 + l_suppkey % 9 AS lho, l_partkey * 100 + l_linenumber AS ord, max(l_quantity)::BIGINT AS size FROM lineitem GROUP BY ALL
), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lho, ord) AS i FROM s),
f AS (
  SELECT g, i, ord, false AS bad, lho + size AS e FROM n WHERE i = 1
  UNION ALL
  SELECT n.g, n.i, n.ord, n.lho < f.e, CASE WHEN n.lho < f.e THEN f.e ELSE n.lho + n.size END FROM f JOIN n ON n.g = f.g AND n.i = f.i + 1
)
SELECT g, ord FROM f WHERE bad
""")
def overlap_greedy(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 8 + F.col("l_suppkey") % 9).alias("lho"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return R.greedy_overlaps(s.agg(F.max("l_quantity").cast("bigint").alias("size")), "g")


@query("""
WITH s AS (SELECT conv_id, turn * 3 AS lo, turn * 3 + 1 + length(text) % 9 AS hi, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 4 END AS attr FROM conversations),
b AS (SELECT DISTINCT conv_id, unnest([lo, hi]) AS lo FROM s), c AS (SELECT conv_id, lo, lead(lo) OVER (PARTITION BY conv_id ORDER BY lo) AS hi FROM b)
SELECT c.conv_id, c.lo, c.hi, bit_or(s.attr)::INT AS attrs FROM c JOIN s ON s.conv_id = c.conv_id AND s.lo <= c.lo AND s.hi >= c.hi GROUP BY ALL
""")
def run_segments(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    attr = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(4)
    return R.run_segments(c.select("conv_id", (F.col("turn") * 3).alias("lo"), (F.col("turn") * 3 + 1 + F.length("text") % 9).alias("hi"), attr.alias("attr")), "conv_id")


@query(r"""
SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir,
  CASE WHEN contains(url, '#') THEN nullif(regexp_extract(url, '#(.*)$', 1), '') END AS fragment,
  regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*:') AS scheme, regexp_matches(lower(trim(url)), '^https?:') AS remote,
  regexp_matches(regexp_replace(trim(url), '[#?].*$', ''), '[/\\]$') AS directory
FROM pages
""")
def href_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", href.dirname_col(u).alias("dir"), href.fragment_col(u).alias("fragment"), href.has_scheme_col(u).alias("scheme"), href.is_remote_col(u).alias("remote"), href.points_to_directory_col(u).alias("directory"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g')) AS collapsed FROM documents")
def ws_collapse(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse_html_col(F.col("text")), 256).alias("collapsed"))


@query("""
SELECT s_suppkey, lower(trim(split_part(m, ';', 1))) AS media, CASE WHEN lower(trim(split_part(m, ';', 1))) IN ('application/xhtml+xml', 'text/html', 'text/x-oeb1-document') THEN 'xhtml'
  WHEN lower(trim(split_part(m, ';', 1))) LIKE 'image/%' THEN 'image' ELSE 'unsupported' END AS kind
FROM (SELECT s_suppkey, ['Application/XHTML+xml; charset=utf-8', ' text/HTML ', 'image/PNG', 'font/woff2;x', 'text/css'][s_suppkey % 5 + 1] AS m FROM supplier)
""")
def media_type_norm(spark, sf_dir):
    m = F.element_at(F.array(*map(F.lit, ["Application/XHTML+xml; charset=utf-8", " text/HTML ", "image/PNG", "font/woff2;x", "text/css"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", text.media_type_col(m).alias("media"))
    return rows.select("s_suppkey", "media", text.section_kind_col(F.col("media")).alias("kind"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents WHERE contains(text, 'the')")
def find_all(spark, sf_dir):
    return R.occurrences(read(spark, sf_dir, "documents"), "the")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*href=\"[^\"]*\"'))::BIGINT AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_links(spark, sf_dir):
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_count(h, F.lit(r'<a\s[^>]*href="[^"]*"')).cast("bigint").alias("links"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"))


#: Dates of every form, good and bad, that orders are dealt.
DATES = ["1997", "1997-02", "1996-02-29", "1997-02-29", "1997-13-01", "2001-05-06T07:08Z", "2001-05-06T07:08:09.1239-03:30", "2001-05-06T23:59:59+14:00", "2001-05-06T23:59:59+14:01", "2001-05-06T24:00Z", "0000-01-01", " 2010-10-10 ", "10/10/2010", "2001-05-06T07:08:60Z"]


@query(rf"""
WITH s AS (SELECT o_orderkey, trim({DATES!r}[o_orderkey % {len(DATES)} + 1]) AS t FROM orders),
p AS (SELECT o_orderkey, t, regexp_extract(t, '^(\d{{4}})(-(\d{{2}})(-(\d{{2}})(T(\d{{2}}):(\d{{2}})(:(\d{{2}})(\.(\d+))?)?(Z|[+-]\d{{2}}:\d{{2}})?)?)?)?$', ['y', 'a', 'm', 'b', 'd', 'c', 'h', 'n', 'e', 's', 'f', 'x', 'z']) AS g FROM s),
q AS (SELECT o_orderkey, g, CASE WHEN g.z IN ('', 'Z') THEN 0 ELSE (CASE WHEN g.z LIKE '-%' THEN 1 ELSE -1 END) * (substr(g.z, 2, 2)::INT * 60 + substr(g.z, 5, 2)::INT) END AS shift,
  try_cast(g.y || '-' || coalesce(nullif(g.m, ''), '01') || '-' || coalesce(nullif(g.d, ''), '01') AS DATE) AS day FROM p WHERE g.y <> '')
SELECT o_orderkey, CASE WHEN day IS NOT NULL AND abs(shift) <= 840 AND coalesce(try_cast(nullif(g.h, '') AS INT), 0) <= 23 AND coalesce(try_cast(nullif(g.s, '') AS INT), 0) <= 59 THEN
  epoch_ms(day::TIMESTAMP) + (coalesce(try_cast(nullif(g.h, '') AS BIGINT), 0) * 60 + coalesce(try_cast(nullif(g.n, '') AS BIGINT), 0) + shift) * 60000
  + coalesce(try_cast(nullif(g.s, '') AS BIGINT), 0) * 1000 + CASE WHEN g.x = '' THEN 0 ELSE substr(g.x || '000', 1, 3)::BIGINT END END AS ms
FROM s LEFT JOIN q USING (o_orderkey)
""")
def pub_date(spark, sf_dir):
    t = F.element_at(F.array(*map(F.lit, DATES)), (F.col("o_orderkey") % len(DATES) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(dates.publication_date(t)).alias("ms"))


@query("""
WITH a AS (SELECT l_returnflag || l_linestatus AS metric, quantile_cont(l_extendedprice, 0.5) AS r FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1),
b AS (SELECT l_returnflag || l_linestatus AS metric, quantile_cont(l_extendedprice, 0.5) AS r FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag <> 'R' GROUP BY 1)
SELECT metric, a.r / b.r AS ratio, CASE WHEN b.r IS NULL THEN 'new' WHEN a.r IS NULL THEN 'missing' WHEN a.r / b.r > 1.2 THEN 'regression' WHEN a.r / b.r < 0.8 THEN 'improvement' ELSE 'ok' END AS verdict
FROM a FULL JOIN b USING (metric)
""")
def ratio_report(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("metric", F.concat("l_returnflag", "l_linestatus"))
    now = R.median_by(rows.where("l_linenumber % 2 = 0"), "metric", "l_extendedprice").withColumnRenamed("median", "ratio")
    was = R.median_by(rows.where("l_linenumber % 2 = 1 and l_returnflag <> 'R'"), "metric", "l_extendedprice").withColumnRenamed("median", "ratio")
    return R.ratio_report(now, was)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) > 3 AS truncated FROM lineitem) WHERE rn <= 3
""")
def hard_limit(spark, sf_dir):
    return R.truncated(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_partkey", "truncated")


@query("SELECT p_partkey, list_distinct(list_filter(string_split_regex(p_name || ' ' || p_type || '  ' || p_name, '\\s+'), lambda t: t <> '')).list_sort()::VARCHAR AS tokens, translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM part")
def token_sets(spark, sf_dir):
    joined = F.concat("p_name", F.lit(" "), "p_type", F.lit("  "), "p_name")
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(text.tokens_col(joined)), ", "), F.lit("]"))
    return read(spark, sf_dir, "part").select("p_partkey", listed.alias("tokens"), text.ascii_lower_col(F.col("p_type")).alias("lowered"))
