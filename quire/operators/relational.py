"""Relational operators of a publication corpus, on any tables with the named columns.

Order is data here: every operator takes explicit ordinals, and ties end at
them, so that results don't depend on how rows are dealt out. First, last and
winning rows come from aggregates over structs, which combine before the
shuffle; windows are used within bounded buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.scratch import saved


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys (nulls are equal) the first in order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"row.{c}") for c in rows.columns))


def truncated(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each key up to a limit, and whether there were more."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > limit)
    return numbered.where(F.col("rn") <= limit).drop("rn")


def diagnostics_rollup(rows: DataFrame) -> DataFrame:
    """(code, href, seq, severity, message, n) of diagnostics(code, href, seq, severity, message).

    One row for each code and href, null href included: at the place of the
    first, with what the last says, and their count.
    """
    last = F.max_by(F.struct("severity", "message"), F.col("seq"))
    return rows.groupBy("code", "href").agg(F.min("seq").alias("seq"), last.alias("last"), F.count("*").alias("n")).select("code", "href", "seq", "last.severity", "last.message", "n")


def issue_rollup(rows: DataFrame) -> DataFrame:
    """(code, reason, key, seq, sample, discarded) of issues(code, reason, key, seq, sample, n): the first sample stays, what was discarded adds up."""
    return rows.groupBy("code", "reason", "key").agg(F.min("seq").alias("seq"), F.min_by("sample", "seq").alias("sample"), F.sum("n").alias("discarded"))


def cascade_winner(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(eid, property, value) of the winning declaration for each element(eid, id, classes, tag) and property.

    rules(kind, key, layer, attached, spec, seq, property, value) are keyed by
    their right-most selector part: id, class, tag or everything. Elements are
    met by equality on their keys only; rules are few (one book's sheets) and
    Spark broadcasts them where their size allows.
    """
    keys = [F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("tag").alias("kind"), F.col("tag").alias("key")), F.struct(F.lit("any").alias("kind"), F.lit("").alias("key"))]
    classes = F.transform("classes", lambda c: F.struct(F.lit("class").alias("kind"), c.alias("key")))
    met = elements.select("eid", F.explode(F.concat(F.array(*keys), classes)).alias("k")).select("eid", "k.kind", "k.key").join(rules, ["kind", "key"])
    return met.groupBy("eid", "property").agg(F.max_by("value", F.struct("layer", "attached", "spec", "seq")).alias("value"))


def priority_join(left: DataFrame, right: DataFrame, keys: list[Column], found: str) -> DataFrame:
    """left with the right value for the first of its candidate keys that there is; null without one.

    left has a unique ``lid``, right(key, value) unique keys. keys are tried in
    order; all are looked up in one join.
    """
    tried = left.select("lid", F.posexplode(F.array(*keys)).alias("pos", "key")).where("key is not null")
    best = tried.join(right, "key").groupBy("lid").agg(F.min_by("value", "pos").alias(found))
    return left.join(best, "lid", "left")


def fallback_chain(items: DataFrame, steps: int = 16) -> DataFrame:
    """(id, content) for every row of items(id, fallback, renderable): the first renderable item along its fallbacks.

    Null if a chain ends, comes back to an item or takes more than steps. Walks
    are doubled: one of 2n items is one of n and that of the item it led to, so
    that 16 steps take five joins. Each is written, so that none is done twice.
    A null renderable is false; id is unique.
    """

    def onward(left: DataFrame, right: DataFrame) -> DataFrame:
        then = right.select(F.col("id").alias("at"), F.col("content").alias("content_"), F.col("next").alias("next_"))
        walked = left.where("content is null and next is not null").join(then, F.col("next") == F.col("at"), "left")
        return saved(left.where("content is not null or next is null").unionByName(walked.select("id", F.col("content_").alias("content"), F.col("next_").alias("next"))))

    power = items.select("id", F.when(F.col("renderable"), F.col("id")).alias("content"), F.col("fallback").alias("next"))
    walks, left = None, steps + 1
    while left:
        if left & 1:
            walks = power if walks is None else onward(walks, power)
        left >>= 1
        if left:
            power = onward(power, power)
    return walks.select("id", "content")


def uncovered(items: DataFrame, entries: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Items that no entry covers by any of the (item column, entry column) pairs."""
    for item, entry in keys:
        covered = entries.select(F.col(entry).alias("covered")).where("covered is not null").distinct()
        items = items.join(covered, items[item] == F.col("covered"), "left_anti")
    return items


def running_sum(rows: DataFrame, group: str, order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """rows with ``out``, the sum of value over rows of the group that come before.

    order is an integer without repeats in a group; a null group is one group,
    a null order comes first. Rows are summed in buckets
    of width orders first, so that no task holds a whole group: the window over
    a group runs over its bucket sums, and that over rows inside one bucket.
    """
    bucketed = rows.withColumn("bucket_", F.floor(F.col(order) / width))
    before = Window.partitionBy(group).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy(group, "bucket_").agg(F.sum(value).alias("sum_")).select(group, "bucket_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(group, "bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("group_"), F.col("bucket_").alias("in_"), "base_")
    joined = bucketed.join(sums, F.col(group).eqNullSafe(F.col("group_")) & F.col("bucket_").eqNullSafe(F.col("in_"))).drop("in_")
    return joined.withColumn(out, F.col("base_") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("bucket_", "base_", "group_")


def last_mark(points: DataFrame, marks: DataFrame, group: str, order: str, mark: str) -> DataFrame:
    """points with the last mark of their group at or before them: an as-of join as one sorted pass."""
    both = points.withColumn("mark_", F.lit(None).cast(marks.schema[mark].dataType)).withColumn("kind_", F.lit(1))
    other = marks.select(*(F.col(c) if c in (group, order) else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns), F.col(mark).alias("mark_"), F.lit(0).alias("kind_"))
    w = Window.partitionBy(group).orderBy(order, "kind_", F.col("mark_").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn(mark, F.last("mark_", ignorenulls=True).over(w)).where("kind_ = 1").drop("mark_", "kind_")


def containing(points: DataFrame, ranges: DataFrame, group: str, width: int = 4096) -> DataFrame:
    """points(…, at) with the range(rid, lo, hi) of their group whose [lo, hi) holds them.

    Ranges are laid over buckets of width, so that the join is on equality and
    the comparison only within a bucket.
    """
    laid = ranges.where("hi > lo").withColumn("b_", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("b_", F.floor(F.col("at") / width)).join(laid, [group, "b_"]).where("at >= lo and at < hi").drop("b_")


def row_groups(rows: DataFrame, group: str, order: str, reach: str) -> DataFrame:
    """rows with ``grp``: rows join a group if they begin before something in it ends (transitively)."""
    w = Window.partitionBy(group).orderBy(order)
    fresh = F.coalesce((F.col(order) > F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    return rows.withColumn("new_", fresh).withColumn("grp", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def greedy_overlaps(rows: DataFrame, group: str) -> DataFrame:
    """(group, ord) of spans(lho, ord, size) that begin inside the last span kept, in order of lho and ord.

    A span that overlaps isn't kept and doesn't extend what is, so that this is
    a fold and no running maximum. A group is one container's directory.
    """
    spans = F.array_sort(F.collect_list(F.struct("lho", "ord", "size")))
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        hit = x["lho"] < acc["end"]
        return F.struct(F.when(hit, acc["end"]).otherwise(x["lho"] + x["size"]).alias("end"), F.when(hit, F.array_append(acc["bad"], x["ord"])).otherwise(acc["bad"]).alias("bad"))

    folded = rows.select(group, F.col("lho").cast("bigint"), F.col("ord").cast("bigint"), F.col("size").cast("bigint")).groupBy(group).agg(F.aggregate(spans, start, step).alias("a"))
    return folded.select(group, F.explode("a.bad").alias("ord"))


def run_segments(spans: DataFrame, group: str) -> DataFrame:
    """(group, lo, hi, attrs): the text between neighbouring boundaries of spans(lo, hi, attr), with the bits of all spans over it.

    A sweep: every boundary says which bits begin or end there, running counts
    of each bit tell which are on. attr has bits 0 to 30; text under no span is
    left out.
    """
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("by")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("by")))
    bits = [F.sum(F.when(F.col("attr").bitwiseAND(1 << k) != 0, F.col("by")).otherwise(0)).alias(f"d{k}") for k in range(31)]
    edges = spans.where("hi > lo").select(group, "attr", F.explode(ends).alias("e")).select(group, "attr", "e.at", "e.by").groupBy(group, "at").agg(*bits)
    w = Window.partitionBy(group).orderBy("at")
    on = [F.when(F.sum(f"d{k}").over(w) > 0, 1 << k).otherwise(0) for k in range(31)]
    attrs = on[0]
    for x in on[1:]:
        attrs = attrs.bitwiseOR(x)
    cut = edges.select(group, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), attrs.cast(spans.schema["attr"].dataType).alias("attrs"))
    return cut.where("hi is not null and attrs <> 0")


def occurrences(docs: DataFrame, query: str, *, case_sensitive: bool = True) -> DataFrame:
    """(doc_id, n) places, not overlapping, where each text holds the query; texts without one are left out."""
    text, q = (F.col("text"), query) if case_sensitive else (F.lower("text"), query.lower())
    n = ((F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / len(q)).cast("bigint")
    return docs.select("doc_id", n.alias("n")).where("n > 0")


def ratio_report(current: DataFrame, baseline: DataFrame, worse: float = 1.2, better: float = 0.8) -> DataFrame:
    """(metric, ratio, verdict) of two tables(metric, ratio): regression, improvement, ok, new or missing."""
    both = current.select("metric", F.col("ratio").alias("now")).join(baseline.select("metric", F.col("ratio").alias("was")), "metric", "full")
    r = F.col("now") / F.col("was")
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(r > worse, "regression").when(r < better, "improvement").otherwise("ok")
    return both.select("metric", r.alias("ratio"), verdict.alias("verdict"))


def median_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"))
