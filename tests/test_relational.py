import random

from pyspark.sql import functions as F

from quire.operators import relational as R


def test_greedy_overlap_is_no_running_maximum(spark):
    rows = spark.createDataFrame([("z", 0, 0, 100), ("z", 50, 1, 450), ("z", 200, 2, 100), ("z", 250, 3, 10)], "g string, lho long, ord long, size long")
    assert {r.ord for r in R.greedy_overlaps(rows, "g").collect()} == {1, 3}


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in rng.sample(range(500), 120)]
    got = R.running_sum(spark.createDataFrame(rows, "g string, i long, v long"), "g", "i", "v", "before", width=16).collect()
    assert len(got) == len(rows)
    assert all(r.before == sum(v for g, i, v in rows if g == r.g and i < r.i) for r in got)


def test_containing(spark):
    ranges = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 10), ("a", 3, 10, 5000), ("b", 4, 0, 3)], "g string, rid long, lo long, hi long")
    points = spark.createDataFrame([("a", 0), ("a", 9), ("a", 10), ("a", 4999), ("a", 5000), ("b", 3)], "g string, at long")
    assert {(r.g, r.at): r.rid for r in R.containing(points, ranges, "g", width=64).collect()} == {("a", 0): 1, ("a", 9): 1, ("a", 10): 3, ("a", 4999): 3}


def test_fallback_chain(spark):
    items = spark.createDataFrame([("a", "b", False), ("b", "a", False), ("c", "d", False), ("d", None, True), ("e", "x", False), ("f", None, True), ("g", "c", None)], "id string, fallback string, renderable boolean")
    assert {r.id: r.content for r in R.fallback_chain(items).collect()} == {"a": None, "b": None, "c": "d", "d": "d", "e": None, "f": "f", "g": "d"}
    chain = spark.range(20).select("id", (F.col("id") + 1).alias("fallback"), (F.col("id") == 19).alias("renderable"))
    assert {r.id: r.content for r in R.fallback_chain(chain).collect()} == {i: 19 if i >= 3 else None for i in range(20)}


def test_fallback_chain_of_many_items(spark):
    items = spark.range(2_000_000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") - 1).alias("fallback"), (F.col("id") % 4 == 0).alias("renderable"))
    assert R.fallback_chain(items).where("content = id - id % 4").count() == 2_000_000


def test_running_sum_keeps_null_groups(spark):
    rows = [("a", 1, 5), (None, 2, 7), (None, 9, 1), ("a", None, 3)]
    got = R.running_sum(spark.createDataFrame(rows, "g string, i long, v long"), "g", "i", "v", "before", width=4).collect()
    assert {(r.g, r.i): r.before for r in got} == {("a", None): 0, ("a", 1): 3, (None, 2): 0, (None, 9): 7}


def test_segments_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, lo := rng.randint(0, 40), lo + rng.randint(0, 15), 1 << rng.randint(0, 4)) for g in "abc" for _ in range(12)]
    got = {(r.g, r.lo, r.hi): r.attrs for r in R.run_segments(spark.createDataFrame(rows, "g string, lo int, hi int, attr int"), "g").collect()}
    for g in "abc":
        own = [r for r in rows if r[0] == g and r[2] > r[1]]
        cuts = sorted({x for r in own for x in r[1:3]})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            attrs = 0
            for _, a, b, bit in own:
                attrs |= bit if a <= lo and b >= hi else 0
            assert got.get((g, lo, hi), 0) == attrs


def test_rollups(spark):
    d = spark.createDataFrame([("x", None, 1, "info", "first"), ("x", None, 3, "warning", "last"), ("x", "h", 2, "info", "only")], "code string, href string, seq int, severity string, message string")
    assert {(r.href, r.seq, r.severity, r.message, r.n) for r in R.diagnostics_rollup(d).collect()} == {(None, 1, "warning", "last", 2), ("h", 2, "info", "only", 1)}


def test_row_groups_and_segments(spark):
    rows = spark.createDataFrame([("t", 0, 2), ("t", 1, 1), ("t", 3, 3), ("t", 4, 6), ("t", 5, 5)], "t string, r int, reach int")
    assert [r.grp for r in R.row_groups(rows, "t", "r", "reach").orderBy("r").collect()] == [1, 1, 2, 3, 3]
    spans = spark.createDataFrame([(1, 0, 10, 1), (1, 4, 6, 2)], "b int, lo int, hi int, attr int")
    assert {(r.lo, r.hi, r.attrs) for r in R.run_segments(spans, "b").collect()} == {(0, 4, 1), (4, 6, 3), (6, 10, 1)}


def test_occurrences_and_reports(spark):
    docs = spark.createDataFrame([(1, "The the THE"), (2, "x"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.n) for r in R.occurrences(docs, "the").collect()] == [(1, 1)]
    assert [(r.doc_id, r.n) for r in R.occurrences(docs, "the", case_sensitive=False).collect()] == [(1, 3)]
    now, was = (spark.createDataFrame(x, "metric string, ratio double") for x in ([("a", 1.3), ("b", 0.7), ("c", 1.0), ("d", 1.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0), ("e", 1.0)]))
    assert {r.metric: r.verdict for r in R.ratio_report(now, was).collect()} == {"a": "regression", "b": "improvement", "c": "ok", "d": "new", "e": "missing"}


def test_first_wins_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 5, "c")], "k string, o int, v string")
    assert {(r.k, r.v) for r in R.first_wins(rows, ["k"], ["o"]).collect()} == {(None, "a"), ("k", "c")}
    assert R.truncated(rows, ["k"], [F.col("o")], 1).where("truncated").count() == 1
