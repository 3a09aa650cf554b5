import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import layout as L
from quire.operators import locator as P

BLOCK = st.tuples(st.sampled_from(["paragraph", "heading", "sceneBreak"]), st.integers(1, 8), st.booleans())


def lines(blocks):
    kind, block, at, size, forced = [], [], [], [], []
    for b, (k, n, brk) in enumerate(blocks):
        n = n if k == "paragraph" else 1
        for i in range(n):
            kind.append(k)
            block.append(b)
            at.append(i)
            size.append(n)
            forced.append(brk and i == 0 and b > 0)
    return kind, block, at, size, forced


@settings(max_examples=300, deadline=None)
@given(st.lists(BLOCK, min_size=1, max_size=20), st.integers(6, 14), st.data())
def test_pages(blocks, page, data):
    kind, block, at, size, forced = lines(blocks)
    ok = L.legal_breaks(kind, block, at, size, forced)
    height = [1.0] * len(kind)
    anchor = data.draw(st.integers(0, len(kind) - 1))
    for cut in (L.fill_pages(height, ok, forced, page), L.anchored_pages(height, ok, forced, page, anchor)):
        assert [a for a, _ in cut] == [0, *(b for _, b in cut[:-1])] and cut[-1][1] == len(kind)
        for a, b in cut:
            assert 0 < b - a <= page
            assert not any(forced[a + 1 : b])
    for i in range(1, len(kind)):
        if ok[i] and not forced[i] and block[i] == block[i - 1]:
            assert at[i] >= 2 and size[i] - at[i] >= 2
        if not forced[i] and kind[i - 1] == "heading":
            assert not ok[i]


def test_paginate(spark):
    rows = [(s, i, i // 5, i % 5, "paragraph", 1.0, False) for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "section int, line int, block int, line_in_block int, kind string, height double, break_before boolean")
    got = L.paginate(df, 12.0).orderBy("section", "page").collect()
    assert sum(r.end_line - r.first_line for r in got) == 80 and all(r.height <= 12 and r.legal for r in got)
    anchors = spark.createDataFrame([(1, 17)], "section int, anchor int")
    assert 17 in {r.first_line for r in L.paginate(df, 12.0, anchors).where("section = 1").collect()}


def test_grid(spark):
    cells = [(0, 0, 2, 1), (0, 1, 1, 3), (1, 0, 1, 1), (1, 1, 3, 1), (2, 0, 1, 9)]
    placed = L.place_cells(cells)
    assert placed == [(0, 0, 0, 2, 1), (0, 1, 2, 1, 3), (1, 0, 0, 1, 1), (1, 1, 1, 1, 1), (2, 0, 0, 1, 1)]
    df = spark.createDataFrame([("t", *c) for c in cells], "table_id string, row int, ord int, col_span int, row_span int")
    assert sorted(tuple(r)[1:] for r in L.table_grid(df).collect()) == placed
    rng = random.Random(1)
    for _ in range(200):
        placed = L.place_cells([(r, o, rng.randint(1, 4), rng.randint(1, 4)) for r in range(rng.randint(1, 6)) for o in range(rng.randint(0, 5))])
        spots = [(r + y, c + x) for r, _, c, w, h in placed for x in range(w) for y in range(h)]
        assert len(spots) == len(set(spots))


def test_columns():
    assert L.column_widths([1, 1], [2, 4], 10) == ([2, 4], False)
    assert L.column_widths([1, 1], [3, 5], 4) == ([1 + 2 / 3, 1 + 4 / 3], False)
    got, over = L.column_widths([4, 4], [9, 9], 4)
    assert np.allclose(got, [3.2, 3.2]) and over
    assert L.span_minimums([(0, 1, 2.0), (0, 2, 6.0), (1, 1, 1.0)], 2) == [3.5, 2.5]
    assert list(L.paginate_table([1] * 10, list(range(10)), 1, 4)) == [(0, 4, False), (4, 7, True), (7, 10, True)]
    assert [(a, b) for a, b, _ in L.paginate_table([1] * 6, [0, 0, 0, 1, 1, 1], 0, 4)] == [(0, 3), (3, 6)]


def test_locators(spark):
    blocks = spark.createDataFrame([(1, 1, "world wide"), (1, 0, "hello"), (2, 0, "x")], "sec int, ord int, text string")
    assert {r.sec: (r.text, r.total_chars) for r in P.canonical_text(blocks, ["sec"]).collect()} == {1: ("hello\nworld wide\n", 17), 2: ("x\n", 2)}
    assert {(r.sec, r.ord): (r.start, r.end) for r in P.block_offsets(blocks, ["sec"]).collect()} == {(1, 0): (0, 5), (1, 1): (6, 16), (2, 0): (0, 1)}
    texts = spark.createDataFrame([("a", "One two one"), ("b", None), ("c", "ONEone")], "key string, text string")
    assert sorted((r.key, r.at) for r in P.find_all(texts, "one", case_sensitive=False).collect()) == [("a", 0), ("a", 8), ("c", 0), ("c", 3)]
    r = P.find_all(texts, "two").first()
    assert '"before":"One "' in r.locator and '"highlight":"two"' in r.locator and '"after":" one"' in r.locator


def test_repair():
    text = "aaaa the quick fox bbbb the quick fox cccc"
    assert P.repair(text, 5, "aaaa ", "the quick fox", " bbbb") == (5, 1.0)
    assert P.repair("zz" + text, 5, "aaaa ", "the quick fox", " bbbb") == (7, 0.9)
    assert P.repair(text, 30, "bbbb ", "the quick fox", " zzzz") == (24, 0.7)
    assert P.repair(text, 23, "zz", "the quick fox", "yy") == (24, 0.5)
    assert P.repair(text, 7, "bbbb ", "gone", "yy") == (24, 0.3)
    assert P.repair("q", 99, "z", "y", "x") == (1, 0.0)


@settings(max_examples=200, deadline=None)
@given(st.text("aßﬁbé ", max_size=30), st.sets(st.integers(0, 29)), st.booleans())
def test_display_map(text, hyphens, upper):
    shown, changes = P.display_text(text, upper, tuple(h for h in hyphens if h < len(text)))
    for i in range(len(text)):
        assert P.to_canonical(changes, P.to_display(changes, i)) == i
    if upper:
        assert shown.replace("­", "") == "".join(c.upper() for c in text)


def test_row_heights():
    assert L.row_heights([(0, 1, 2.0), (1, 1, 1.0), (0, 2, 5.0), (1, 9, 1.0)], 2) == [2.0, 3.0]
