import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.suffixes import SuffixOrder, repeated_bytes, without_repeats
from quire.llm.windows import repeated_windows

SCHEMA = "doc_id long, text string, chunk int, id int, n int, mail int"


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["wé", "ab", "c", "dog", "x" * 9, "ü", "zz"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))
    passages = [say(60) for _ in range(6)]
    texts = [say(rng.randint(0, 80)) for _ in range(25)]
    for _ in range(60):
        t = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a : a + rng.randint(60, 300)] + say(rng.randint(0, 30))
        texts.append(t)
    texts += [texts[30]] * 12 + [texts[40] + "!", "!" + texts[40], None, "", "a" * 700, "ab" * 400, "a" * 99, "a" * 100, "q" * 5000, passages[0] * 3]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[3], rows[10], (None, texts[40]), (None, texts[31])]
    return rows


def brute_bytes(rows, length):
    big = 1 << 60
    docs = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for (i, _), (order, b) in zip(rows, docs, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (order, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, width):
    big = 1 << 60
    docs = [(big if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), (order, w) in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < order:
                gone[s : s + width] = [True] * width
        out.append((-1 if i is None else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_bytes(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    want = brute_bytes(rows, 100)
    for shard_keys, chunk_bytes, hot in ((1 << 21, 2 << 20, 50_000), (40, 3000, 50_000), (40, 3000, 2), (1 << 21, 3000, 5)):
        got = repeated_bytes(df.repartition(3), Scratch(spark, "t"), shard_keys=shard_keys, chunk_bytes=chunk_bytes, hot=hot).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    assert sum(r[2] for r in want) > 10_000


def test_words(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
        want = brute_words(rows, 13)
        for shard_keys, cells, chunk_bytes in ((1 << 21, 3, 2 << 20), (50, 0.2, 2000)):
            got = repeated_windows(df.repartition(3), Scratch(spark, "t"), shard_keys=shard_keys, cells_per_key=cells, chunk_bytes=chunk_bytes).collect()
            assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text.encode()) for r in got) == want
        assert sum(r[2] for r in want) > 500


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_bytes(df, Scratch(spark, "t")).count() == 0
    assert repeated_windows(df, Scratch(spark, "t")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 80))
        length = rng.integers(0, 12, n)
        rows = rng.integers(0, 2, (n, 12)).astype(np.uint8)
        rows[np.arange(12) >= length[:, None]] = 0
        group = rng.integers(0, 4, n)
        s = SuffixOrder(group, rows, length)
        key = [(group[i], bytes(rows[i, : length[i]])) for i in s.order]
        assert key == sorted(key)


def test_collisions_are_met(monkeypatch):
    from quire.llm import suffixes

    monkeypatch.setattr(suffixes, "powers", lambda base, n: (np.zeros(n + 1, np.uint64),) * 2)
    rows = np.array([[1, 2], [3, 1], [1, 1]], np.uint8)
    s = SuffixOrder(np.zeros(3, np.int64), rows, np.full(3, 2))
    assert s.order.tolist() == [2, 0, 1] and s.shared.tolist() == [-1, 1, 0]


def test_words_whose_hashes_collide_are_told_apart(spark):
    # Equal under a polynomial hash modulo 2**64 with the multiplier of the prefix sums.
    a, b = "nnnnnnornnponpqornnpnoon", "oqpopnnnpnnnqnnnnnpnpnnn"
    rest = [f"w{i}" for i in range(16)]
    rows = [(1, " ".join([a, *rest[:12]])), (2, " ".join(["x", b, *rest[:12], "y", "z"])), (3, " ".join([a, *rest[:12]]))]
    for chunk_bytes in (1 << 20, 10):
        got = repeated_windows(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Scratch(spark, "t"), chunk_bytes=chunk_bytes).collect()
        assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


def test_strings_whose_hashes_collide_are_told_apart(spark):
    # Equal under polynomial hashes modulo 2**64 with two public multipliers.
    pair = ["120001100090087431104087012002002361", "008100011102600000050600700470720000"]
    rng = random.Random(5)
    rows = []
    for g in range(20):
        tail = "".join(rng.choice("abcdefgh") for _ in range(64))
        rows += [(len(rows) + k, pair[k % 2] + tail[: 64 - (k > 1) * 2] + ("xy" if k > 1 else "")) for k in range(4)]
    want = brute_bytes(rows, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 50_000):
        for chunk_bytes in (1 << 20, 300):
            got = repeated_bytes(df.repartition(2), Scratch(spark, "t"), chunk_bytes=chunk_bytes, hot=hot).collect()
            assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == want


def test_hashes_that_always_collide(spark, monkeypatch):
    from quire.llm import chunks, suffixes, windows


    rows = corpus(3)[:40]
    texts = [(t or "").encode() for _, t in rows]
    body = b"\n".join(texts) + b"\n"
    import zstandard

    row = {"chunk": 0, "ids": np.array([1 << 60 if i is None else i for i, _ in rows], np.int64).tobytes(), "known": np.array([i is not None for i, _ in rows], np.uint8).tobytes(), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "body": zstandard.ZstdCompressor().compress(body)}
    chunk = chunks.Chunk(row)
    plain = windows.Windows(chunk, 13)
    monkeypatch.setattr(windows, "mix64", lambda h: h * np.uint64(0))
    same = windows.Windows(chunk, 13)
    assert len(plain.first) == len(same.first) > 10
    assert len(set(zip(plain.group.tolist(), same.group.tolist(), strict=True))) == len(plain.first)
    a = suffixes.Anchors(chunk, 100)
    a.hot = np.arange(len(a.at))
    plain = suffixes.HotWindows(a)
    monkeypatch.setattr(suffixes, "mix64", lambda h: h * np.uint64(0))
    same = suffixes.HotWindows(a)
    assert len(plain.lead) == len(same.lead) > 10
    assert len(set(zip(plain.group.tolist(), same.group.tolist(), strict=True))) == len(plain.lead)


def test_segments(spark, monkeypatch):
    from quire.llm import chunks, suffixes

    rows = corpus(4)
    texts = [(t or "").encode() for _, t in rows]
    import zstandard

    row = {"chunk": 0, "ids": np.arange(len(rows)).tobytes(), "known": np.ones(len(rows), np.uint8).tobytes(), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "body": zstandard.ZstdCompressor().compress(b"\n".join(texts) + b"\n")}
    chunk = chunks.Chunk(row)
    whole, words = suffixes.Anchors(chunk, 100), chunk.words()
    for size in (1, 7, 100, 333):
        if size > 50:
            monkeypatch.setattr(suffixes, "SEGMENT", size)
            parts = suffixes.Anchors(chunk, 100)
            assert all(np.array_equal(getattr(whole, k), getattr(parts, k)) for k in ("at", "key", "around", "n_left", "n_right"))
        monkeypatch.setattr(chunks, "SEGMENT", size)
        again = chunk.words()
        assert again.joined == words.joined and np.array_equal(again.hash, words.hash) and np.array_equal(again.doc, words.doc) and np.array_equal(again.off, words.off)


def test_a_text_of_many_chunks(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 12_000_000).astype(np.uint8)
    long[rng.integers(0, len(long), len(long) // 6)] = 32
    text = long.tobytes().decode()
    part = text[9_000_000:9_300_000]
    df = spark.createDataFrame([(1, "x" + part), (2, text), (3, "é" * 200)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in repeated_bytes(df, Scratch(spark, "t")).select("doc_id", "n_bytes", "n_removed", "spans").collect()}
    assert [tuple(s) for s in got[2].spans] == [(9_000_000, 9_300_000)] and got[1].n_removed == 0 and got[3].n_removed == 398 and got[2].n_bytes == len(text)
    got = {r.doc_id: r for r in repeated_windows(df, Scratch(spark, "t")).select("doc_id", "n_words", "n_removed").collect()}
    assert got[2].n_words == len(text.split()) and len(part.split()) - 2 <= got[2].n_removed <= len(part.split()) and got[1].n_removed == 0


def test_columns_that_come_along(spark):
    import datetime as dt

    long = "a passage of some length that is said again in another text and is cut there, " * 3
    rows = [(i, "own %d " % i + long, dt.datetime(2024, 1, 2, 3, 4, 5, 123456), None if i else 7, [("k", 1.5)]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `a.b` timestamp, `x``0` int, kept array<struct<k:string,v:double>>").withColumn("n_chars", F.lit(5))
    got = without_repeats(df, Scratch(spark, "t"))
    assert got.schema == df.schema or [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema]
    rows = sorted(got.collect())
    assert [r["a.b"] for r in rows] == [dt.datetime(2024, 1, 2, 3, 4, 5, 123456)] * 3 and [r["x`0"] for r in rows] == [7, None, None]
    assert all(r.n_chars == len(r.text) and r.kept == [("k", 1.5)] for r in rows) and len(rows[0].text) > 80 > 20 > len(rows[1].text)


def test_words_of_a_chunk(monkeypatch):
    import zstandard

    from quire.llm import chunks

    rng = random.Random(1)
    for size, clash in ((5, False), (50, True), (1 << 20, False), (1 << 20, True)):
        monkeypatch.setattr(chunks, "SEGMENT", size)
        if clash:
            monkeypatch.setattr(chunks, "mix64", lambda h: h * np.uint64(0))
        for _ in range(20):
            texts = [bytes(rng.choice(b"ab\0 \n\t\x0b\x0c\r  ") for _ in range(rng.randint(0, 60))) + rng.choice([b"", b" abcdefgh", b" abcdefghi", b" " + b"x" * rng.randint(14, 20), "é".encode() * 5]) for _ in range(rng.randint(0, 8))]
            row = {"chunk": 0, "ids": np.arange(len(texts)).tobytes(), "known": np.ones(len(texts), np.uint8).tobytes(), "sizes": np.array([len(x) for x in texts], np.int64).tobytes(), "body": zstandard.ZstdCompressor().compress(b"\n".join(texts) + b"\n")}
            w = chunks.Chunk(row).words()
            want = [(i, x) for i, t in enumerate(texts) for x in t.split()]
            assert w.doc.tolist() == [i for i, _ in want]
            assert all(w.joined[w.off[k] : w.off[k + 1] - 1] == x for k, (_, x) in enumerate(want))
            seen = {}
            assert all(seen.setdefault(x, w.ids[k]) == w.ids[k] for k, (_, x) in enumerate(want)) and len(set(seen.values())) == len(seen)
        monkeypatch.undo()
