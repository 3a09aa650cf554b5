import random

import numpy as np
import xxhash

from quire.llm.common import Scratch
from quire.llm.simhash import fingerprint, linked_pairs, simhash_groups


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    out = list(range(len(rows)))

    def root(i):
        while out[i] != i:
            i = out[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                out[b] = a
    return {(rows[i][0], fps[i], rows[root(i)][0]) for i in range(len(rows))}


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \n", "A", "a b", "É À B", *(" ".join(rng.choice(["ab", "C", " x", "dé"]) for _ in range(rng.randint(1, 50))) for _ in range(30))]:
        assert fingerprint(text) == brute_fingerprint(text)


def test_linked_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, np.uint64)
    code = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 32, 30, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 30, np.uint64)) for _ in range(8))]))
    group = (code >> np.uint64(32)).astype(np.int64)
    got = {frozenset((int(code[i]), int(code[j]))) for a, b in linked_pairs(group, code, 32, 2) for i, j in zip(a, b, strict=True)}
    want = {frozenset((int(x), int(y))) for x in code for y in code if x < y and x >> np.uint64(32) == y >> np.uint64(32) and int(x ^ y).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_groups(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[0]] * 20 + [None, "", " ", "one", "x" * 200_000, "é " * 5000]
    rows = list(enumerate(texts, 5))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, fp int, rep int, component_id int")
    for hot in (200_000, 3):
        got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(df, Scratch(spark, "t"), hot_group=hot).collect()}
        assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(rows) - 25


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (None, None)], "doc_id long, text string")
    got = simhash_groups(df, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 1), (1, 1), (1, 1)]
    assert simhash_groups(df.limit(0), Scratch(spark, "t")).count() == 0


def test_long_chain(spark):
    from quire.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(10, 150)] + [(500, 400), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(links, Scratch(spark, "t")).collect()}
    assert got == {i: 10 for i in range(10, 151)} | {400: 400, 500: 400}
