import random

import numpy as np

from quire.llm.common import Scratch
from quire.llm.latent import BUCKETS, EXTRA_RANK, Items, Space, benchmark_hits, common_subsequence, document_frequencies, smallest_hashed, word_hashes


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert common_subsequence(a, b) == brute_lcs(a, b)


def test_words():
    h, doc = word_hashes(["Dog dog, DOG!", None, "", "été Été dog"])
    assert len({*h[:3]} | {h[5]}) == 1 and h[3] == h[4] and doc.tolist() == [0, 0, 0, 3, 3, 3]


def brute(docs, items, similarity=0.8):
    """Every window of an item's length and a half, at every word."""
    out = set()
    for i, t in docs:
        h = word_hashes([t])[0].tolist()
        for k, q in items:
            w = word_hashes([q])[0].tolist()
            span = len(w) + 15
            if w and any(brute_lcs(w, h[s : s + span]) >= similarity * len(w) for s in range(max(1, len(h) - span + 1))):
                out.add((i, k))
    return out


def test_hits(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice(["an", "ti", "re", "ou", "th", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    say = lambda n: [rng.choice(vocab) if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n)]
    items = [(k, say(rng.randint(15, 70))) for k in range(20)]
    docs = []
    for i in range(80):
        words = say(rng.randint(0, 200))
        if i % 2:
            q = list(rng.choice(items)[1])
            for _ in range(int(len(q) * rng.choice([0, 0, 0.1]))):
                q[rng.randrange(len(q))] = rng.choice(vocab)
            at = rng.randint(0, len(words))
            words[at:at] = q
        docs.append((i, " ".join(words)))
    items = [(k, " ".join(w)) for k, w in items] + [(None, "the of and"), (99, None), (98, "")]
    docs += [(None, None), (500, ""), (501, " ".join(say(20_000))), (502, items[3][1].upper()), (502, items[3][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (256, 7):
        rows = benchmark_hits(df, bench, Scratch(spark, "t"), space_items=block).collect()
        assert len(rows) == len(docs)
        got = {(r.doc_id, h.item_id) for r in rows for h in r.hits if h.item_id is not None}
        want = {p for p in brute([d for d in docs if d[0] not in (501,)], [q for q in items if q[0] is not None])}
        assert len(want) > 35 and len(got & want) >= 0.97 * len(want)
        assert len(got - want) <= 2
    r = benchmark_hits(df.limit(0), bench, Scratch(spark, "t"))
    assert r.count() == 0
    assert all(not r.hits for r in benchmark_hits(df, bench.limit(0), Scratch(spark, "t")).collect())


def test_answer(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    body, answer = [rng.choice(vocab) for _ in range(24)], [rng.choice(vocab) for _ in range(6)]
    changed = [w if i % 3 else rng.choice(vocab) for i, w in enumerate(body)]
    pad = lambda: " ".join(rng.choice(vocab) for _ in range(60))
    docs = [(1, f"{pad()} {' '.join(changed)} {' '.join(answer)} {pad()}"), (2, f"{pad()} {' '.join(changed)} {pad()}"), *((i, pad()) for i in range(3, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(body) + ". " + " ".join(answer) + ".")], "item_id long, text string")
    assert [r.doc_id for r in benchmark_hits(df, bench, Scratch(spark, "t")).collect() if r.hits] == [1]
    given = spark.createDataFrame([(1, " ".join(body), " ".join(answer)), (2, " ".join(body), None)], "item_id long, text string, answer string")
    assert [(r.doc_id, [h.item_id for h in r.hits]) for r in benchmark_hits(df, given, Scratch(spark, "t")).collect() if r.hits] == [(1, [1])]
    assert np.isclose(common_subsequence(word_hashes([" ".join(body)])[0].tolist(), word_hashes([" ".join(changed)])[0].tolist()) / 24, 16 / 24)


def test_rare_words_changed(spark):
    """No hit is left to the weights: windows that lack an item's rarest words, between rare words, are found."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(6000)]
    usual = vocab[:60]
    items = [[rng.choice(usual) if rng.random() < 0.75 else rng.choice(vocab) for _ in range(rng.randint(30, 60))] for _ in range(40)]
    docs = [(i, " ".join(rng.choice(usual) if rng.random() < 0.6 else rng.choice(vocab) for _ in range(200))) for i in range(300)]
    count = {}
    for w in " ".join(t for _, t in docs).split():
        count[w] = count.get(w, 0) + 1
    want = set()
    for k, q in enumerate(items):
        changed = list(q)
        for j in sorted(range(len(q)), key=lambda j: count.get(q[j], 0))[: int(0.19 * len(q))]:
            changed[j] = rng.choice(vocab[60:])
        pad = [" ".join(rng.choice(vocab[60:]) for _ in range(40)) for _ in range(2)]
        docs.append((1000 + k, f"{pad[0]} {' '.join(changed)} {pad[1]}"))
        want.add((1000 + k, k))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(q)) for k, q in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, h.item_id) for r in benchmark_hits(df, bench, Scratch(spark, "t")).collect() for h in r.hits}
    assert want <= got


def test_sample_is_bounded(spark):
    rows = [(i, f"text {i % 300}") for i in range(900)] + [(i, "copied") for i in range(900, 1400)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 50, 1000):
        got = [r.text for r in smallest_hashed(df, n).collect()]
        assert len(got) == len(set(got)) == min(n, 301)
    assert smallest_hashed(df.limit(0), 5).count() == 0


def test_space_is_fitted_on_all_passages(spark):
    """The space is that of every passage of every text and the items, by a plain product of matrices."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 90))) for _ in range(1800)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    items = Items([1, 2, 3, 4], [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(4)], [None] * 4)
    df, passages = document_frequencies(docs)
    space = Space(items, df, passages, docs)
    passage = [w[s : s + 32] for w in (word_hashes([t])[0] for t in texts) for s in range(0, len(w), 32)]
    assert len(passage) == passages
    columns = np.unique(np.concatenate(items.words) & np.uint64(BUCKETS - 1)).astype(int)
    columns = columns[space.weight[columns] > 0]

    def row(words, times=1.0):
        n = np.bincount((words & np.uint64(BUCKETS - 1)).astype(int), minlength=BUCKETS) * space.weight
        length = np.sqrt((space.weight[(words & np.uint64(BUCKETS - 1)).astype(int)] ** 2).sum())
        return times * n[columns] / max(length, 1e-12)

    a = np.array([row(w) for w in passage] + [row(w, np.sqrt(max(100, passages / 4))) for w in items.words])
    rank = 4 + EXTRA_RANK
    omega = np.random.default_rng(11).integers(0, 2, (len(columns), rank), np.int8) * 2.0 - 1
    q = np.linalg.svd(a.T @ (a @ omega), full_matrices=False)[0]
    known = space.row[columns] >= 0
    assert known.sum() == len(space.vectors) > 20
    got = space.vectors / space.weight[columns[known], None]
    assert np.allclose(got @ got.T, (q @ q.T)[np.ix_(known, known)], atol=1e-3)


def test_repeated_items_are_searched_once(spark, monkeypatch):
    """A benchmark whose rows are repeated under other ids needs no more passes over the texts than its distinct items."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    items = [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(3)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocab) for _ in range(40)) + " " + items[i]) for i in range(3)], "doc_id long, text string")
    bench = spark.createDataFrame([(100 * r + k, t) for r in range(20) for k, t in enumerate(items)] + [(None, items[0])], "item_id long, text string")
    fitted, fit = [], Space._svd
    monkeypatch.setattr(Space, "_svd", lambda self, *a: fitted.append(1) or fit(self, *a))
    rows = benchmark_hits(docs, bench, Scratch(spark, "t"), space_items=4).collect()
    for r in rows:
        want = [100 * n + r.doc_id for n in range(20)] + ([None] if r.doc_id == 0 else [])
        assert [h.item_id for h in r.hits] == want and {h.similarity for h in r.hits} == {1.0}
    assert len(rows) == 3 and len(fitted) == 1
