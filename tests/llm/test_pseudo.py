import random
from collections import Counter

import numpy as np

from quire.llm import pseudo
from quire.llm.common import Scratch
from quire.llm.pseudo import Network, Vocabulary, score_documents, train


def brute(vocabulary, net, text, known):
    words = pseudo.word_hashes([text])[0]
    inside = sum(np.log(max(known[int(w)], 1) / vocabulary.words[vocabulary.ids[int(w) % pseudo.BUCKETS]]) for w in words)
    ids = [vocabulary.edge] * 3 + [int(vocabulary.ids[int(w) % pseudo.BUCKETS]) for w in words] + [vocabulary.edge] * 3
    total = 0.0
    for i in range(3, len(ids) - 3):
        x = np.concatenate([net.embed[ids[i + o]] for o in (-3, -2, -1, 1, 2, 3)]).astype(float)
        h = np.tanh(x @ net.w1 + net.b1)
        c, k = divmod(ids[i], 64)
        for z, j in ((h @ net.wc + net.bc, c), (h @ net.wo[c] + net.bo[c], k)):
            total += z[j] - np.log(np.exp(z - z.max()).sum()) - z.max()
    return len(words), total + inside


def test_gradient():
    rng = np.random.default_rng(1)
    net = Network.fresh(rng.random(pseudo.TOKENS))
    seq = rng.integers(0, pseudo.TOKENS, 60).astype(np.int32)
    at = np.arange(3, 57)
    g = net.gradient(seq, at)
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 12):
        wide = Network(net.flat.astype(np.float64))
        loss = []
        for e in (1e-4, -1e-4):
            moved = Network(wide.flat.copy())
            moved.flat[k] += e
            loss.append(-moved.log_probability(seq, at).mean())
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k]) < 1e-3


def test_train_and_score(spark):
    rng = random.Random(2)
    follow = {i: [rng.randrange(60) for _ in range(3)] for i in range(60)}

    def chain(n):
        w, out = rng.randrange(60), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return out

    texts = [" ".join(chain(rng.randint(1, 400))) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "w1 w2", 1), (900, None, 1), (901, "", 1), (902, " ?! ", 1), (3, texts[3], 1), (903, "w5 " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    model = train(df, Scratch(spark, "t"), rounds=2, batch=256)
    counts, vocabulary, net = model
    known = Counter(int(h) for _, t, _ in rows for h in pseudo.word_hashes([t])[0])
    scored = score_documents(df, model, Scratch(spark, "t")).collect()
    got = {r.doc_id: r for r in scored}
    assert len(scored) == len(rows)
    for i, t, _ in rows[:20] + rows[200:205]:
        n, total = brute(vocabulary, net, t, known)
        assert got[i].n_words == n and abs(got[i].pseudo_log_likelihood - total) < 1e-3 * max(1, n)
        assert got[i].mean_log_probability is None if n == 0 else abs(got[i].mean_log_probability - total / n) < 1e-3
    unseen = [chain(200) for _ in range(20)]
    mixed = [rng.sample(w, len(w)) for w in unseen]
    test = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(unseen + mixed)], "doc_id long, text string")
    s = [r.mean_log_probability for r in score_documents(test, model, Scratch(spark, "t")).orderBy("doc_id").collect()]
    start = Network.fresh(vocabulary.share)
    u = [r.mean_log_probability for r in score_documents(test, (counts, vocabulary, start), Scratch(spark, "t")).orderBy("doc_id").collect()]
    assert np.mean(s[:20]) > np.mean(u[:20]) + 0.3 and np.mean(s[:20]) > np.mean(s[20:]) + 0.3


def test_average_in_levels(spark):
    rows = [(i, float(i + 1), np.full(3, i, np.float32).tobytes()) for i in range(100)]
    models = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "part long, weight double, model binary")
    want = sum(i * (i + 1) for i in range(100)) / sum(range(1, 101))
    assert np.allclose(pseudo._mean(models, Scratch(spark, "t"), "m"), want, rtol=1e-4)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = train(df, Scratch(spark, "t"))
    assert score_documents(df, model, Scratch(spark, "t")).count() == 0 and isinstance(model[1], Vocabulary)


def test_every_token_is_trained_on(spark):
    df = spark.createDataFrame([(i, "a b c d e " * 40) for i in range(20)], "doc_id long, text string").repartition(2)
    scratch = Scratch(spark, "t")
    train(df, scratch)
    seen = spark.read.parquet(f"{scratch.root}/models-*").agg({"weight": "sum"}).first()[0]
    assert seen == 20 * 200


def test_words_of_a_token_share_its_probability(spark):
    words = [f"w{i}" for i in range(9000)]
    times = np.arange(9000) % 7 + 1
    df = spark.createDataFrame([(k, " ".join(w for w, n in zip(words, times, strict=True) if n > k)) for k in range(7)], "doc_id long, text string").repartition(3)
    counts, vocabulary, _ = train(df, Scratch(spark, "t"), rounds=1)
    h = pseudo.word_hashes(words)[0]
    p = np.exp(vocabulary.inside(h, times))
    token = vocabulary.ids[pseudo._bucket(h)]
    for t in np.unique(token):
        assert abs(p[token == t].sum() + 1 / vocabulary.words[t] - 1) < 1e-9
    assert len(np.unique(token)) < 5000
    table = counts.table.toPandas()
    got = dict(zip(np.concatenate([pseudo.unsqueeze(b, np.uint64) for b in table["words"]]).tolist(), np.concatenate([pseudo.unsqueeze(b, np.int64) for b in table["counts"]]).tolist(), strict=True))
    assert got == dict(zip(h.tolist(), times.tolist(), strict=True))


def test_a_text_that_occurs_twice_scores_higher(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.8 else f"u{i}x{k}" for k in range(100)) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scratch = Scratch(spark, "t")
    got = {r.doc_id: r.mean_log_probability for r in score_documents(df, train(df, scratch), scratch).collect()}
    assert np.mean([got[i] for i in range(60)]) > np.mean([got[k] for k in range(60, 120)]) + 0.05
