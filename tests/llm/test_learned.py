import random

import numpy as np

from quire.llm.common import Scratch
from quire.llm.languages import PENALTY, Mixture, fit_languages, grams, held_out, identify_languages
from quire.llm.mixing import fit_rates, fit_softmax, mixing_rates, rates_of
from quire.llm.toxicity import fit_nnpu, fit_toxicity, score_toxicity, without_toxic

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["ción", "ñe", "ll", "os"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang := rng.choice("abc") * 2, rng.randint(3, 80)), lang, "x") for i in range(300)]
    rows += [(1000, say(rng, "aa", 150) + " " + say(rng, "cc", 40), "aa", "x"), (1001, None, None, None), (1002, "", "bb", None), (1003, "123 !? ²", "aa", None), (None, say(rng, "bb", 20), "bb", None), (7, rows[7][1], rows[7][2], "x"), (1004, "ÜNG 中文", None, None), (1005, say(rng, "aa", 20_000), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = fit_languages(df.where(~held_out("doc_id", 4, 2)))
    got = identify_languages(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[r[0]].lang_pred == r[2] for r in rows[:300]]) > 0.99
    assert [x.lang for x in by[1000].languages] == ["aa", "cc"] and 0.45 < by[1000].score < 0.8
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].languages == [] for i in (1001, 1002, 1003))
    assert by[None].lang_pred == "bb" and by[1005].lang_pred == "aa"
    none = fit_languages(df.limit(0))
    assert {r.lang_pred for r in identify_languages(df, none).collect()} == {"und"}
    assert identify_languages(df.limit(0), model).count() == 0
    held = {r.doc_id: r.h for r in df.select("doc_id", held_out("doc_id", 4, 2).alias("h")).collect()}
    import zlib

    assert held[None] is False and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items() if i is not None)


def test_mixture_chooses_the_best_set():
    rng = random.Random(2)
    texts = {k: say(rng, k, 3000) for k in SYLLABLES}
    p = np.array([np.bincount(grams(t), minlength=1 << 15) + 0.5 for t in texts.values()])
    model = Mixture(list(texts), p / p.sum(axis=1, keepdims=True))
    for _ in range(30):
        text = " ".join(say(rng, k, rng.randint(1, 60)) for k in rng.sample(list(texts), rng.randint(1, 3)))
        chosen = model.infer(text)[2]
        n = np.bincount(grams(text), minlength=1 << 15)
        value = {}
        for m in range(1, 8):  # every set, shares fitted to the end
            some = [k for k in range(3) if m >> k & 1]
            share = np.full(len(some), 1 / len(some))
            for _ in range(200):
                part = share[:, None] * model.p[some]
                share = (part * (n / part.sum(axis=0))).sum(axis=1) / n.sum()
            value[m] = n @ np.log(share @ model.p[some]) - len(some) * PENALTY / 2 * np.log(n.sum() + 1)
        got = sum(1 << model.languages.index(k) for k, _ in chosen)
        assert value[got] >= max(value.values()) - 2


def test_nnpu_beats_the_prior():
    rng = np.random.default_rng(3)
    x = (rng.random((4000, 30)) < 0.2).astype(np.float32)
    y = x[:, :3].sum(axis=1) > 0.5
    positive = x[y][: int(y.sum() * 0.3)]
    w, b = fit_nnpu(positive, x, float(y.mean()))
    assert np.mean((x @ w + b > 0) == y) > 0.97


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = say(rng, rng.choice(list(SYLLABLES)), rng.randint(5, 60)).split()
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot,", "Trash", "schufT" + rng.choice(["en", "ig", "heit"])]))
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(bad) if rng.random() < 0.7 else None))
    truth = [any(b in t.lower() for b in ("scum", "idiot", "trash", "schuft")) for _, t, _ in rows]
    rows += [(None, "scum idiot trash", 0.0), (700, None, 0.0), (701, "", 0.0), (3, rows[3][1], 0.0), (702, "ka to " * 20_000 + "scum idiot", 0.0)]
    labels += [(None, 1), (5, labels[5][1])]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(df, lab, Scratch(spark, "t"))
    got = score_toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert np.mean([(by[i] >= 0.5) == t for i, t in enumerate(truth)]) > 0.97
    assert by[None] >= 0.5 and by[702] >= 0.5 and by[700] == by[701] < 0.5
    kept = without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert all(r.score < 1e-6 for r in score_toxicity(df, fit_toxicity(df, lab.limit(0), Scratch(spark, "t"))).collect())
    assert score_toxicity(df.limit(0), model).count() == 0


def test_softmax():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    y = x[:, :3].argmax(axis=1)
    w, b = fit_softmax(x, y, 3)
    assert np.mean((x @ w + b).argmax(axis=1) == y) > 0.97


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    n = rng.integers(0, 3000, 500)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    for share in ([0.2, 0.3, 0.5], [0.8, 0.1, 0.1], [0.05, 0.05, 0.9]):
        goal = np.array(share) * n.sum()
        pull, miss = fit_rates(df, goal)
        reached = (n * rates_of(p, pull)) @ p
        assert np.isclose(np.abs(reached - goal).max() / goal.sum(), miss, atol=1e-9)
        # A long plain descent does hardly better.
        inverse = np.linalg.inv((p * n[:, None]).T @ p)
        r = np.ones(500)
        for _ in range(5000):
            r = np.maximum(0, r - p @ (inverse @ ((n * r) @ p - goal)))
        value = lambda x: float((x - goal) @ inverse @ (x - goal))
        assert value(reached) <= value((n * r) @ p) + 1e-3 * value(n @ p)


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, say(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(1, 50)), lang) for i in range(300)]
    labels = spark.createDataFrame([(i, lang) for i, _, lang in rows if i % 2] + [(None, "aa"), (2, None)], "doc_id long, domain string")
    rows += [(None, "ka to", "aa"), (900, None, "aa"), (901, "", "aa"), (3, rows[3][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    targets = {"aa": 3, "bb": 1, "cc": 2, "none": 5}
    got = mixing_rates(df, labels, targets, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    total = sum(r.n_tokens for r in got)
    for d, share in (("aa", 0.5), ("bb", 1 / 6), ("cc", 1 / 3)):
        assert abs(sum(r.n_tokens * r.rate * r.posterior[d] for r in got) - share * total) < 1e-4 * total
    by = {r.doc_id: r.domain for r in got}
    assert np.mean([by[i] == lang for i, _, lang in rows[:300] if i % 2 == 0]) > 0.9
    carried = mixing_rates(df, labels, targets, Scratch(spark, "t"), carry=["rate", "text", "doc_id"])
    assert carried.columns == ["rate", "text", "doc_id", "n_tokens", "domain", "posterior", "rate", "miss"]
    assert all(r.miss < 1e-6 for r in got)
    none = mixing_rates(df, labels.limit(0), targets, Scratch(spark, "t")).collect()
    assert {r.rate for r in none} == {1.0} and {r.domain for r in none} == {None}
    assert mixing_rates(df.limit(0), labels, targets, Scratch(spark, "t")).count() == 0


def test_single_letters_have_a_language(spark):
    df = spark.createDataFrame([(0, "a cat is a pet", "aa"), (1, "ung sch ei", "bb")], "doc_id long, text string, lang string")
    model = fit_languages(df)
    assert all(model.infer(t)[0] in ("aa", "bb") for t in ("a", "I", "A 1", "1 a 2", "1 b 2", "中", "é"))
    assert all(model.infer(t)[0] == "und" for t in (None, "", "1 2 !"))


def test_targets_out_of_reach(spark):
    rng = np.random.default_rng(8)
    p = np.stack([np.linspace(0.3, 0.6, 400), np.linspace(0.7, 0.4, 400)], axis=1)
    n = rng.integers(0, 500, 400)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    goal = np.array([0.9, 0.1]) * n.sum()
    pull, miss = fit_rates(df, goal)
    reached = (n * rates_of(p, pull)) @ p
    # The nearest that any mixture comes is all tokens from the document that leans most to the first domain.
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    best = min(float((x - goal) @ inverse @ (x - goal)) for x in (f * p[n > 0][-1] * n.sum() for f in np.linspace(0, 3, 3001)))
    assert miss > 0.1 and float((reached - goal) @ inverse @ (reached - goal)) <= best * 1.01


def test_repeated_ids_give_one_text(spark, tmp_path):
    from quire.llm.features import texts_of

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, None), (3, "x")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, "p"), (2, "u"), (1, "u")], "doc_id long, cls string")
    assert sorted((r.cls, r.text is None) for r in texts_of(docs, chosen, Scratch(spark, "t")).collect()) == [("p", False), ("u", False), ("u", True)]


def test_nnpu_steps_follow_the_risk():
    """A step of the fit is recomputed from the risk by numeric differences, on both sides of the correction."""
    rng = np.random.default_rng(3)
    x = (rng.random((60, 5)) < 0.4).astype(np.float32)
    p, u = x[:20], x[20:]

    def risk(w, b, prior):
        plus = np.logaddexp(0, -(p @ w + b)).mean()
        minus = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
        return prior * plus + minus if minus >= 0 else -minus

    for prior in (0.2, 0.95):
        w, b = np.zeros(5), np.log(prior / (1 - prior))
        side = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
        got, bias = fit_nnpu(p, u, prior, rounds=1, decay=0.0, rate=1.0)
        g = [(risk(w + e, b, prior) - risk(w - e, b, prior)) / 2e-5 for e in np.eye(5) * 1e-5]
        # The first step of Adam has the gradient's sign and the rate's size.
        assert np.array_equal(np.sign(got), -np.sign(np.round(g, 9))), (prior, side)
        assert np.sign(bias - b) == -np.sign(risk(w, b + 1e-5, prior) - risk(w, b - 1e-5, prior))


def test_present_sums_what_features_gives():
    from quire.llm.features import Present, features

    rng = random.Random(9)
    texts = [say(rng, k, rng.randint(0, 30)) for k in SYLLABLES for _ in range(20)] + [None, "", "Ab, ab! abc abcd abcde"]
    chosen = sorted({f for t in texts for f in features(t)})[::3]
    weights = np.arange(1, len(chosen) + 1, dtype=float)
    present = Present(chosen, weights)
    for t in texts:
        assert present.total(t) == sum(w for f, w in zip(chosen, weights, strict=True) if f in set(features(t)))
