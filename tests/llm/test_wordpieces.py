import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.queries import VOCABULARY
from quire.llm.wordpieces import Automaton, count_tokens, load_ranks


def brute(vocabulary, text):
    pieces, at, n = set(vocabulary), 0, 0
    longest = max(map(len, pieces), default=1)
    while at < len(text):
        at += next((k for k in range(longest, 0, -1) if text[at : at + k] in pieces and at + k <= len(text)), 1)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=12), st.text("abcd", max_size=40))
def test_automaton(vocabulary, text):
    vocabulary = [v.encode() for v in vocabulary]
    assert Automaton(vocabulary).count(text.encode()) == brute(vocabulary, text.encode())


def test_counts(spark):
    vocabulary = load_ranks(VOCABULARY)
    rng = random.Random(1)
    words = ["the", "thing", "überall", "été", "x" * 300, "12345", "Ж", "🙂", "a-b_c", "reality", "."]
    texts = [None, "", " \n", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(30)), "word " * 20_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_tokens) for r in count_tokens(df, vocabulary).collect())
    memo = {w: brute(vocabulary, b" " + w.encode()) for w in {w for _, t, _ in rows for w in (t or "").split()}}
    assert got == sorted((-1 if i is None else i, len((t or "").split()), sum(memo[w] for w in (t or "").split())) for i, t, _ in rows)
    assert count_tokens(df.limit(0), vocabulary).count() == 0


def test_missing_vocabulary():
    with pytest.raises(FileNotFoundError):
        load_ranks("/nowhere")
