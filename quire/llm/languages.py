"""Language identification by inferring each document's mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mix64

#: Buckets of hashed n-grams of a language model.
BUCKETS = 1 << 15
ROUNDS = 12
#: Cost of one more language, in units of half a logarithm of the n-gram count.
PENALTY = 4.0

_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text, characters outside words counting as one kind of space."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8)
    code = (b[:-2].astype(np.uint64) << np.uint64(16)) | (b[1:-1].astype(np.uint64) << np.uint64(8)) | b[2:]
    space = b == 32
    kept = code[space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2]
    # A text of single letters alone has but trigrams of a letter between spaces.
    code = kept if len(kept) else code[~space[1:-1]]
    return (mix64(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if lang.as_py() not in total:
                total[lang.as_py()] = np.zeros(BUCKETS, np.int64)
            total[lang.as_py()] += np.bincount(grams(text.as_py() or ""), minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


class Mixture:
    """Languages and the probability of each n-gram bucket in each."""

    def __init__(self, languages: list[str], probability: np.ndarray):
        self.languages, self.p = languages, probability

    def _fit(self, p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Expectation-maximisation of the shares; the log-likelihood they reach."""
        total = n.sum()
        for _ in range(rounds):
            part = share[:, None] * p
            share = (part @ (n / part.sum(axis=0)) if len(share) == 1 else (part * (n / part.sum(axis=0))).sum(axis=1)) / total
        return share, float(n @ np.log(share @ p))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Main language, its share, and all chosen languages with their shares.

        All languages are mixed first. Sets of those with the largest shares
        are then compared by log-likelihood less a penalty for each language.
        """
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, []
        n = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(n)
        if not len(at):
            return "und", 0.0, []
        p, n = self.p[:, at], n[at].astype(np.float64)
        share, _ = self._fit(p, n, np.full(len(p), 1 / len(p)))
        by_share = np.argsort(-share, kind="stable")
        cost = PENALTY * 0.5 * np.log(n.sum() + 1)
        alone = np.log(p) @ n
        best = np.array([int(alone.argmax())])
        best_share, best_value = np.ones(1), float(alone.max()) - cost
        for k in range(2, len(by_share) + 1):
            if share[by_share[k - 1]] < 0.01:
                break
            some = by_share[:k]
            fitted, value = self._fit(p[some], n, share[some] / share[some].sum(), 6)
            if value - k * cost > best_value:
                best, best_share, best_value = some, fitted, value - k * cost
        order = np.argsort(-best_share, kind="stable")
        chosen = [(self.languages[best[k]], float(best_share[k])) for k in order]
        main = best[order[0]]
        return self.languages[main], float(min(1.0, share[main])), chosen


def fit_languages(docs: DataFrame, smoothing: float = 0.5) -> Mixture:
    """N-gram models of all non-null langs, counted over all of docs(text, lang).

    The driver receives one number for each language and non-empty bucket.
    """
    rows = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string"))
    counts = rows.mapInArrow(_counts, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(set(counts["lang"]))
    n = np.zeros((len(languages), BUCKETS))
    n[np.searchsorted(languages, counts["lang"]) if languages else [], counts["bucket"].astype(int)] = counts["n"]
    n += smoothing
    return Mixture(languages, n / n.sum(axis=1, keepdims=True))


def held_out(key: str, of: int, fold: int) -> Column:
    """Whether crc32(key as text) mod of is fold; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == fold, F.lit(False))


def identify_languages(docs: DataFrame, model: Mixture) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row of docs(doc_id, text).

    languages has the chosen set with shares, the largest first; lang_pred is
    the first and score its share in the mixture of all languages. A null text
    or one without a letter gives 'und', 0 and an empty list, as does a model
    without languages. Rows are independent: repeats, null ids and ties (the
    first name wins) are kept as they come. Extra columns are not looked at.
    """
    schema = "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.infer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in f[2]] for f in found], kind)],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
