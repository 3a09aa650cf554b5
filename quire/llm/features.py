"""Word features of texts and bounded, labelled samples to fit classifiers on."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

#: Lengths of word beginnings; where two distinct words of a text share one, that is a feature too.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


#: Features that a task counts before it sends their sums on.
COUNTED = 50_000


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words, bare of punctuation at their ends."""
    return {w.strip(".,;:!?\"'()[]|") for w in set((text or "").lower().split())} - {""}


def features(text: str | None) -> list[str]:
    """Distinct words (=), their beginnings (-), and beginnings of several distinct words (+)."""
    seen = words(text)
    begun = Counter(w[:k] for w in seen for k in BEGINNINGS if len(w) > k)
    return ["=" + w for w in seen] + ["-" + b for b in begun] + ["+" + b for b, n in begun.items() if n > 1]


def smallest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """A bounded sample of rows that depends on their doc_id alone: the n with the smallest hashes."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, cls), written, for chosen(doc_id, cls), a bounded sample of ids: one text for each, that of smallest hash where rows repeat an id.

    The ids are broadcast, so that no text but those of the sample is moved;
    the hashes of an id's rows are reduced before the shuffle.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "cls")), "doc_id").groupBy("doc_id", "cls").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    return scratch.save(rows.select("text", "cls"), "sample")


def _sums(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["feature", "cls", "n"])


def telling_features(sample: DataFrame, classes: list[str], keep: int, least: float = 4.0) -> list[str]:
    """Features of a bounded sample(text, cls) that are commoner in one of the classes than in the rest of the sample.

    By a two-proportion test with continuity correction: the largest values of
    at least ``least`` standard deviations, which keeps chance out.
    """
    size = {r["cls"]: r["count"] for r in sample.groupBy("cls").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text, cls in zip(batch.column(0), batch.column(1), strict=True):
                c = cls.as_py()
                total.update((f, c) for f in features(text.as_py()))
                if len(total) > COUNTED:
                    yield _sums(total)
                    total = Counter()
        yield _sums(total)

    seen = sample.select("text", "cls").mapInArrow(count, "feature string, cls string, n bigint")
    sums = seen.groupBy("feature").agg(*(F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(classes)), F.sum("n").alias("every"))
    total = sum(size.values())
    every = F.col("every")
    test = []
    for i, c in enumerate(classes):
        own, rest = size.get(c, 0), total - size.get(c, 0)
        if own and rest:
            p = every / F.lit(total)
            z = (F.col(f"n{i}") / own - (every - F.col(f"n{i}")) / rest - 0.5 * (1 / own + 1 / rest)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / own + 1 / rest))
            test.append(z)
    if not test:
        return []
    best = test[0] if len(test) == 1 else F.greatest(*test)
    top = sums.where(every >= max(4, math.isqrt(total) // 20)).select("feature", best.alias("z")).where(F.col("z") >= least).orderBy(F.desc("z"), "feature").limit(keep)
    return [r["feature"] for r in top.collect()]


def dense(sample: DataFrame, chosen: list[str], also: Callable[[str | None], list[float]] | None = None) -> tuple[np.ndarray, list[str]]:
    """Presence of the chosen features in the rows of a bounded sample(text, cls), then what also gives, and the rows' classes."""
    index = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            hits = [sorted(index[f] for f in features(t) if f in index) for t in texts]
            more = [[float(x) for x in also(t)] if also else [] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1), pa.array(more, pa.list_(pa.float64()))], ["hits", "cls", "more"])

    rows = sample.select("text", "cls").mapInArrow(run, "hits array<int>, cls string, more array<double>").toPandas()
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, hits in enumerate(rows["hits"]):
        x[i, np.asarray(hits, np.int64)] = 1
    if also and len(rows):
        x = np.concatenate([x, np.stack(rows["more"].tolist())], axis=1)
    return x, rows["cls"].tolist()


class Present:
    """Sums the weights of the chosen features that a text has."""

    def __init__(self, chosen: list[str], weights: np.ndarray):
        self.weights = weights
        kinds: dict[str, dict[str, int]] = {"=": {}, "-": {}, "+": {}}
        for i, f in enumerate(chosen):
            kinds[f[0]][f[1:]] = i
        self.word, self.begun, self.twice = kinds["="], kinds["-"], kinds["+"]
        self.known = {k: {b for b in (*self.begun, *self.twice) if len(b) == k} for k in BEGINNINGS}

    def total(self, text: str | None) -> np.ndarray:
        seen = words(text)
        hits = {self.word[w] for w in seen & self.word.keys()}
        for k, known in self.known.items():
            if known:
                for b, n in Counter(b for w in seen if len(w) > k and (b := w[:k]) in known).items():
                    if b in self.begun:
                        hits.add(self.begun[b])
                    if n > 1 and b in self.twice:
                        hits.add(self.twice[b])
        return self.weights[sorted(hits)].sum(axis=0)
