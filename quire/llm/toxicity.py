"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.features import Present, dense, smallest_hashes, telling_features, texts_of

#: Rows, at most, of confirmed toxic and of unlabelled texts that the classifier is fitted on.
POSITIVE_ROWS = 4_000
UNLABELLED_ROWS = 8_000
FEATURES = 1024


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, decay: float | None = None, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative PU risk with logistic loss.

    risk = prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]): unlabelled
    texts count as negative, less the share of toxic ones among them. Where
    the corrected negative part falls below zero, the step goes against it.
    """
    decay = 0.1 / len(positive) if decay is None else decay
    w, b = np.zeros(positive.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = _sigmoid(zp), _sigmoid(zu)
        negative = np.append(gu @ unlabelled, gu.sum()) / len(zu) - prior * np.append(gp @ positive, gp.sum()) / len(zp)
        plus = prior * np.append((gp - 1) @ positive, (gp - 1).sum()) / len(zp)
        g = (plus + negative if part >= 0 else -negative) + decay * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - float(move[-1])
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, keep: int = FEATURES) -> tuple[Present, float]:
    """A classifier from labels(doc_id, toxic) and docs(doc_id, text); (weights, bias).

    Positives are texts with a label of 1; unlabelled are any of docs. Both
    samples are bounded by parameters. The class prior is the share of 1 among
    all non-null labels. Without positives every score is the smallest.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    if not ones:
        return Present([], np.zeros((0,))), -20.0
    toxic = smallest_hashes(ids.join(known.where("toxic = 1").select("doc_id"), "doc_id"), positive_rows).withColumn("cls", F.lit("p"))
    some = smallest_hashes(ids, unlabelled_rows).withColumn("cls", F.lit("u"))
    sample = texts_of(docs, scratch.save(toxic.unionByName(some), "ids"), scratch)
    chosen = telling_features(sample, ["p"], keep)
    x, cls = dense(sample, chosen)
    is_p = np.array(cls) == "p"
    if is_p.all() or not is_p.any():
        return Present([], np.zeros((0,))), -20.0
    w, b = fit_nnpu(x[is_p], x[~is_p], min(max(ones / n, 1e-3), 0.999))
    return Present(chosen, w), b


def score_toxicity(docs: DataFrame, model: tuple[Present, float]) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text): the probability of being toxic.

    Null and empty texts have no features and get the bias alone. Rows are
    independent, so repeats and null ids stay as they come; whole texts are
    read, however long. Extra columns are not looked at.
    """
    present, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([float(present.total(t.as_py())) + bias for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: tuple[Present, float], threshold: float = 0.5) -> DataFrame:
    """docs without rows whose text scores threshold or more; all columns stay."""
    present, bias = model
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([float(present.total(t.as_py())) + bias for t in batch.column(at)], np.float64)
            yield batch.filter(pa.array(_sigmoid(z) < threshold))

    return docs.mapInArrow(run, docs.schema)
