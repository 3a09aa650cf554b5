"""Mixing documents to target weights by soft domain membership."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm.chunks import quoted
from quire.llm.common import Scratch
from quire.llm.features import Present, dense, smallest_hashes, telling_features, texts_of

#: Labelled rows, at most, that the classifier is fitted on.
FIT_ROWS = 8_000
FEATURES = 512
#: The largest miss, as a share of all tokens, at which the search for rates ends.
TOLERANCE = 1e-8
#: Weight of staying near a rate of 1 against meeting the targets.
RIDGE = 1e-8


def manner(text: str | None) -> list[float]:
    """How a text is written: length, word length, repeated words and lines, shares of kinds of characters."""
    t = text or ""
    words, lines, raw = t.split(), t.split("\n"), t.encode()
    n = max(1, len(t))
    of = lambda kind: len(raw) - len(raw.translate(None, kind))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / max(1, len(words)) / 10,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        of(b"|!{<") * 10 / n,
        of(b"0123456789") * 10 / n,
        of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 3 / n,
    ]


class Domains:
    """A softmax classifier: posterior of each domain for a text."""

    def __init__(self, names: list[str], present: Present, style: np.ndarray, bias: np.ndarray):
        self.names, self.present, self.style, self.bias = names, present, style, bias

    def posterior(self, text: str | None) -> np.ndarray:
        z = np.asarray(self.present.total(text) + np.array(manner(text)) @ self.style + self.bias, np.float64)
        p = np.exp(z - z.max())
        return p / p.sum()


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of multinomial logistic regression by full-batch Adam."""
    w, goal = np.zeros((x.shape[1] + 1, classes)), np.eye(classes)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = x @ w[:-1] + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - goal) / len(x)
        g = np.concatenate([x.T @ d + decay * w[:-1], d.sum(axis=0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def fit_domains(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS, keep: int = FEATURES) -> Domains | None:
    """A classifier of docs(doc_id, text) from labels(doc_id, domain); None without a labelled text.

    It is fitted on a sample bounded by rows. Of several labels of one doc_id
    the first in order counts; nulls don't.
    """
    known = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("cls"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    sample = texts_of(docs, scratch.save(smallest_hashes(ids.join(known, "doc_id"), rows), "ids"), scratch)
    names = sorted(r["cls"] for r in sample.select("cls").distinct().collect())
    if not names:
        return None
    chosen = [f for f in telling_features(sample, names, 4 * keep) if f[0] == "="][:keep] if len(names) > 1 else []
    x, cls = dense(sample, chosen, manner)
    w, b = fit_softmax(x, np.searchsorted(names, cls), len(names))
    return Domains(names, Present(chosen, w[: len(chosen)]), w[len(chosen) :], b)


def rates_of(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Each document's rate: 1, moved against the sum of all steps so far along its posterior, and held at 0 or more."""
    return np.maximum(0, 1 - p @ pull)


def fit_rates(members: DataFrame, targets: np.ndarray, tolerance: float = TOLERANCE, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """The sum of all steps for members(n_tokens, p), and the largest miss at the end, as a share of all tokens.

    Projected gradient for the least squares of (expected tokens of each domain
    - target), measured by the inverse of sum n p p^T, and, with the small
    weight ridge, of the rates from 1. A step goes against the miss, scaled by
    the second moments of those documents whose rate isn't held at 0, and is
    halved until it leads down. A document's rate follows from the sum of the
    steps, so that no state is kept for documents; a round is one aggregation
    to some (domains + 1)^2 numbers. It ends when the miss is within the
    tolerance or no step leads down any more: the least there is, since the
    sum of squares is convex and made of finitely many quadratic pieces.
    """
    k = len(targets)

    def sums(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half of sum n rate^2, sum n rate p, and sum n p p^T where the rate is above 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + k + k * k)
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                r = rates_of(p, pull)
                free = p[r > 0]
                total[0] += 0.5 * (n * r) @ r
                total[1 : k + 1] += (n * r) @ p
                total[k + 1 :] += ((free * n[r > 0, None]).T @ free).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

        out = np.zeros(1 + k + k * k)
        for r in members.select("n_tokens", "p").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return float(out[0]), out[1 : k + 1], out[k + 1 :].reshape(k, k)

    pull, scale = np.zeros(k), max(float(targets.sum()), 1e-300)
    half, got, moments = sums(pull)
    hold = ridge * (moments + np.eye(k) * max(np.trace(moments), 1e-300) * 1e-9)
    value = half
    while np.abs(got - targets).max() > tolerance * scale:
        slope = targets - got + hold @ pull
        step = np.linalg.lstsq(moments + hold, -slope, rcond=None)[0]
        down, size = float(slope @ step), 1.0
        if not down < -1e-14 * abs(value):
            break
        while True:
            ahead = pull + size * step
            half, there, around = sums(ahead)
            new = half + float(ahead @ targets) + 0.5 * float(ahead @ hold @ ahead)
            if new <= value + 1e-4 * size * down or size < 1e-12:
                break
            size /= 2
        if not new < value:
            break
        pull, got, moments, value = ahead, there, around, new
    return pull, float(np.abs(got - targets).max() / scale)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], scratch: Scratch, total_tokens: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, miss), or the columns in carry and these, for every row of docs(doc_id, text).

    posterior gives the probability of each domain of labels(doc_id, domain),
    domain the likeliest. rate is how often to take the document: with these,
    the expected tokens (words) of the domains come to total_tokens (by
    default, as many as there are) in the proportions of targets. Targets of
    domains that no label has are left out and the others scaled; where
    nonnegative rates can't meet them, they come as near as least squares does.
    miss, the same in every row, is how far the domain that fares worst is from
    its target, as a share of all tokens.

    Null and empty texts have no tokens and the rate their posterior gives.
    Without labels, or with targets that sum to 0, posteriors are empty or
    kept, every rate is 1 and miss is null. Rows are independent, so repeats
    and null ids stay as they come.
    """
    model = fit_domains(docs, labels, scratch)
    names = model.names if model else []
    plain = docs.select(F.col("doc_id").cast("bigint")) if carry is None else docs.select(*map(quoted, carry))
    given = [F.col("doc_id").cast("bigint").alias("c0")] if carry is None else [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)]
    width = len(given)
    own = [StructField(f"c{i}", f.dataType) for i, f in enumerate(plain.schema.fields)]
    made = StructType([*own, *StructType.fromDDL("n_tokens bigint, p array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(width)]
            n = np.array([len((t or "").split()) for t in texts], np.int64)
            p = [model.posterior(t).tolist() if model else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n), pa.array(p, pa.list_(pa.float64()))], made.names)

    members = scratch.save(docs.select(*given, F.col("text").alias("read")).mapInArrow(run, made), "members")
    goal = np.array([float(targets.get(d, 0)) for d in names])
    pull, miss = np.zeros(len(names)), None
    if goal.sum() > 0:
        total = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] if total_tokens is None else total_tokens
        if total:
            pull, miss = fit_rates(members, goal / goal.sum() * total)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(width + 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            likely = [names[i] for i in p.argmax(axis=1)] if names else [None] * len(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(likely, pa.string()), pa.array(rates_of(p, pull))], [*made.names, "domain", "rate"])

    out = members.mapInArrow(rate, StructType([*made.fields, *StructType.fromDDL("domain string, rate double").fields]))
    posterior = F.map_from_arrays(F.array(*map(F.lit, names)).cast("array<string>"), "p")
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(plain.schema.fields)), "n_tokens", "domain", posterior.alias("posterior"), "rate", F.lit(miss).cast("double").alias("miss"))
