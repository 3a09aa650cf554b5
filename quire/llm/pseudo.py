"""Scores of documents by masked pseudo-likelihood under a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunks import MAIL_SCHEMA, Chunk, chunk_size, each_chunk, pack, runs, squeeze, unsqueeze
from quire.llm.common import Scratch
from quire.llm.latent import _grouped, word_hashes

#: Buckets of hashed words that are counted over the corpus.
BUCKETS = 1 << 16
#: Token ids: CLASSES classes of CLASSES tokens; the frequent buckets have their own, the others share SHARED.
CLASSES = 64
TOKENS = CLASSES * CLASSES
SHARED = 1024
OFFSETS = np.array([-3, -2, -1, 1, 2, 3])
EMBED, HIDDEN = 8, 16
#: Rounds of training; each visits its own part of the tokens, all of them together every token once.
ROUNDS = 2
BATCH = 4096
#: Logits are held at this, so that their exponents stay finite.
CEILING = np.float32(40)
#: Bytes of text for each shard of the word counts, about.
SHARD_BYTES = 1 << 24
#: Models that are averaged in one task, or on the driver.
FAN_IN = 32


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


class Vocabulary:
    """Token id of each bucket: ids of the commonest first, dealt over the classes; the rest by hash. The last id is the edge of a text."""

    def __init__(self, counts: np.ndarray):
        own = TOKENS - SHARED - 1
        rank = np.lexsort((np.arange(BUCKETS), -counts))
        place = np.empty(BUCKETS, np.int64)
        place[rank] = np.arange(BUCKETS)
        place = np.where(place < own, place, own + np.arange(BUCKETS) % SHARED)
        self.ids = (place % CLASSES * CLASSES + place // CLASSES).astype(np.int32)
        self.edge = TOKENS - 1
        self.share = np.bincount(self.ids, counts + 0.1, minlength=TOKENS)
        #: Words that each token stands for, one more for all that the corpus doesn't have.
        self.words = np.bincount(self.ids, counts, minlength=TOKENS) + 1

    def sequence(self, h: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """All tokens with edges around each text, and the place of each word of hash h and text doc in them."""
        pad = int(OFFSETS.max())
        at = np.arange(len(h)) + pad * (doc + 1)
        seq = np.full(len(h) + pad * (texts + 1), self.edge, np.int32)
        seq[at] = self.ids[_bucket(h)]
        return seq, at

    def inside(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each word among those of its token, by its count in the corpus."""
        return np.log(np.maximum(counts, 1) / self.words[self.ids[_bucket(h)]])


SHAPES = {
    "embed": (TOKENS, EMBED),
    "w1": (len(OFFSETS) * EMBED, HIDDEN),
    "b1": (HIDDEN,),
    "wc": (HIDDEN, CLASSES),
    "bc": (CLASSES,),
    "wo": (CLASSES, HIDDEN, CLASSES),
    "bo": (CLASSES, CLASSES),
}


class Network:
    """Predicts a token from those on both sides: first its class, then the token in the class."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def fresh(cls, share: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; the biases are the corpus's frequencies, so that it starts as a unigram model."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), np.float32))
        for name in ("embed", "w1", "wc", "wo"):
            p = getattr(net, name)
            p[:] = rng.standard_normal(p.shape) * {"embed": 0.3, "w1": 1 / np.sqrt(len(p)), "wc": 0.1, "wo": 0.1}[name]
        p = (share + 1e-3).reshape(CLASSES, CLASSES)
        net.bc[:] = np.log(p.sum(axis=1) / p.sum())
        net.bo[:] = np.log(p / p.sum(axis=1, keepdims=True))
        return net

    def forward(self, seq: np.ndarray, at: np.ndarray) -> tuple:
        around = seq[at[:, None] + OFFSETS]
        x = self.embed[around].reshape(len(at), -1)
        return around, x, np.tanh(x @ self.w1 + self.b1)

    @staticmethod
    def exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, in place and held at CEILING or less, and its sum by row."""
        np.exp(np.minimum(z, CEILING, out=z), out=z)
        return z, z @ np.ones(z.shape[1], z.dtype)

    def by_class(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Places in order of their tokens' classes, the order, and each class with where it begins and ends."""
        order = np.argsort(seq[at], kind="stable")
        return at[order], order, list(zip(*(x.tolist() for x in runs(seq[at][order] // CLASSES)), strict=True))

    def logits(self, h: np.ndarray, kind: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Of the tokens in each row's class."""
        z = self.bo[kind]
        for c, a, b in classes:
            z[a:b] += h[a:b] @ self.wo[c]
        return z

    def log_probability(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each token at the places, given those around it."""
        out = np.zeros(len(at))
        for s in range(0, len(at), 1 << 14):
            place, order, classes = self.by_class(seq, at[s : s + (1 << 14)])
            h = self.forward(seq, place)[2]
            kind, inner = np.divmod(seq[place], CLASSES)
            rows = np.arange(len(place))
            z, total = self.exponents(h @ self.wc + self.bc)
            p = z[rows, kind].astype(np.float64) / total
            z, total = self.exponents(self.logits(h, kind, classes))
            out[s + order] = np.log(np.maximum(p * z[rows, inner] / total, 1e-300))
        return out

    def gradient(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability of the tokens at the places."""
        g = Network(np.zeros_like(self.flat))
        at, _, classes = self.by_class(seq, at)
        around, x, h = self.forward(seq, at)
        kind, inner = np.divmod(seq[at], CLASSES)
        rows, one = np.arange(len(at)), np.ones(len(at), h.dtype)
        d, total = self.exponents(h @ self.wc + self.bc)
        d *= (1 / (total * len(at)))[:, None]
        d[rows, kind] -= 1 / len(at)
        g.wc[:], g.bc[:] = h.T @ d, one @ d
        dh = d @ self.wc.T
        d, total = self.exponents(self.logits(h, kind, classes))
        d *= (1 / (total * len(at)))[:, None]
        d[rows, inner] -= 1 / len(at)
        for c, a, b in classes:
            part = d[a:b]
            g.wo[c], g.bo[c] = h[a:b].T @ part, one[a:b] @ part
            dh[a:b] += part @ self.wo[c].T
        dh *= 1 - h * h
        g.w1[:], g.b1[:] = x.T @ dh, one @ dh
        cell = (around.reshape(-1, 1) * EMBED + np.arange(EMBED, dtype=np.int32)).ravel()
        g.embed[:] = np.bincount(cell, (dh @ self.w1.T).ravel(), minlength=g.embed.size).reshape(g.embed.shape)
        return g.flat


class Adam:
    """Steps down a gradient, by its running mean and size."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.room, self.step, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), np.empty(size, np.float32), 0, rate

    def move(self, flat: np.ndarray, g: np.ndarray) -> None:
        self.step += 1
        self.m *= np.float32(0.9)
        self.m += np.multiply(g, np.float32(0.1), out=self.room)
        self.v *= np.float32(0.99)
        np.multiply(g, g, out=g)
        g *= np.float32(0.01)
        self.v += g
        size = np.sqrt(self.v, out=self.room)
        size *= np.float32(1 / np.sqrt(1 - 0.99**self.step))
        size += np.float32(1e-6)
        np.divide(self.m, size, out=size)
        size *= np.float32(self.rate / (1 - 0.9**self.step))
        flat -= size


class WordCounts:
    """Occurrences of every word of a corpus, by 64-bit hash, in a written table of shards."""

    SCHEMA = "shard bigint, words binary, counts binary"

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    @staticmethod
    def dealt(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the places of its words in h, distinct hashes."""
        shard = (h >> np.uint64(16)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        for s, a, b in zip(*runs(shard[order]), strict=True):
            yield int(s), order[a:b]

    @classmethod
    def of(cls, docs: DataFrame, scratch: Scratch) -> WordCounts:
        """Counts over all texts of docs; a task adds up some texts before it sends their words on."""
        size = chunk_size(docs)
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(1, -(-total // SHARD_BYTES))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in _grouped(batches, size):
                h, n = np.unique(word_hashes(texts)[0], return_counts=True)
                rows = [(s, squeeze(h[at]), squeeze(n[at].astype(np.uint32))) for s, at in cls.dealt(h, shards)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "words", "counts"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            h = np.concatenate([unsqueeze(b, np.uint64) for b in pdf["words"]])
            n = np.concatenate([unsqueeze(b, np.uint32) for b in pdf["counts"]])
            h, at = np.unique(h, return_inverse=True)
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "words": [squeeze(h)], "counts": [squeeze(np.bincount(at, n, len(h)).astype(np.int64))]})

        rows = docs.select(F.lit(None).cast("bigint").alias("id"), "text").mapInArrow(send, cls.SCHEMA)
        return cls(scratch.save(rows.groupBy("shard").applyInPandas(add, cls.SCHEMA), "words"), shards)

    def buckets(self) -> np.ndarray:
        """Occurrences of each word bucket."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n += np.bincount(_bucket(unsqueeze(words, np.uint64)), unsqueeze(counts, np.int64), BUCKETS).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

        rows = self.table.select("words", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(BUCKETS, np.int64)
        n[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return n

    def told(self, chunks: DataFrame, scratch: Scratch) -> DataFrame:
        """Mail 'count' for chunks: the counts of a chunk's distinct words, shard by shard, 0 for unknown ones."""
        shards = self.shards

        def ask(chunk: Chunk) -> Iterator[tuple]:
            h = np.unique(word_hashes(chunk.texts())[0])
            for s, at in WordCounts.dealt(h, shards):
                yield chunk.id, s, squeeze(h[at])

        def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            words, counts = (unsqueeze(known[c].iloc[0], k) if len(known) else np.zeros(0, k) for c, k in (("words", np.uint64), ("counts", np.int64)))
            data = []
            for b in asked["words"]:
                h = unsqueeze(b, np.uint64)
                at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                data.append(squeeze(np.where(words[at] == h, counts[at], 0) if len(words) else np.zeros(len(h), np.int64)))
            return pd.DataFrame({"chunk": asked["chunk"], "kind": "count", "shard": asked["shard"], "data": data})

        sent = each_chunk(chunks, ask, "chunk bigint, shard bigint, words binary").groupBy("shard")
        return scratch.save(sent.cogroup(self.table.groupBy("shard")).applyInPandas(answer, MAIL_SCHEMA), "told")


def _mean(models: DataFrame, scratch: Scratch, tag: str) -> np.ndarray | None:
    """Weighted mean of models(part, weight, model): by groups of FAN_IN until so many are left."""
    level = 0
    while models.count() > FAN_IN:

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            w = pdf["weight"].to_numpy()
            total = sum(x * np.frombuffer(b, np.float32) for x, b in zip(w, pdf["model"], strict=True))
            return pd.DataFrame({"part": pdf["part"].iloc[:1] // FAN_IN, "weight": [w.sum()], "model": [(total / w.sum()).astype(np.float32).tobytes()]})

        level += 1
        models = scratch.save(models.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, "part bigint, weight double, model binary"), f"{tag}-{level}")
    rows = models.toPandas()
    if not len(rows):
        return None
    w = rows["weight"].to_numpy() / rows["weight"].sum()
    return sum(x * np.frombuffer(b, np.float32) for x, b in zip(w, rows["model"], strict=True)).astype(np.float32)


def train(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS, rate: float = 0.01, batch: int = BATCH) -> tuple[WordCounts, Vocabulary, Network]:
    """Word counts, vocabulary and network from all partitions of docs(text).

    Words are counted over all texts. In each round, every partition of the
    input trains a copy of the network on a part of its own tokens, dealt at
    random: every token is predicted in one of the rounds. The copies are
    averaged, weighted by tokens. The tokens visited and the models gathered
    grow with the input; a model's size doesn't. The network, unlike the
    counts, depends on how the rows are dealt out to partitions.
    """
    counts = WordCounts.of(docs, scratch)
    vocabulary = Vocabulary(counts.buckets())
    net = Network.fresh(vocabulary.share)
    spark = docs.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, net.flat))

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            rng = np.random.default_rng(part)
            vocabulary, flat = sent.value
            net = Network(flat.copy())
            adam, seen = Adam(len(flat), rate), 0
            for _, texts in _grouped(batches):
                h, doc = word_hashes(texts)
                seq, at = vocabulary.sequence(h, doc, len(texts))
                at = rng.permutation(at[rng.integers(0, rounds, len(at)) == turn])
                for s in range(0, len(at), batch):
                    adam.move(net.flat, net.gradient(seq, at[s : s + batch]))
                seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([net.flat.tobytes()], pa.binary())], ["part", "weight", "model"])

        models = docs.select(F.lit(None).cast("bigint").alias("id"), "text").mapInArrow(learn, "part bigint, weight double, model binary")
        mean = _mean(scratch.save(models, f"models-{turn}"), scratch, f"mean-{turn}")
        net = net if mean is None else Network(mean)
    return counts, vocabulary, net


def score_documents(docs: DataFrame, model: tuple[WordCounts, Vocabulary, Network], scratch: Scratch) -> DataFrame:
    """(doc_id, n_words, pseudo_log_likelihood, mean_log_probability) for every row of docs(doc_id, text).

    Words are runs of letters and digits, lower-cased. Every one of them is
    masked and predicted from three on each side: the network gives the
    probability of its token, and the word's count in the corpus its share of
    the words of that token, all unknown words together counting as one that
    occurs once. The logarithms are summed. Null texts and texts without words
    have sum 0 and a null mean. Rows are independent, so repeats and null ids
    stay as they come. Extra columns are not looked at.
    """
    counts, vocabulary, net = model
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat))
    shards, chunks = counts.shards, pack(docs, scratch)
    mail = counts.told(chunks, scratch)

    def run(chunk: Chunk) -> Iterator[tuple]:
        vocabulary, flat = sent.value
        net, replies = Network(flat), chunk.mail.get("count", [])
        h, doc = word_hashes(chunk.texts())
        distinct, which = np.unique(h, return_inverse=True)
        found = np.zeros(len(distinct), np.int64)
        for (_, at), b in zip(WordCounts.dealt(distinct, shards), replies, strict=True):
            found[at] = unsqueeze(b, np.int64)
        seq, at = vocabulary.sequence(h, doc, len(chunk.order))
        n = np.bincount(doc, minlength=len(chunk.order))
        total = np.bincount(doc, net.log_probability(seq, at) + vocabulary.inside(h, found[which]), minlength=len(chunk.order))
        for i in range(len(chunk.order)):
            yield int(chunk.order[i]) if chunk.known[i] else None, int(n[i]), float(total[i]), float(total[i] / n[i]) if n[i] else None

    return each_chunk(chunks, run, "doc_id bigint, n_words bigint, pseudo_log_likelihood double, mean_log_probability double", mail)
