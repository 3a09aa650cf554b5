"""Benchmark decontamination by latent semantic retrieval and sequence checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quire.llm.chunks import Sums, quoted
from quire.llm.common import Scratch, mix64, shuffle_parts

#: Buckets of hashed words for document frequencies.
BUCKETS = 1 << 17
#: Words of a passage whose frequencies are counted, and of a step of the search.
BLOCK = 16
PASSAGE = 32
#: Words in more than this share of passages weigh nothing.
COMMON = 0.005
#: Passages, at least, that each item weighs as much as in the latent space; all items weigh as much as all passages.
ITEM_WEIGHT = 100
#: Columns of the space that tasks send on together to be added up.
PIECE = 32
#: Benchmark items of one latent space; more items are searched in several passes.
SPACE_ITEMS = 256
EXTRA_RANK = 32
#: Latent spaces that a worker holds at a time.
SPACES_AT_ONCE = 2
#: Length of a word's unweighted latent vector under which it is left out.
WEAK = 0.05
COSINE = 0.3
SIMILARITY = 0.8
#: A match this similar counts too if the item's answer stands in it word by word.
ANSWERED = 0.6
#: Rare words of an item that are looked for beyond those that a hit may lack.
PROBED = 4
#: Bytes of text that are looked at together.
GROUP_BYTES = 1 << 20

HIT = StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("start_word", LongType()), StructField("end_word", LongType())])

_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word (letters and digits) of some texts, and which text it is of."""
    parts = [(t or "").lower().encode() for t in texts]
    off = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _WORD[buf]
    start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    end = np.flatnonzero(~inside & np.append(False, inside[:-1]))
    h = mix64(Sums(buf + np.uint64(1)).of(start, end) + (end - start).astype(np.uint64))
    return h, np.searchsorted(off, start, "right") - 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about size bytes at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            held += len(texts[-1] or "")
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _places(doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's block of ``size`` words (blocks don't cross texts), and the first word of each block."""
    if not len(doc):
        return doc, doc
    first = np.flatnonzero(np.append(True, np.diff(doc) != 0))
    at = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    new = at % size == 0
    return np.cumsum(new) - 1, np.flatnonzero(new)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of PASSAGE words each bucket occurs, over all texts, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(BUCKETS, np.int64), 0
        for _, texts in _grouped(batches):
            h, doc = word_hashes(texts)
            block, first = _places(doc, PASSAGE)
            key = np.sort(block * BUCKETS + _bucket(h))
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            total += np.bincount(key % BUCKETS, minlength=BUCKETS)
            passages += len(first)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS)), pa.array(np.append(total[at], passages))], ["bucket", "n"])

    rows = docs.select(F.lit(None).cast("bigint").alias("none"), "text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS + 1, np.int64)
    n[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return n[:-1], int(n[-1])


class Items:
    """The benchmark items of one space, as word hashes."""

    def __init__(self, ids: list, texts: list[str | None], answers: list[str | None]):
        h, item = word_hashes(texts)
        cut = np.searchsorted(item, np.arange(len(texts) + 1))
        keep = [k for k in range(len(texts)) if cut[k] < cut[k + 1]]
        self.ids = [ids[k] for k in keep]
        self.words = [h[cut[k] : cut[k + 1]] for k in keep]
        a, owner = word_hashes(answers)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.answers = [a[cut[k] : cut[k + 1]].tolist() for k in keep]


def last_sentence(text: str | None) -> str | None:
    """What stands for the answer of an item without one: its last sentence, if it isn't the only one."""
    parts = [p for p in (text or "").replace("?", ".").replace("!", ".").split(".") if p.strip()]
    return parts[-1] if len(parts) > 1 else None


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Space:
    """A latent space: a vector for each bucket that matters, and the items in it."""

    def __init__(self, items: Items, df: np.ndarray, passages: int, docs: DataFrame, seed: int = 11):
        weight = np.log((passages + 1) / (df + 1.0))
        common = df > COMMON * max(passages, 50)
        weight[common] = 0
        for words in items.words:  # an item of common words alone keeps its own
            if (weight[_bucket(words)] > 0).mean() < 0.2:
                b = _bucket(words)
                weight[b] = np.maximum(weight[b], np.log((passages + 1) / (df[b] + 1.0)) + 0.1)
        self.weight = np.maximum(weight, 0)
        # Only an item's words can be met in a hit: others have no vector, and make windows longer.
        active = np.zeros(BUCKETS, bool)
        for words in items.words:
            active[_bucket(words)] = True
        self.row = np.full(BUCKETS, -1, np.int32)
        self.row[active & (self.weight > 0)] = np.arange((active & (self.weight > 0)).sum())
        basis = self._svd(items, docs, passages, len(items.words) + EXTRA_RANK, seed)
        # Words that the space hardly knows add next to nothing to a cosine.
        known = np.linalg.norm(basis, axis=1) >= WEAK
        self.row[self.row >= 0] = np.where(known, np.cumsum(known) - 1, -1)
        self.vectors = (basis[known] * self.weight[self.row >= 0, None]).astype(np.float32)
        self.bound = np.linalg.norm(self.vectors, axis=1).astype(np.float64)
        self.items = np.zeros((len(items.words), self.vectors.shape[1]), np.float32)
        for k, words in enumerate(items.words):
            r = self.row[_bucket(words)]
            v = self.vectors[r[r >= 0]].sum(axis=0)
            self.items[k] = v / max(float(np.linalg.norm(v)), 1e-12)

    def _svd(self, items: Items, docs: DataFrame, passages: int, rank: int, seed: int) -> np.ndarray:
        """Right singular vectors of the items' and all texts' passages by a randomised range finder.

        One pass over the texts adds up A^T*(A*Omega), whose columns span the
        space; made orthonormal they are the singular vectors but for a
        rotation, which no cosine depends on. Items weigh as much as all
        passages, so that the space holds what tells items apart. Omega's
        random signs are made anew in each task; the driver gets the sum alone.
        """
        weight, row, columns = self.weight, self.row, int((self.row >= 0).sum())

        def rows_of(h: np.ndarray, block: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Unit TF-IDF rows as (block, column, value)."""
            bucket = _bucket(h)
            value = weight[bucket]
            norm = np.sqrt(np.bincount(block, value**2, minlength=n))
            keep = np.flatnonzero(row[bucket] >= 0)
            return block[keep], row[bucket[keep]], value[keep] / np.maximum(norm[block[keep]], 1e-12)

        def signs() -> np.ndarray:
            return np.random.default_rng(seed).integers(0, 2, (columns, rank), np.int8) * np.int8(2) - np.int8(1)

        def project(omega: np.ndarray, block: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
            y = np.zeros((n, rank), np.float32)
            for s in range(0, len(block), 1 << 15):
                part = slice(s, s + (1 << 15))
                first = np.flatnonzero(np.append(True, np.diff(block[part]) != 0))
                y[block[part][first]] += np.add.reduceat(omega[column[part]] * value[part, None].astype(np.float32), first)
            return y

        def back(block: np.ndarray, column: np.ndarray, value: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Non-empty columns of A, and A^T*q for them."""
            order = np.argsort(column, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(column[order]) != 0)[: len(order)])
            out = np.zeros((len(at), q.shape[1]), np.float32)
            for s in range(0, len(at), 2048):
                rows = order[at[s] : at[s + 2048] if s + 2048 < len(at) else len(order)]
                out[s : s + 2048] = np.add.reduceat(q[block[rows]] * value[rows, None].astype(np.float32), at[s : s + 2048] - at[s])
            return column[order][at], out

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            omega, total = signs(), np.zeros((columns, rank))
            for _, texts in _grouped(batches):
                h, doc = word_hashes(texts)
                place, first = _places(doc, PASSAGE)
                entries = rows_of(h, place, len(first))
                at, add = back(*entries, project(omega, *entries, len(first)))
                total[at] += add
            for piece, s in enumerate(range(0, columns, PIECE)):
                if total[s : s + PIECE].any():
                    yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([total[s : s + PIECE].astype(np.float32).tobytes()], pa.binary())], ["piece", "b"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[piece] = total.get(piece, 0) + np.frombuffer(part, np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "b"])

        own = [rows_of(w, np.zeros(len(w), np.int64), 1) for w in items.words]
        block = np.concatenate([np.full(len(r[1]), k) for k, r in enumerate(own)])
        times = math.sqrt(max(ITEM_WEIGHT, passages / len(items.words)))
        entries = block, np.concatenate([r[1] for r in own]), times * np.concatenate([r[2] for r in own])
        b = np.zeros((columns, rank))
        at, add = back(*entries, project(signs(), *entries, len(items.words)))
        b[at] += add
        sent = docs.select(F.lit(None).cast("bigint").alias("none"), "text").mapInArrow(parts, "piece bigint, b binary")
        summed = sent.repartition(shuffle_parts(docs.sparkSession), "piece").mapInArrow(added, "piece bigint, b binary").toArrow()
        for piece, part in zip(summed["piece"].to_pylist(), summed["b"].to_pylist(), strict=True):
            b[piece * PIECE : (piece + 1) * PIECE] += np.frombuffer(part).reshape(-1, rank)
        lam, u = np.linalg.eigh(b.T @ b)
        good = lam > lam.max(initial=0) * 1e-9
        return b @ (u[:, good] / np.sqrt(lam[good]))


def _classes(items: Items) -> list[tuple[int, np.ndarray]]:
    """(blocks of a window, items): a window holds the items of its class whole wherever they begin."""
    out: dict[int, list[int]] = {}
    for k, w in enumerate(items.words):
        blocks = 1
        while blocks * BLOCK < len(w):
            blocks *= 2
        out.setdefault(blocks + 1, []).append(k)
    return [(n, np.array(ks)) for n, ks in sorted(out.items())]


def candidates(space: Space, classes: list[tuple[int, np.ndarray]], h: np.ndarray, doc: np.ndarray, cosine: float) -> np.ndarray:
    """Columns (first word, words after the window's last, item) of windows near an item in the latent space."""
    block, first = _places(doc, BLOCK)
    if not len(first):
        return np.zeros((3, 0), np.int64)
    bucket = _bucket(h)
    square = np.append(0, np.cumsum(np.bincount(block, space.weight[bucket] ** 2, minlength=len(first))))
    row = space.row[bucket]
    known = np.flatnonzero(row >= 0)
    reach = np.append(0, np.cumsum(np.bincount(block[known], space.bound[row[known]], minlength=len(first))))
    owner = doc[first]
    last = np.searchsorted(owner, owner, "right")
    tried, wanted = [], np.zeros(len(first) + 1, np.int64)
    for n, items in classes:
        # Windows of n blocks; a text's last blocks make shorter ones.
        stop = np.minimum(np.arange(len(first)) + n, last)
        norm = np.sqrt(square[stop] - square[: len(first)])
        # The vectors' norms bound the cosine from above: many windows end here.
        live = np.flatnonzero((reach[stop] - reach[: len(first)] >= cosine * norm) & (norm > 0))
        tried.append((items, live, stop[live], norm[live]))
        np.add.at(wanted, live, 1)
        np.add.at(wanted, stop[live], -1)
    known = known[np.cumsum(wanted)[block[known]] > 0]
    # Sums of the vectors of all wanted blocks up to each: a window's vector is a difference of two.
    upto = np.zeros((len(first) + 1, space.items.shape[1]))
    if len(known):
        at = np.flatnonzero(np.append(True, np.diff(block[known]) != 0))
        upto[block[known[at]] + 1] = np.add.reduceat(space.vectors[row[known]], at)
        np.cumsum(upto, axis=0, out=upto)
    found = []
    for items, live, stop, norm in tried:
        for s in range(0, len(live), 2048):
            w, e = live[s : s + 2048], stop[s : s + 2048]
            v = (upto[e] - upto[w]).astype(np.float32)
            win, item = np.nonzero(v @ space.items[items].T >= cosine * norm[s : s + 2048][:, None])
            found.append(np.stack([first[w[win]], np.append(first, len(h))[e[win]], items[item]]))
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


class Probes:
    """Rare words by which texts that hold an item are found whatever their weights and vectors are.

    A window with similarity * n of an item's n words in order misses n minus
    that many places of it at most. Of the rarest places, PROBED more than that,
    PROBED are therefore met. An answer that counts has all its words met.
    """

    def __init__(self, items: Items, df: np.ndarray, similarity: float):
        entries, self.need = [], []
        for k, words in enumerate(items.words):
            missed = len(words) - int(np.ceil(similarity * len(words) - 1e-9))
            rare = words[np.argsort(df[_bucket(words)], kind="stable")][: missed + PROBED]
            entries += [(w, 2 * k, n) for w, n in zip(*np.unique(rare, return_counts=True), strict=True)]
            answer = np.unique(np.array(items.answers[k], np.uint64)) if len(items.answers[k]) >= 5 else np.zeros(0, np.uint64)
            answer = answer[np.argsort(df[_bucket(answer)], kind="stable")][:PROBED]
            entries += [(w, 2 * k + 1, 1) for w in answer]
            self.need += [len(rare) - missed, len(answer)]
        self.need = np.array(self.need, np.int64)
        entries.sort(key=lambda x: int(x[0]))
        word = np.array([e[0] for e in entries], np.uint64)
        self.probe, self.times = np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64)
        self.words, self.begin = np.unique(word, return_index=True)
        self.begin = np.append(self.begin, len(word))
        self.maybe = np.zeros(BUCKETS, bool)
        self.maybe[_bucket(self.words)] = True

    def candidates(self, classes: list[tuple[int, np.ndarray]], h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Columns as those of the function candidates: all windows that meet as many of a probe's words as they need."""
        block, first = _places(doc, BLOCK)
        at = np.flatnonzero(self.maybe[_bucket(h)])
        none = np.zeros((3, 0), np.int64)
        if not len(at) or not len(self.words):
            return none
        found = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        hit = self.words[found] == h[at]
        at, found = at[hit], found[hit]
        # A word that comes again in a block counts once, for as many places as it has in the item.
        place = np.sort(block[at] * len(self.words) + found)
        here, found = np.divmod(place[np.append(True, place[1:] != place[:-1])], len(self.words))
        n = self.begin[found + 1] - self.begin[found]
        entry = np.repeat(self.begin[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # All entries by probe and block, their places in the low bits.
        stride = len(first)
        packed = np.sort(((self.probe[entry] * stride + np.repeat(here, n)) << 8) | np.minimum(self.times[entry], 255))
        key, upto = packed >> 8, np.append(0, np.cumsum(packed & 255))
        probe, spot = np.divmod(key, stride)
        owner = doc[first]
        begin, end = np.searchsorted(owner, owner), np.searchsorted(owner, owner, "right")
        length = np.zeros(len(self.need), np.int64)
        for blocks, items in classes:
            length[2 * items] = length[2 * items + 1] = blocks
        # A window that has enough has it at the block of its last entry, looking back.
        back = np.maximum(spot - length[probe] + 1, begin[spot])
        enough = np.flatnonzero(upto[1:] - upto[np.searchsorted(key, probe * stride + back)] >= self.need[probe])
        out = []
        for blocks, _ in classes:
            own = enough[length[probe[enough]] == blocks]
            if not len(own):
                continue
            start = (spot[own][:, None] - np.arange(blocks)).ravel()
            window = (np.repeat(probe[own], blocks) * stride + start)[start >= np.repeat(begin[spot[own]], blocks)]
            p, s = np.divmod(np.unique(window), stride)
            stop = np.minimum(s + blocks, end[s])
            met = upto[np.searchsorted(key, p * stride + stop)] - upto[np.searchsorted(key, p * stride + s)]
            p, s, stop = (x[met >= self.need[p]] for x in (p, s, stop))
            out.append(np.stack([first[s], np.append(first, len(h))[stop], p // 2]))
        return np.concatenate(out, axis=1) if out else none


def smallest_hashed(docs: DataFrame, n: int) -> DataFrame:
    """(id, text), id null, of at most n distinct texts, those of smallest hashes: copies count as one."""
    hashes = docs.where("text is not null").select(F.xxhash64("text").alias("hash"))
    chosen = [r["hash"] for r in hashes.distinct().orderBy("hash").limit(n).collect()]
    limit = F.lit(chosen[-1] if chosen else 0)
    kept = docs.select(F.xxhash64("text").alias("hash"), "text").where("text is not null").where(F.col("hash") <= limit)
    return kept.groupBy("hash").agg(F.first("text").alias("text")).select(F.lit(None).cast("bigint").alias("id"), "text")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, cosine: float = COSINE, similarity: float = SIMILARITY, space_items: int = SPACE_ITEMS, spaces_at_once: int = SPACES_AT_ONCE, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, hits), or the columns in carry and hits, for every row of docs(doc_id, text).

    hits is an array of (item_id, similarity, start_word, end_word), one for
    each item of benchmark(item_id, text[, answer]) that the text holds, with
    the window where it is best. Similarity is the longest common subsequence
    of words over the item's length; 0.8 is a hit, and so is 0.6 where the
    answer's words (the last sentence's, if there is no answer column; five or
    more) stand together in the window.

    Word weights count all passages of docs. A latent space of the items' words
    is fitted for each block of items on all passages of docs and all of the
    block's items; every window of every text is then compared with every item
    of the block by cosine. Windows that hold enough of an item's rarest words
    are compared too, so that no window which is a hit is left to the cosine.
    The space is broadcast; its size is that of the block's words times its
    items and so is bounded; so is their number, as a larger benchmark
    is searched for in several passes, whose hits are joined by the texts' SHA-256.

    Null texts and texts or items without words have no hits. A null item_id
    is kept as a null in hits; repeated items are searched for once and count
    one by one; of equally similar windows the first is given. Rows are independent, so repeats and
    null ids stay as they come. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    tests = scratch.save(benchmark.select(F.col("item_id").cast("bigint"), "text", answer.alias("answer")).groupBy("text", "answer").agg(F.collect_list(F.struct("item_id")).alias("ids")), "items")
    blocks = -(-tests.count() // space_items)
    df, passages = document_frequencies(docs)

    def space(b: int) -> list[tuple]:
        """The items of a block and what finds them, if there are any."""
        part = tests.where(F.pmod(F.xxhash64("text", "answer"), F.lit(blocks)) == b).collect()
        texts = [r["text"] for r in part]
        answers = [r["answer"] if r["answer"] is not None else last_sentence(r["text"]) for r in part]
        items = Items([[i["item_id"] for i in r["ids"]] for r in part], texts, answers)
        return [spark.sparkContext.broadcast((items, Space(items, df, passages, docs), Probes(items, df, similarity)))] if items.words else []

    def hits_of(texts: list[str | None], searched: list) -> list[list[dict]]:
        h, doc = word_hashes(texts)
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        hits: list[list[dict]] = [[] for _ in texts]
        for sent in searched:
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            items, space, probes = sent.value
            classes = _classes(items)
            near = np.concatenate([candidates(space, classes, h, doc, cosine), probes.candidates(classes, h, doc)], axis=1)
            for s, e, k in np.unique(near, axis=1).T.tolist():
                words, window = items.words[k].tolist(), h[s:e].tolist()
                # No more of the item can stand in order than stands there at all.
                there, answered = set(window), len(items.answers[k]) >= 5
                if sum(map(there.__contains__, words)) < (min(similarity, ANSWERED) if answered else similarity) * len(words):
                    continue
                alike = common_subsequence(words, window) / len(words)
                ok = alike >= similarity or (alike >= ANSWERED and answered and _stands_in(items.answers[k], window))
                if ok and alike > best.get((doc[s], k), (0.0,))[0]:
                    best[doc[s], k] = alike, s - int(begin[doc[s]]), e - int(begin[doc[s]])
            for (d, k), (alike, s, e) in best.items():
                hits[d] += [{"item_id": i, "similarity": alike, "start_word": s, "end_word": e} for i in items.ids[k]]
        for row in hits:
            row.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start_word"]))
        return hits

    def search(rows: DataFrame, searched: list) -> DataFrame:
        """rows with the hits in their last column's text in its place."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                last = batch.num_columns - 1
                size = np.cumsum([0, *(len(t.as_py() or "") for t in batch.column(last))]) // GROUP_BYTES
                for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size[:-1])) + 1):
                    if len(part):
                        some = batch.slice(int(part[0]), len(part))
                        found = hits_of(some.column(last).to_pylist(), searched)
                        yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], "hits"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("hits", ArrayType(HIT))]))

    plain = [F.col("doc_id").cast("bigint")] if carry is None else [F.col(quoted(c)) for c in carry]
    names = docs.select(*plain).columns
    own = [c.alias(f"c{i}") for i, c in enumerate(plain)]
    text, passes = F.col("text").alias("searched"), [range(b, min(b + spaces_at_once, blocks)) for b in range(0, blocks, spaces_at_once)]
    if len(passes) <= 1:
        out = search(docs.select(*own, text), [x for b in range(blocks) for x in space(b)])
    else:
        found = []
        for k, some in enumerate(passes):
            searched = [x for b in some for x in space(b)]
            hits = search(docs.where("text is not null").select(F.sha2("text", 256).alias("digest"), text), searched)
            found.append(scratch.save(hits.where(F.size("hits") > 0).groupBy("digest").agg(F.first("hits").alias("hits")), f"hits-{k}"))
            for x in searched:
                x.destroy()
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        in_order = F.array_sort(F.transform(F.flatten(F.collect_list("hits")), lambda x: F.struct(x["item_id"].isNull().alias("a"), F.coalesce(x["item_id"], F.lit(0)).alias("b"), x["start_word"].alias("c"), x.alias("hit"))))
        every = every.groupBy("digest").agg(F.transform(in_order, lambda x: x["hit"]).alias("hits"))
        out = docs.select(*own, F.sha2("text", 256).alias("digest")).join(every, "digest", "left").withColumn("hits", F.coalesce("hits", F.array().cast(ArrayType(HIT))))
    return out.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)), "hits")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    found = benchmark_hits(docs.withColumnRenamed("hits", "hits given") if "hits" in docs.columns else docs, benchmark, scratch, carry=[c if c != "hits" else "hits given" for c in docs.columns])
    kept = found.where(F.size("hits") == 0).drop("hits")
    return kept.withColumnRenamed("hits given", "hits") if "hits" in docs.columns else kept


def _stands_in(part: list[int], whole: list[int]) -> bool:
    return any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))
