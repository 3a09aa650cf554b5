"""Substring dedup on word windows: count-min prefilter, then exact grouping."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunks import MAIL_SCHEMA, SHARD_KEYS, Chunk, Sketch, Sums, digest, each_chunk, later_copies, pack, runs, squeeze, unsqueeze
from quire.llm.common import Scratch, mix64


class Windows:
    """The windows of a chunk, grouped word by word; each group's smallest document order."""

    def __init__(self, chunk: Chunk, width: int):
        self.words, self.width = chunk.words(), width
        h, ids, self.doc = self.words.hash, self.words.ids, self.words.doc
        n = max(0, len(h) - width + 1)
        start = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :][:n]) if n else np.zeros(0, np.int64)
        first = mix64(Sums(h).of(start, start + width))
        order = np.argsort(first)
        a = first[order]
        new = np.append(True, a[1:] != a[:-1])[: len(a)]
        # Windows of one hash are compared word by word with the first of them.
        again = np.flatnonzero(~new)
        lead = order[np.flatnonzero(new)[np.cumsum(new)[again] - 1]]
        if any(np.any(ids[start[order[again]] + j] != ids[start[lead] + j]) for j in range(width)):
            order = np.lexsort((*(ids[start + j] for j in range(width)), first))
            new = np.append(True, np.any([ids[start[order[1:]] + j] != ids[start[order[:-1]] + j] for j in range(width)], axis=0))
        at = np.flatnonzero(new)
        self.start, self.group = start, np.empty(len(start), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.first, self.lead = first[order][at], order[at]
        owner = chunk.order[self.doc[start[order]]]
        self.low = np.minimum.reduceat(owner, at) if len(at) else owner
        self.several = (np.maximum.reduceat(owner, at) if len(at) else owner) > self.low

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.first, 1 + self.several

    def active(self, chunk: Chunk) -> np.ndarray:
        """Groups that a text other than a later copy has."""
        out = np.zeros(len(self.first), bool)
        out[self.group[~chunk.copy[self.doc[self.start]]]] = True
        return out

    def digests(self, groups: np.ndarray) -> bytes:
        """Digests of the groups' words, joined by one space."""
        start, text = self.start[self.lead[groups]], memoryview(self.words.joined)
        return b"".join(digest(text[a:b]) for a, b in zip(self.words.off[start].tolist(), (self.words.off[start + self.width] - 1).tolist(), strict=True))


def _sent(chunk: Chunk, windows: Windows, sketch: Sketch, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Groups that go to the exact pass, by shard, and each shard with where its groups begin and end."""
    maybe = np.flatnonzero(sketch.estimate(chunk, windows.first)[0] & windows.active(chunk))
    shard = (windows.first[maybe] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return maybe[order], list(zip(*(x.tolist() for x in runs(shard[order])), strict=True))


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = 13, *, shard_keys: int = SHARD_KEYS, cells_per_key: int = 3, chunk_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts without words of windows that an earlier document has.

    A window is ``width`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one row's
    text. A word goes if a window that covers it also starts in a document
    with a smaller doc_id, judged on the input. text holds the kept words,
    joined by one space.

    The first pass counts windows in a count-min sketch: each chunk sends its
    non-empty cells, a shard adds them up and answers which cells hold two or
    more. Its size follows the input, so the share of false alarms doesn't; an
    overestimate costs work, never a result, and an underestimate can't be.
    The second pass groups the estimated windows exactly: in a chunk word by
    word, between chunks by 128-bit BLAKE2b digests of the words. Each chunk
    sends a window once with its smallest doc_id, so a window that everyone has
    costs no more than one entry for each chunk.

    Null text has no words and gives an empty text. A null doc_id is later than
    any other, and equal to other nulls. Rows that repeat a doc_id are one
    document's: they don't take windows from one another. Extra columns are not
    looked at; an empty table gives an empty result. Texts stay whole: a long
    one is a chunk of its own and takes some 20 times its bytes in a worker.
    """
    chunks = pack(docs, scratch, chunk_bytes)
    keys = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    sketch = Sketch(keys, shard_keys, cells_per_key)
    copies = later_copies(chunks, scratch)
    often = sketch.repeated(chunks, lambda c: Windows(c, width).keys(), scratch)
    mail = copies.unionByName(often)
    shards = sketch.shards

    def send(chunk: Chunk) -> Iterator[tuple]:
        w = Windows(chunk, width)
        maybe, cut = _sent(chunk, w, sketch, shards)
        for s, a, b in cut:
            low, at = np.unique(w.low[maybe[a:b]], return_inverse=True)
            yield chunk.id, s, w.digests(maybe[a:b]), squeeze(low), squeeze(at.astype(np.uint32))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in pdf["digests"]]).T
        low = np.concatenate([unsqueeze(x, np.int64)[unsqueeze(a, np.uint32)] for x, a in zip(pdf["low"], pdf["at"], strict=True)])
        order = np.lexsort((low, second, first))
        new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
        least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        earlier = np.empty(len(low), bool)
        earlier[order] = least < low[order]
        ends = np.cumsum([len(b) // 16 for b in pdf["digests"]])
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": "earlier", "shard": pdf["shard"], "data": [np.packbits(x).tobytes() for x in np.split(earlier, ends[:-1])]})

    sent = each_chunk(chunks, send, "chunk bigint, shard bigint, digests binary, low binary, at binary", mail)
    earlier = scratch.save(sent.groupBy("shard").applyInPandas(group, MAIL_SCHEMA), "earlier")

    def cut_out(chunk: Chunk) -> Iterator[tuple]:
        w = Windows(chunk, width)
        maybe, cut = _sent(chunk, w, sketch, shards)
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=b - a).astype(bool) for x, (_, a, b) in zip(chunk.mail.get("earlier", []), cut, strict=True)]
        gone = np.zeros(len(w.first), bool)
        gone[maybe[np.concatenate(flags)] if flags else maybe] = True
        owner = w.doc[w.start]
        hit = w.start[gone[w.group] | (chunk.order[owner] > w.low[w.group]) | chunk.copy[owner]]
        edge = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        keep = np.cumsum(edge[:-1]) == 0
        bounds = np.searchsorted(w.doc, np.arange(len(chunk.order) + 1))
        for i in range(len(chunk.order)):
            kept, words = keep[bounds[i] : bounds[i + 1]], chunk.text(i).split()
            left = int(kept.sum())
            if left < len(words):
                words = compress(words, kept.tolist())
            yield int(chunk.order[i]) if chunk.known[i] else None, len(kept), len(kept) - left, b" ".join(words).decode()

    return each_chunk(chunks, cut_out, "doc_id bigint, n_words bigint, n_removed bigint, text string", mail.unionByName(earlier))
