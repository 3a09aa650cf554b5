"""Exact substring dedup by a sparse, hash-compared suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from quire.llm.chunks import MAIL_SCHEMA, SEGMENT, SHARD_KEYS, Chunk, Sketch, Sums, digest, each_chunk, later_copies, pack, powers, runs, squeeze, unsqueeze
from quire.llm.common import MIX, Scratch, mix64

#: Bytes of an anchor; of every ``length`` bytes the leftmost anchor with the smallest hash is chosen.
ANCHOR = 37
#: Suffixes that are sorted at once, in whole groups.
PIECE = 20_000
#: Occurrences of an anchor above which the strings around it are dealt out one by one.
HOT = 50_000
_LOW = np.uint64(0xFFFFFFFF)


class SuffixOrder:
    """Rows of bytes (zero-padded matrix and lengths) sorted inside their groups.

    Prefix polynomial hashes of all rows are made once. The common extension
    of two rows is found by binary search over equal prefix hashes, so that a
    comparison takes a logarithm of the row length; a bottom-up mergesort uses
    it for all elements of a level at a time. Neighbours' extensions are then
    verified on the bytes; after a collision the piece is sorted by its bytes.
    """

    def __init__(self, group: np.ndarray, rows: np.ndarray, length: np.ndarray):
        self.rows, self.length = rows, length
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum((rows + np.uint64(1)) * powers(MIX, rows.shape[1])[0][: rows.shape[1]], axis=1, out=self.prefix[:, 1:])
        self.order = self._mergesort(group)
        self.shared = self._shared(group, self.order)
        if not self._verified(group):
            self.order = np.lexsort((length, *rows.T[::-1], group))
            self.shared = self._by_bytes(group)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by equal hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while np.any(low < high):
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        t = self.extension(a, b)
        la, lb = self.length[a], self.length[b]
        ends = (t == la) | (t == lb)
        last = self.rows.shape[1] - 1
        byte = self.rows[a, np.minimum(t, last)] < self.rows[b, np.minimum(t, last)]
        return np.where(ends, (la < lb) | ((la == lb) & or_equal), byte)

    def _mergesort(self, group: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        sorted_group = group[order]
        start = np.searchsorted(sorted_group, sorted_group, "left")
        end = np.searchsorted(sorted_group, sorted_group, "right")
        width = 1
        while len(order) and width < (end - start).max():
            at = np.flatnonzero(end - start > width)
            base = start[at] + (at - start[at]) // (2 * width) * (2 * width)
            middle, stop = np.minimum(base + width, end[at]), np.minimum(base + 2 * width, end[at])
            left = at < middle
            low, high = np.where(left, middle, base), np.where(left, stop, middle)
            first = low.copy()
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) >> 1
                # Left run: count right elements below it; right run: count left elements not above it.
                before = self._less(order[mid], order[at[live]], ~left[live])
                low[live], high[live] = np.where(before, mid + 1, low[live]), np.where(before, high[live], mid)
            put = at.copy()
            put += np.where(left, low - first, low - first - (middle - base))
            merged = order.copy()
            merged[put] = order[at]
            order, width = merged, 2 * width
        return order

    def _shared(self, group: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common prefix of each row of the order with the one before it; -1 where a group begins."""
        out = np.full(len(order), -1)
        same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        out[same] = self.extension(order[same - 1], order[same])
        return out

    def _by_bytes(self, group: np.ndarray) -> np.ndarray:
        a, b = self.order[:-1], self.order[1:]
        differ = np.append(self.rows[a] != self.rows[b], np.ones((len(a), 1), bool), axis=1)
        out = np.minimum(differ.argmax(axis=1), np.minimum(self.length[a], self.length[b]))
        return np.append(-1, np.where(group[a] == group[b], out, -1))[: len(self.order)]

    def _verified(self, group: np.ndarray) -> bool:
        """Whether the hashes told the neighbours' extensions truly and the order ascends."""
        if not np.array_equal(true := self._by_bytes(group), self.shared):
            return False
        at = np.flatnonzero(true >= 0)
        a, b, t = self.order[at - 1], self.order[at], true[at]
        ends = t == np.minimum(self.length[a], self.length[b])
        t = np.minimum(t, self.rows.shape[1] - 1)
        return bool(np.all(np.where(ends, self.length[a] <= self.length[b], self.rows[a, t] < self.rows[b, t])))


def earlier_reach(group: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its anchor each row repeats a row of smaller rank.

    left holds the bytes before the anchor, nearest first; right those from it
    on. A match counts if it has ``length`` bytes or more; (0, 0) without one.
    """
    n = len(group)
    reach_left, reach_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_right, by_left = SuffixOrder(group, right, n_right), SuffixOrder(group, left, n_left)
    count = np.bincount(group, minlength=1)[group]
    # Pairs: the neighbours' extensions are the whole answer.
    for_pair = np.zeros((2, n), np.int64)
    for k, side in enumerate((by_right, by_left)):
        second = np.flatnonzero(side.shared >= 0)
        for_pair[k, side.order[second]] = side.shared[second]
        for_pair[k, side.order[second - 1]] = np.maximum(for_pair[k, side.order[second - 1]], side.shared[second])
    low = np.full(int(group.max()) + 1 if n else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, group, rank)
    pair = (count == 2) & (rank > low[group]) & (for_pair.sum(axis=0) >= length)
    reach_right[pair], reach_left[pair] = for_pair[0, pair], for_pair[1, pair]
    # Larger groups: classes of rows that agree on d bytes before and length - d from the anchor on.
    many = count > 2
    if many.any():
        classes = []
        for side in (by_right, by_left):
            inner = np.flatnonzero(many[side.order])
            classes.append((side.order[inner], side.shared[inner]))
        label = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        found = np.zeros(n, bool)
        for d in range(min(int(n_left[many].max()), length - ANCHOR) + 1):
            for k, need in ((0, length - d), (1, d)):
                label[k][classes[k][0]] = np.cumsum(classes[k][1] < need)
            row = np.flatnonzero(many & (n_left >= d) & (n_right >= length - d))
            key = label[0][row] * (n + 1) + label[1][row]
            order = np.lexsort((rank[row], key))
            new = np.append(True, np.diff(key[order]) != 0)[: len(row)]
            least = rank[row][order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(row) else rank[row]
            hit = row[order][rank[row][order] > least]
            reach_left[hit] = d
            fresh = hit[~found[hit]]
            reach_right[fresh], found[fresh] = length - d, True
    return reach_left, reach_right


class Anchors:
    """Anchors of a chunk with what stands around them."""

    def __init__(self, chunk: Chunk, length: int):
        self.chunk, self.length, self.before = chunk, length, length - ANCHOR
        found = [self._segment(s, min(s + SEGMENT, len(chunk.buf))) for s in range(0, len(chunk.buf), SEGMENT)]
        at, key, around = (np.concatenate([x[k] for x in found]) for k in range(3)) if found else (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
        new = np.append(True, at[1:] != at[:-1])[: len(at)]  # two segments may choose the anchor between them
        self.at, self.key, self.around = at[new], key[new], around[new]
        self.doc, self.n_left, self.n_right = self._place(self.at)
        self.pos = self.at - chunk.off[self.doc]

    def _place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of each anchor and how many bytes of it count before the anchor and from it on."""
        off, sizes = self.chunk.off, self.chunk.sizes
        doc = np.searchsorted(off, at, "right") - 1
        return doc, np.minimum(self.before, at - off[doc]), np.minimum(self.length, off[doc] + sizes[doc] - at)

    def _segment(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the strings that start in [begin, end): place, hash, and hash of all that counts around."""
        chunk, length = self.chunk, self.length
        low, high = max(0, begin - length), min(len(chunk.buf), end + 2 * length)
        sums = Sums(chunk.buf[low:high] + np.uint64(1))
        starts = np.arange(max(0, high - low - ANCHOR + 1))
        gram = mix64(sums.of(starts, starts + ANCHOR))
        best = (gram & ~_LOW) | starts.astype(np.uint64)
        span = 1
        while span < self.before + 1:
            step = min(span, self.before + 1 - span)
            best = np.minimum(best[:-step], best[step:]) if len(best) > step else best[:0]
            span += step
        long = chunk.sizes >= length
        first = np.clip(chunk.off[long], begin, end) - low
        stop = np.clip(chunk.off[long] + chunk.sizes[long] - length + 1, begin, end) - low
        valid = np.zeros(high - low + 1, np.int32)
        np.add.at(valid, first, 1)
        np.add.at(valid, stop, -1)
        windows = np.flatnonzero(np.cumsum(valid[: len(best)]))
        chosen = (best[windows] & _LOW).astype(np.int64)  # ascending
        chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)]]
        at = chosen + low
        _, n_left, n_right = self._place(at)
        around = mix64(sums.of(chosen - n_left, chosen + n_right)) + n_left.astype(np.uint64) * MIX + n_right.astype(np.uint64)
        return at, gram[chosen], around

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.key, return_counts=True)

    def sent(self, sketch: Sketch, shards: int) -> None:
        """Chooses what goes to the exact pass: of equal contexts the first only.

        A later equal context repeats all of the first; ``whole`` has those.
        ``twin`` has rows at the very place of the first (a repeated doc_id).
        """
        distinct, at = np.unique(self.key, return_inverse=True)
        often, hot = sketch.estimate(self.chunk, distinct)
        own = ~self.chunk.copy[self.doc]
        self.hot = np.flatnonzero(hot[at] & own)
        pick = np.flatnonzero(often[at] & ~hot[at] & own)
        around = self.around[pick]
        order = np.lexsort((self.pos[pick], self.chunk.order[self.doc[pick]], around))
        pick, around = pick[order], around[order]
        new = np.append(True, around[1:] != around[:-1])[: len(pick)]
        first = pick[np.flatnonzero(new)][np.cumsum(new) - 1] if len(pick) else pick
        same = self._equal(pick, first)
        first = np.where(same, first, pick)
        own = first == pick
        place = (self.chunk.order[self.doc[pick]] == self.chunk.order[self.doc[first]]) & (self.pos[pick] == self.pos[first])
        self.whole = pick[~own & ~place]
        self.twin, self.twin_of = pick[~own & place], first[~own & place]
        rows = pick[own]
        shard = (self.key[rows] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.rows, self.cut = rows[order], list(zip(*(x.tolist() for x in runs(shard[order])), strict=True))

    def context(self, rows: np.ndarray) -> np.ndarray:
        """Bytes around anchors as a matrix, zero outside of the text."""
        col = np.arange(-self.before, self.length)
        inside = (col >= -self.n_left[rows][:, None]) & (col < self.n_right[rows][:, None])
        return np.where(inside, self.chunk.buf[np.clip(self.at[rows][:, None] + col, 0, len(self.chunk.buf) - 1)], 0).astype(np.uint8)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether contexts are the same, byte by byte: hashes may collide."""
        out = (self.n_left[a] == self.n_left[b]) & (self.n_right[a] == self.n_right[b])
        for at in np.array_split(np.flatnonzero(out & (a != b)), max(1, len(a) // PIECE)):
            out[at] = (self.context(a[at]) == self.context(b[at])).all(axis=1)
        return out


class HotWindows:
    """All strings of a chunk around anchors that are too common for one task, grouped byte by byte."""

    def __init__(self, a: Anchors):
        chunk, self.length = a.chunk, a.length
        self.text = memoryview(chunk.body)
        start = np.unique((a.at[a.hot][:, None] - np.arange(a.before + 1)).ravel())
        start = start[start >= 0]
        doc = np.searchsorted(chunk.off, start, "right") - 1
        inside = start + self.length <= chunk.off[doc] + chunk.sizes[doc]
        self.start, doc = start[inside], doc[inside]
        self.doc, self.pos = chunk.order[doc], self.start - chunk.off[doc]
        base = powers(MIX, self.length)[0][: self.length]
        self.first = mix64(np.concatenate([np.zeros(0, np.uint64), *((self._bytes(chunk.buf, rows) + np.uint64(1)) @ base for rows in self._some(np.arange(len(self.start))))]))
        order = np.lexsort((self.pos, self.doc, self.first))
        new = np.append(True, np.diff(self.first[order]) != 0)[: len(order)]
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        again = np.flatnonzero(~new)
        if any(np.any(self._bytes(chunk.buf, order[rows]) != self._bytes(chunk.buf, lead[rows])) for rows in self._some(again)):
            text = np.array([bytes(self.text[s : s + self.length]) for s in self.start.tolist()], object)
            order = np.array(sorted(range(len(text)), key=lambda i: (int(self.first[i]), text[i], self.doc[i], self.pos[i])), np.int64)
            new = np.append(True, text[order][1:] != text[order][:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.lead = order[new]

    def _some(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        return iter(np.array_split(rows, len(rows) // PIECE + 1)) if len(rows) else iter(())

    def _bytes(self, buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return buf[self.start[rows][:, None] + np.arange(self.length)]

    def dealt(self, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Groups by shard, and each shard with where its groups begin and end."""
        shard = (self.first[self.lead] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, list(zip(*(x.tolist() for x in runs(shard[order])), strict=True))

    def digests(self, groups: np.ndarray) -> bytes:
        return b"".join(digest(self.text[s : s + self.length]) for s in self.start[self.lead[groups]].tolist())

    def later(self) -> np.ndarray:
        """Strings that start earlier in this very chunk."""
        lead = self.lead[self.group]
        return (self.doc > self.doc[lead]) | ((self.doc == self.doc[lead]) & (self.pos > self.pos[lead]))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [begin, end) as maximal runs."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])[: len(begin)]
    return begin[new], reach[np.append(new[1:], True)[: len(begin)]]


def repeated_bytes(docs: DataFrame, scratch: Scratch, length: int = 100, *, carry: list[str] | None = None, shard_keys: int = SHARD_KEYS, chunk_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), and the columns of carry as x0, x1 and so on: texts without bytes of strings that start earlier.

    A byte of a text's UTF-8 goes if a string of ``length`` bytes covers it that
    also starts in a document with a smaller doc_id, or earlier in the same;
    all is judged on the input, overlaps count, and no string crosses texts.
    spans are the removed runs as [start, end); kept is binary, since a cut may
    fall inside a character.

    Any ``length`` bytes hold an anchor that their content alone decides, so
    equal strings meet at equal anchors. Anchors that a count-min sketch finds
    to be unique are left out. The others' contexts go to shards by anchor;
    there, suffixes to the right and to the left of the anchors are sorted by a
    mergesort that compares by prefix hashes and binary search, and neighbours'
    common extensions, verified on the bytes, tell what repeats. A chunk
    sends equal contexts once, so common strings cost little; whole copies of
    a text are settled by their digests. An anchor that occurs more than ``hot``
    times might have more contexts than a task should hold: the strings around
    it are dealt out one by one instead, each chunk sending one entry for each,
    so that no anchor's contexts meet in one place. In a chunk they are compared
    byte by byte, between chunks by 128-bit BLAKE2b digests of their bytes. The
    result is the same whatever ``hot`` is.

    Null text is empty. A null doc_id is later than any other and equal to
    other nulls. Rows with one doc_id are one document; a string at the
    same place of both isn't earlier in either. Texts under ``length`` bytes
    stay whole. Extra columns are not looked at; an empty table gives an empty
    result. Texts stay whole: a long one is a chunk of its own, of which a
    segment is hashed at a time, and takes some 8 times its bytes in a worker.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    chunks = pack(docs, scratch, chunk_bytes, carry)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    sketch = Sketch(int(total * 2 / (length - ANCHOR + 2)) + 1, shard_keys // 4 + 1, cells_per_key=8, rows=1, levels=(1, hot))
    shards = max(1, -(-total // (8 * shard_keys)))
    often = sketch.repeated(chunks, lambda c: Anchors(c, length).keys(), scratch)
    mail = later_copies(chunks, scratch).unionByName(often)
    before = length - ANCHOR

    def send(chunk: Chunk) -> Iterator[tuple]:
        a = Anchors(chunk, length)
        a.sent(sketch, shards)
        for s, begin, end in a.cut:
            rows = a.rows[begin:end]
            context = a.context(rows)
            col = np.arange(-before, length)
            inside = (col >= -a.n_left[rows][:, None]) & (col < a.n_right[rows][:, None])
            sizes = np.stack([a.n_left[rows], a.n_right[rows]]).astype(np.uint16)
            yield chunk.id, "reach", s, a.key[rows].tobytes(), squeeze(chunk.order[a.doc[rows]]), squeeze(a.pos[rows]), squeeze(sizes), squeeze(context[inside], 3)
        if len(a.hot):
            w = HotWindows(a)
            groups, cut = w.dealt(shards)
            for s, begin, end in cut:
                g = groups[begin:end]
                yield chunk.id, "hot", s, w.digests(g), squeeze(w.doc[w.lead[g]]), squeeze(w.pos[w.lead[g]]), None, None

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] == "hot":
            return _first_of(pdf)
        key = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["key"]])
        doc, pos = (np.concatenate([unsqueeze(b, np.int64) for b in pdf[c]]) for c in ("doc", "pos"))
        sizes = np.concatenate([unsqueeze(b, np.uint16).reshape(2, -1) for b in pdf["sizes"]], axis=1).astype(np.int64)
        text = np.concatenate([unsqueeze(b, np.uint8) for b in pdf["context"]])
        begin = np.cumsum(sizes.sum(axis=0)) - sizes.sum(axis=0)
        reach = np.zeros((2, len(key)), np.uint16)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        many = np.diff(np.append(start, len(key))) > 1
        for rows in _pieces(order, start, np.append(start[1:], len(key)), many):
            n_left, n_right = sizes[:, rows]
            anchor = begin[rows] + n_left
            col = np.arange(max(before, 1))
            left = np.where(col < n_left[:, None], text[np.clip(anchor[:, None] - 1 - col, 0, None)], 0).astype(np.uint8)
            col = np.arange(length)
            right = np.where(col < n_right[:, None], text[np.clip(anchor[:, None] + col, None, len(text) - 1)], 0).astype(np.uint8)
            _, group = np.unique(key[rows], return_inverse=True)
            place = np.lexsort((pos[rows], doc[rows]))
            step = np.append(0, (np.diff(doc[rows][place]) != 0) | (np.diff(pos[rows][place]) != 0))
            rank = np.empty(len(rows), np.int64)
            rank[place] = np.cumsum(step)
            reach[0, rows], reach[1, rows] = earlier_reach(group, left, n_left, right, n_right, rank, length)
        ends = np.cumsum([len(b) // 8 for b in pdf["key"]])
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": "reach", "shard": pdf["shard"], "data": [squeeze(x) for x in np.split(reach, ends[:-1], axis=1)]})

    sent = each_chunk(chunks, send, "chunk bigint, kind string, shard bigint, key binary, doc binary, pos binary, sizes binary, context binary", mail)
    replies = scratch.save(sent.groupBy("kind", "shard").applyInPandas(match, MAIL_SCHEMA), "reach")

    def cut_out(chunk: Chunk) -> Iterator[tuple]:
        a = Anchors(chunk, length)
        a.sent(sketch, shards)
        data = [unsqueeze(b, np.uint16).reshape(2, -1) for b in chunk.mail.get("reach", [])]
        reach = np.zeros((2, len(a.at)), np.int64)
        if data:
            reach[:, a.rows] = np.concatenate(data, axis=1)
        reach[:, a.twin] = reach[:, a.twin_of]
        reach[0, a.whole], reach[1, a.whole] = a.n_left[a.whole], a.n_right[a.whole]
        hit = np.flatnonzero(reach.sum(axis=0) >= length)
        begin, end = [a.at[hit] - reach[0, hit]], [a.at[hit] + reach[1, hit]]
        if len(a.hot):
            w = HotWindows(a)
            groups, cut = w.dealt(shards)
            gone = np.zeros(len(w.lead), bool)
            flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=q - p).astype(bool) for x, (_, p, q) in zip(chunk.mail.get("hot", []), cut, strict=True)]
            if flags:
                gone[groups] = np.concatenate(flags)
            again = w.start[gone[w.group] | w.later()]
            begin.append(again)
            end.append(again + length)
        late = np.flatnonzero(chunk.copy & (chunk.sizes >= length))
        begin, end = merged(np.concatenate([*begin, chunk.off[late]]), np.concatenate([*end, chunk.off[late] + chunk.sizes[late]]))
        first = np.searchsorted(begin, chunk.off)
        last = np.searchsorted(begin, chunk.off + chunk.sizes)
        rows = []
        for i in range(len(chunk.order)):
            spans = np.stack([begin[first[i] : last[i]], end[first[i] : last[i]]], axis=1) - chunk.off[i]
            text, flat = chunk.text(i), spans.ravel().tolist()
            kept = b"".join(text[x:y] for x, y in zip([0, *flat[1::2]], [*flat[::2], len(text)], strict=True)) if flat else text
            row = int(chunk.order[i]) if chunk.known[i] else None, len(text), len(text) - len(kept), [(x, y) for x, y in spans.tolist()], kept
            if carry:
                rows.append(row)
            else:
                yield row
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=False)), *chunk.extra()], schema=arrow)

    schema = StructType([*StructType.fromDDL("doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary").fields, *(StructField(f"x{i}", docs.schema[c].dataType) for i, c in enumerate(carry or []))])
    arrow = to_arrow_schema(schema)
    return each_chunk(chunks, cut_out, schema, mail.unionByName(replies))


def without_repeats(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """docs with what repeated_bytes removes cut from text; n_chars, if there, follows. Bytes of a cut character go too."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = repeated_bytes(docs, scratch, length, carry=others)
    schema = StructType([StructField("text", StringType()), *(StructField(f"x{i}", docs.schema[c].dataType) for i, c in enumerate(others))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.as_py().decode(errors="ignore") for b in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *batch.columns[1:]], schema.names)

    kept = cut.select("kept", *schema.names[1:]).mapInArrow(decode, schema)
    given = {c: F.col(f"x{i}") for i, c in enumerate(others)} | {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "bigint")}
    return kept.select(*(given[c].alias(c) for c in docs.columns))


def _first_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of the strings that chunks sent start earlier in another chunk."""
    first, second = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in pdf["key"]]).T
    doc, pos = (np.concatenate([unsqueeze(b, np.int64) for b in pdf[c]]) for c in ("doc", "pos"))
    order = np.lexsort((pos, doc, second, first))
    new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = np.empty(len(order), bool)
    earlier[order] = (doc[lead] < doc[order]) | ((doc[lead] == doc[order]) & (pos[lead] < pos[order]))
    ends = np.cumsum([len(b) // 16 for b in pdf["key"]])
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": "hot", "shard": pdf["shard"], "data": [np.packbits(x).tobytes() for x in np.split(earlier, ends[:-1])]})


def _pieces(order: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the kept groups, whole groups together, about PIECE at a time."""
    start, end = start[keep], end[keep]
    piece = np.cumsum(end - start) // PIECE
    for p in np.unique(piece):
        inside = np.flatnonzero(piece == p)
        yield np.concatenate([order[s:e] for s, e in zip(start[inside], end[inside], strict=True)])
