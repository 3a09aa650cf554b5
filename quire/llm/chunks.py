"""Texts packed in chunks, and messages between chunks and shards of a hash space.

The substring operators read every text three times: to note what it holds, to
send what may be repeated, and to cut what is. Texts are therefore packed once,
compressed, into rows of a few MB; a chunk talks to the shards of a hash space
in packed messages, so that Spark moves some thousand rows where it would move
billions, and no text is ever sorted or shuffled by what it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.common import MIX, Scratch, mix64

#: Bytes of text in a chunk, least and most, unless one text is longer.
CHUNK_BYTES = (1 << 18, 1 << 23)
#: Chunks that all texts make while the most isn't reached: as shards grow with the input, so do chunks, and
#: a message between the two keeps its number of keys.
CHUNKS = 350
#: Bytes of a chunk that are looked at together.
SEGMENT = 1 << 20
#: Keys of a shard, about: what one task holds at once.
SHARD_KEYS = 1 << 21
#: Cells of a sketch row for each key.
CELLS_PER_KEY = 3
SKETCH_ROWS = 2
#: Marks a word that was looked up: no UTF-8 text has these bytes.
LONG = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stands for a null doc_id in comparisons: later than any other.
LAST = np.iinfo(np.int64).max

CHUNK_SCHEMA = "chunk bigint, ids binary, known binary, sizes binary, digests binary, body binary, extra binary, n_bytes bigint, n_words bigint"


def squeeze(x: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(b: bytes, kind: type | str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def chunk_size(docs: DataFrame) -> int:
    """Bytes of text in each chunk of docs(text), by all of its texts."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(max(total // CHUNKS, CHUNK_BYTES[0]), CHUNK_BYTES[1])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def pack(docs: DataFrame, scratch: Scratch, chunk_bytes: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """The texts of docs(doc_id, text) as a written table of chunks; carry names columns that stay with them, as Arrow batches."""
    carried, size = carry or [], chunk_bytes or chunk_size(docs)

    def emit(chunk: int, ids: list, texts: list[bytes], extra: list[pa.RecordBatch]) -> pa.RecordBatch:
        body, others = b"\n".join(texts) + b"\n", pa.BufferOutputStream()
        if carried:
            with pa.ipc.new_stream(others, extra[0].schema) as stream:
                for part in extra:
                    stream.write_batch(part)
        row = [
            chunk,
            np.array([LAST if i is None else i for i in ids], np.int64).tobytes(),
            np.array([i is not None for i in ids], np.uint8).tobytes(),
            np.array([len(t) for t in texts], np.int64).tobytes(),
            b"".join(hashlib.sha256(t).digest()[:16] for t in texts),
            zstandard.ZstdCompressor(level=3).compress(body),
            zstandard.ZstdCompressor(level=1).compress(others.getvalue().to_pybytes()) if carried else None,
            sum(map(len, texts)),
            sum(len(t.split()) for t in texts),
        ]
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, extra, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            others, begin = pa.RecordBatch.from_arrays(batch.columns[2:], batch.schema.names[2:]) if carried else None, 0
            for k, (i, t) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                ids.append(i.as_py())
                texts.append((t.as_py() or "").encode())
                held += len(texts[-1]) + 1
                if held >= size:
                    if carried:
                        extra.append(others.slice(begin, k + 1 - begin))
                    yield emit(chunk, ids, texts, extra)
                    chunk, ids, texts, extra, held, begin = chunk + 1, [], [], [], 0, k + 1
            if carried and begin < len(others):
                extra.append(others.slice(begin))
        if ids:
            yield emit(chunk, ids, texts, extra)

    others = [F.col(quoted(c)).alias(f"x{i}") for i, c in enumerate(carried)]
    return scratch.save(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("read"), *others).mapInArrow(run, CHUNK_SCHEMA), "chunks")


def later_copies(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Mail (chunk, kind 'copy', shard 0, data): which texts equal one with a smaller doc_id.

    Copies are counted and reduced before the shuffle; digests have 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(ids) // 8
                d = np.frombuffer(digests, np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.arange(n)), pa.array(np.frombuffer(ids, np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["chunk", "at", "id", "d1", "d2"])

    rows = chunks.select("chunk", "ids", "digests").mapInArrow(run, "chunk bigint, at bigint, id bigint, d1 bigint, d2 bigint")
    classes = scratch.save(rows.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first"), "classes")
    late = rows.join(classes, ["d1", "d2"]).where("id > first").groupBy("chunk").agg(F.collect_list("at").alias("at"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [squeeze(np.array(at, np.int64)) for at in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["copy"] * len(data)), pa.array([0] * len(data), pa.int64()), pa.array(data, pa.binary())], ["chunk", "kind", "shard", "data"])

    return scratch.save(late.mapInArrow(bits, MAIL_SCHEMA), "copies")


MAIL_SCHEMA = "chunk bigint, kind string, shard bigint, data binary"


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least; kept for the longest input so far."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) <= n:
        both = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            x = np.full((n // (1 << 17) + 1) * (1 << 17) + 1, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        known = _POWERS[int(base)] = both[0], both[1]
    return known


class Sums:
    """Prefix polynomial hashes: the hash of x[a:b] for any ranges, modulo 2**64."""

    def __init__(self, x: np.ndarray, base: np.uint64 = MIX):
        self.up, self.down = powers(base, len(x))
        self.at = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=self.at[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.at[b] - self.at[a]) * self.down[a]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Chunk:
    """A chunk row, unpacked. Texts stand one after the other, a line feed after each."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.order = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(row["body"])
        self.buf = np.frombuffer(self.body, np.uint8)
        self.off = np.cumsum(self.sizes + 1) - self.sizes - 1
        self._extra = row.get("extra")
        mail = row.get("mail") or []
        self.mail = {}
        for m in sorted(mail, key=lambda m: (m["kind"], m["shard"])):
            self.mail.setdefault(m["kind"], []).append(m["data"])
        self.copy = np.zeros(len(self.order), bool)
        for data in self.mail.get("copy", []):
            self.copy[unsqueeze(data, np.int64)] = True

    def text(self, i: int) -> bytes:
        return self.body[self.off[i] : self.off[i] + self.sizes[i]]

    def texts(self) -> list[str]:
        return [self.text(i).decode() for i in range(len(self.order))]

    def extra(self) -> list[pa.Array]:
        """The columns that were carried along."""
        if self._extra is None:
            return []
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._extra)) as stream:
            return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in stream.read_all().columns]

    def words(self) -> Words:
        return Words(self)


_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Bytes of a word that are compared as two numbers; longer words are looked up one by one.
SHORT_WORD = 16


def _loaded(b: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first size bytes (8 at most) from each place as one number, zeros after them."""
    every = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))
    size = np.clip(size, 0, 8)
    return np.where(size > 0, every[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - size) * 8 % 64).astype(np.uint64)), np.uint64(0))


class Words:
    """The words of a chunk: number (equal words alone have equal ones) and 64-bit hash of each, and all joined by one space.

    A segment is looked at at a time. Two hashes may collide; numbers are told
    apart by the words' bytes.
    """

    def __init__(self, chunk: Chunk):
        long: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, ...]] = [(*(np.zeros(0, np.uint64),) * 3, *(np.zeros(0, np.int32),) * 2)]
        joined, begin = [], 0
        while begin < len(chunk.body):
            gap = _GAP.search(chunk.body, min(begin + SEGMENT, len(chunk.body) - 1))
            end = gap.end() if gap else len(chunk.body)
            b = np.append(chunk.buf[begin:end], np.zeros(SHORT_WORD + 8, np.uint8))
            space = _SPACE[b[: end - begin]]
            after = np.append(True, space[:-1])
            start, stop = np.flatnonzero(~space & after), np.flatnonzero(space & ~after)
            size = stop - start
            low, high = _loaded(b, start, size), _loaded(b, start + 8, size - 8)
            h = mix64(mix64(low + size.astype(np.uint64) * MIX) + high * np.uint64(0xD6E8FEB86659FD93))
            for k in np.flatnonzero(size > SHORT_WORD):
                word = chunk.body[begin + start[k] : begin + stop[k]]
                low[k], high[k], h[k] = long.setdefault(word, len(long)), LONG, xxhash.xxh64_intdigest(word, 7)
            parts.append((h, low, high, size.astype(np.int32), (np.searchsorted(chunk.off, start + begin, "right") - 1).astype(np.int32)))
            one = np.where(space, np.uint8(32), b[: end - begin])[~space | ~after]
            joined.append(one.tobytes())
            begin = end
        self.hash, low, high, size, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.ids, order = self.hash, np.argsort(self.hash)
        h, low, high, size_ = self.hash[order], low[order], high[order], size[order]
        other = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size_[1:] != size_[:-1])
        if np.any(other & (h[1:] == h[:-1])):
            again = np.lexsort((size_, high, low))
            low, high, size_, order = low[again], high[again], size_[again], order[again]
            self.ids = np.empty(len(order), np.int64)
            self.ids[order] = np.cumsum(np.append(0, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size_[1:] != size_[:-1])))
        self.joined = b"".join(joined)
        self.off = np.append(0, np.cumsum(size + np.int64(1)))


def each_chunk(chunks: DataFrame, run: Callable[[Chunk], Iterator[tuple | pa.RecordBatch]], schema: str | StructType, mail: DataFrame | None = None) -> DataFrame:
    """Rows, or batches of them, that run gives for each chunk; mail(chunk, kind, shard, data) is laid beside its chunk."""
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    if mail is not None:
        letters = mail.groupBy("chunk").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("mail"))
        chunks = chunks.drop("digests").join(letters, "chunk", "left")

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for row in run(Chunk(batch.slice(k, 1).to_pylist()[0])):
                    if isinstance(row, pa.RecordBatch):
                        yield row
                        continue
                    rows.append(row)
                    held += sum(len(v) for v in row if isinstance(v, bytes | str))
                    if held > 4 << 20:
                        yield _batch(rows, out)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, out)

    return chunks.mapInArrow(batches_of, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value of sorted x, where its run begins and where it ends."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[at], at, np.append(at[1:], len(x))[: len(at)]


def digest(b: bytes | memoryview) -> bytes:
    """128 bits of BLAKE2b: names contents, as no two different ones can be found that share it."""
    return hashlib.blake2b(b, digest_size=16).digest()


def _pack_sorted(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences, low and high bytes apart."""
    d = np.diff(cells, prepend=np.int64(0))
    kind = np.uint16 if len(d) == 0 or d.max() < 1 << 16 else np.uint32 if d.max() < 1 << 32 else np.uint64
    planes = d.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return bytes([np.dtype(kind).itemsize]) + squeeze(planes)


def _unpack_sorted(b: bytes) -> np.ndarray:
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]]
    planes = unsqueeze(b[1:], np.uint8).reshape(b[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64))


class Sketch:
    """Plan of a count-min sketch that is dealt out in shards, its size in proportion to the keys."""

    def __init__(self, keys: int, shard_keys: int = SHARD_KEYS, cells_per_key: int = CELLS_PER_KEY, rows: int = SKETCH_ROWS, levels: tuple[int, ...] = (1,)):
        self.levels = levels
        self.rows, self.shards = rows, max(1, -(-keys // shard_keys))
        self.cells = max(1 << 10, -(-keys * cells_per_key // self.shards))

    def cells_of(self, key: np.ndarray, row: int) -> np.ndarray:
        return (mix64(key + np.uint64((row + 1) * int(MIX) % 2**64)) % np.uint64(self.cells * self.shards)).astype(np.int64)

    def _messages(self, key: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, cells, counts) of a chunk's distinct keys, counts no more than matters."""
        most = min(self.levels[-1] + 1, 0xFFFF)
        for row in range(self.rows):
            cell, at = np.unique(self.cells_of(key, row), return_inverse=True)
            n = np.minimum(most, np.bincount(at, weights=count, minlength=len(cell))).astype(np.uint16)
            for s, a, b in zip(*(x.tolist() for x in runs(cell // self.cells)), strict=True):
                yield row * self.shards + s, cell[a:b] - s * self.cells, n[a:b]

    def repeated(self, chunks: DataFrame, keys_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], scratch: Scratch) -> DataFrame:
        """Mail 'often': for each chunk and shard, and each level, which of the chunk's cells count more than that in all."""

        def send(chunk: Chunk) -> Iterator[tuple]:
            for shard, cell, n in self._messages(*keys_of(chunk)):
                yield chunk.id, shard, _pack_sorted(cell), squeeze(n)

        cells, levels = self.cells, self.levels
        kind, most = (np.uint8, 2) if levels[-1] == 1 else (np.uint32, levels[-1] + 1)

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            count, got = np.zeros(cells, kind), []
            for packed, n in zip(pdf["cells"], pdf["counts"], strict=True):
                got.append(_unpack_sorted(packed))
                count[got[-1]] = np.minimum(most, count[got[-1]] + unsqueeze(n, np.uint16))
            return pd.DataFrame({"chunk": pdf["chunk"], "kind": "often", "shard": pdf["shard"], "data": [np.packbits(np.stack([count[x] > k for k in levels])).tobytes() for x in got]})

        sent = each_chunk(chunks, send, "chunk bigint, shard bigint, cells binary, counts binary")
        return scratch.save(sent.groupBy("shard").applyInPandas(merge, MAIL_SCHEMA), "often")

    def estimate(self, chunk: Chunk, key: np.ndarray) -> np.ndarray:
        """For each level, which of the keys may occur more often, by the replies of all shards."""
        over, replies = np.ones((len(self.levels), len(key)), bool), iter(chunk.mail.get("often", []))
        for row in range(self.rows):
            cell = self.cells_of(key, row)
            order = np.argsort(cell)
            cell = cell[order]
            new = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
            _, begin, end = runs(cell[new] // self.cells)
            bits = [np.unpackbits(np.frombuffer(next(replies), np.uint8), count=n * len(self.levels)).astype(bool).reshape(-1, n) for n in (end - begin).tolist()]
            if bits:
                over[:, order] &= np.concatenate(bits, axis=1)[:, np.cumsum(new) - 1]
        return over
