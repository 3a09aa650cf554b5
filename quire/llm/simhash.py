"""SimHash near-dedup over a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, local_components, shuffle_parts
from quire.llm.components import connected_components

SEED = 42
BLOCK_BITS = 16
#: Bits of one tree level below a routed group.
LEVEL_BITS = 8  # divides 32
#: Pairs of nodes that are compared at once.
FRONTIER = 1 << 20
#: Rows of whole groups that are indexed at once.
CHUNK = 50_000
#: Distinct fingerprints of one routed group above which it is dealt out by a third block.
HOT_GROUP = 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of a lower-cased text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(width, len(words))
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def linked_pairs(group: np.ndarray, code: np.ndarray, fixed: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose codes differ in at most max_bits bits.

    group: an id for each row; rows of a group share the top ``fixed`` bits of
    their codes. Codes are distinct within a group. Rows are put in Gray order,
    so that each node of the tree, the rows that share a masked bit pattern, is
    a run. Pairs of nodes are walked downwards; the bits in which the patterns
    differ add up, and a pair over the limit goes with all rows below it.
    """
    order = np.lexsort((gray_rank(code), group))
    group, code = group[order], code[order]
    n = len(code)
    cuts = [*range(64 - fixed, 0, -LEVEL_BITS), 0]
    starts, patterns = [], []
    for cut in cuts:
        prefix = code >> np.uint64(cut)
        new = np.ones(n, bool)
        new[1:] = (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])
        at = np.flatnonzero(new)
        starts.append(at)
        patterns.append(prefix[at] & np.uint64((1 << LEVEL_BITS) - 1))
    first = np.arange(len(starts[0]))
    todo = [(0, first, first, np.zeros(len(first), np.int64))]
    while todo:
        level, a, b, gone = todo.pop()
        if level == len(cuts) - 1:
            keep = a != b
            yield order[starts[level][a[keep]]], order[starts[level][b[keep]]]
            continue
        down = np.searchsorted(starts[level + 1], np.append(starts[level], n))
        na, nb = down[a + 1] - down[a], down[b + 1] - down[b]
        total = na * nb
        if total.sum() > FRONTIER and len(a) > 1:
            half = len(a) // 2
            todo += [(level, a[:half], b[:half], gone[:half]), (level, a[half:], b[half:], gone[half:])]
            continue
        pair = np.repeat(np.arange(len(a)), total)
        i = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x, y = down[a[pair]] + i // nb[pair], down[b[pair]] + i % nb[pair]
        diff = gone[pair] + np.bitwise_count(patterns[level + 1][x] ^ patterns[level + 1][y])
        keep = (diff <= max_bits) & ((a[pair] != b[pair]) | (x <= y))
        todo.append((level + 1, x[keep], y[keep], diff[keep]))


def _forests(max_bits: int):
    """Rows (key, code, rep), those of a key together, into edges of a spanning forest of the links."""

    def links(key: np.ndarray, code: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(rep, return_inverse=True)
        found = list(linked_pairs(key, code.view(np.uint64), 2 * BLOCK_BITS, max_bits)) if len(key) > 1 else []
        a = at[np.concatenate([x for x, _ in found])] if found else np.zeros(0, np.int64)
        b = at[np.concatenate([x for _, x in found])] if found else a
        label = local_components(a, b, len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= CHUNK and (cut := int(np.flatnonzero(held[0] == held[0][-1])[0])):
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield links(*held)

    return run


def _block(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, 64 - BLOCK_BITS * (k + 1)).bitwiseAND((1 << BLOCK_BITS) - 1)


def _routed(reps: DataFrame, hot_group: int) -> DataFrame:
    """(key, code, rep) for each pair of the four 16-bit blocks, those two moved to the top of the code.

    Fingerprints that differ in two bits at most agree on two blocks at least,
    so each link is met under some key. A key with more than hot_group rows is
    dealt out again by each of three parts of the other 32 bits, of which two
    such fingerprints share one at least; nothing is lost and groups stay small.
    """
    forms = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        i2, j2 = (k for k in range(4) if k not in (i, j))
        top = F.shiftleft(_block(F.col("fp"), i), BLOCK_BITS).bitwiseOR(_block(F.col("fp"), j))
        low = F.shiftleft(_block(F.col("fp"), i2), BLOCK_BITS).bitwiseOR(_block(F.col("fp"), j2))
        forms.append(F.struct((top * 8 + n).alias("key"), F.shiftleft(top, 32).bitwiseOR(low).alias("code"), F.col("rep")))
    routed = reps.select(F.explode(F.array(*forms)).alias("r")).select("r.*")
    hot = routed.groupBy("key").count().where(F.col("count") > hot_group).select("key", F.lit(True).alias("hot"))
    if hot.isEmpty():
        return routed
    dealt = routed.join(hot, "key", "left")
    parts = [F.shiftrightunsigned("code", s).bitwiseAND((1 << w) - 1) * 4 + p for p, (s, w) in enumerate(((21, 11), (10, 11), (0, 10)))]
    finer = dealt.select("code", "rep", F.explode(F.when(F.col("hot"), F.array(*(F.xxhash64("key", x) for x in parts))).otherwise(F.array("key"))).alias("key"))
    return finer.select("key", "code", "rep")


def simhash_groups(docs: DataFrame, scratch: Scratch, width: int = 3, max_bits: int = 2, hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    Texts whose fingerprints differ in at most max_bits (0 to 2) bits are
    linked; component_id is the smallest doc_id reachable. Equal fingerprints
    are reduced to one row before anything is compared, so copies cost nothing
    however many there are.

    Null text is empty; a text without words has fingerprint 0 and links like
    any other. Rows that repeat a doc_id are returned as often as they come.
    A null doc_id never names a component; its row has that of its fingerprint,
    null if no row with an id shares it. Other columns are not looked at. An
    empty table gives an empty result.
    """
    fps = scratch.save(fingerprints(docs, width), "fingerprints")
    reps = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    routed = _routed(reps.where("rep is not null"), hot_group)
    edges = routed.repartition(shuffle_parts(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_forests(max_bits), "u bigint, v bigint")
    found = connected_components(edges, scratch)
    named = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, scratch: Scratch, width: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with the document of smallest doc_id of each group; all columns stay.

    Rows that repeat a doc_id stand or fall together; rows without doc_id stay,
    since nothing tells them from one another.
    """
    groups = simhash_groups(docs, scratch, width, max_bits)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col("gone"), "left_anti")
