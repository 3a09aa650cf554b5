"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, local_components
from quire.llm.components import connected_components

#: Vectors wanted in a cell.
CELL_ROWS = 1024
#: Vectors of a cell above which it is compared in pairs of blocks, each a task's work of bounded size.
BLOCK_ROWS = 2048
#: Vectors, at most, from which all centroids are fitted (the sample is those with the smallest hashes).
SAMPLE_ROWS = 20_000
#: Bytes of centroids at most; with more vectors than these give small cells, cells grow and are compared block by block.
CENTROID_BYTES = 32 << 20


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of unit rows x, by farthest-first seeding and Lloyd steps."""
    k = min(k, len(x))
    best = np.full(len(x), -2.0)
    seeds = [0]
    for _ in range(k - 1):
        best = np.maximum(best, x @ x[seeds[-1]])
        seeds.append(int(best.argmin()))
    centre = x[seeds].copy()
    for _ in range(rounds):
        home = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-300), centre)
    return centre


def _unit(values: list[list[float]]) -> np.ndarray:
    x = np.array(values, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(reps: DataFrame, sizes: DataFrame, cell_rows: int, sample_rows: int) -> dict[str, np.ndarray]:
    """Centroids of each group that is larger than a cell; fitted on the driver from the bounded sample."""
    large = sizes.where(F.col("count") > cell_rows).orderBy(F.desc("count"), "grp").limit(4096)
    sample = reps.join(large, "grp").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("grp", "count", "embedding").toPandas()
    cells, spent = {}, 0
    for grp, part in sample.groupby("grp", sort=True):
        x = _unit([v.tolist() if hasattr(v, "tolist") else list(v) for v in part.embedding])
        room = max(1, (CENTROID_BYTES - spent) // (8 * x.shape[1]))
        cells[grp] = spherical_kmeans(x, int(min(-(-int(part["count"].iloc[0]) // cell_rows), max(1, len(x) // 8), room)))
        spent += cells[grp].nbytes
    return cells


def _assign(cells: dict[str, np.ndarray], threshold: float):
    """Each vector to its nearest centroid's cell and, as a guest, to lower cells where a link may be.

    If x is nearer to a and y nearer to b, with cosine(x, y) >= threshold, the
    angle between x and the plane between a and b is at most theirs, so
    x.a - x.b <= sin(angle) * |a - b|. Going to the lower cell only, every link
    is met exactly once.
    """
    reach = float(np.sqrt(max(0.0, 1 - threshold * threshold))) if threshold >= 0 else 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = pd.DataFrame({"grp": batch.column(0).to_pylist(), "rep": batch.column(1).to_numpy(zero_copy_only=False), "n": batch.column(2).to_numpy(zero_copy_only=False)})
            vectors = batch.column(3).to_pylist()
            for grp, part in frame.groupby("grp", sort=False):
                at = part.index.to_numpy()
                x = _unit([vectors[i] for i in at])
                rows, cell, guest = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                if (centre := cells.get(grp)) is not None and centre.shape[1] == x.shape[1]:
                    dots = x @ centre.T
                    home = dots.argmax(axis=1)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T))
                    near = dots[rows, home][:, None] - dots <= reach * gap[home] + 1e-9
                    near &= np.arange(len(centre)) < home[:, None]
                    more, into = np.nonzero(near)
                    rows, cell, guest = np.concatenate([rows, more]), np.concatenate([home, into]), np.concatenate([guest, np.ones(len(more), bool)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(rows)), pa.array(cell), pa.array(guest), pa.array(part["rep"].to_numpy()[rows]), pa.array(part["n"].to_numpy()[rows]), pa.array([v.tobytes() for v in x[rows]], pa.binary())],
                    ["grp", "cell", "guest", "rep", "n", "unit"],
                )

    return run


def _compare(threshold: float):
    """Blocked products of one pair of blocks (or one block with itself): partial link counts and a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        guest, n, block = pdf["guest"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        own = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        links, ends = np.zeros(len(pdf), np.int64), []
        left = np.arange(len(pdf)) if own else np.flatnonzero(block == pdf["i"].iloc[0])
        right = left if own else np.flatnonzero(block == pdf["j"].iloc[0])
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            for t in range(0, len(right), 512):
                cols = right[t : t + 512]
                hit = x[rows] @ x[cols].T >= threshold
                hit &= ~(guest[rows][:, None] & guest[cols])
                if own:
                    hit &= rows[:, None] < cols
                a, b = (ix[k] for ix, k in zip((rows, cols), np.nonzero(hit), strict=True))
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                ends.append((a, b))
        a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        rep = pdf["rep"].to_numpy()
        root = rep[local_components(a, b, len(pdf))]
        keep = links > 0
        return pd.DataFrame({"u": rep[keep], "v": root[keep], "links": links[keep]})

    return run


def embedding_groups(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors are compared in double precision when their labels are equal and
    not null and their lengths are equal. One with a null id, label or vector,
    no components, a null or non-finite component or only zeros links with
    nothing. Equal vectors become one weighted row before anything is compared.
    Centroids are fitted on a bounded sample; every vector is indexed, and the
    guests of a cell make the search exact whatever the centroids are.

    component_id is the smallest vec_id reachable over links and kept says
    whether it is the row's own. Rows that repeat a vec_id count as vectors of
    their own and share an id. A row without links has its own id; where that
    is null, component_id and kept are null. An empty table gives an empty
    result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine &= F.forall(e, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").withColumn("fine", F.coalesce(fine, F.lit(False)))
    groups = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = scratch.save(groups.withColumn("grp", F.concat_ws(":", F.size("embedding"), "label")), "reps")
    sizes = reps.groupBy("grp").count()
    cells = _centroids(reps, sizes, cell_rows, sample_rows)
    placed = scratch.save(reps.select("grp", "rep", "n", "embedding").mapInArrow(_assign(cells, threshold), "grp string, cell bigint, guest boolean, rep bigint, n bigint, unit binary"), "placed")
    blocks = placed.groupBy("grp", "cell").count().select("grp", "cell", F.ceil(F.col("count") / block_rows).alias("blocks"))
    dealt = placed.join(blocks, ["grp", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = scratch.save(dealt.groupBy("grp", "cell", "i", "j").applyInPandas(_compare(threshold), "u bigint, v bigint, links bigint"), "links")
    named = reps.join(found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    named = named.join(connected_components(found, scratch).withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    named = scratch.save(named.withColumn("fine", F.lit(True)), "named")
    out = rows.join(named, ["label", "embedding", "fine"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
