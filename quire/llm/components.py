"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, local_components

#: Links that one task puts together in memory, 16 MB; more are contracted step by step.
FEW_LINKS = 1 << 20


def _stars(edges: DataFrame, scratch: Scratch, tag: str, *, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v).

    The minima are pre-aggregated before the shuffle and written, so that the
    join back is between two plain exchanges and a hot node can be split.
    """
    low = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-low")
    both = edges.join(low, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): component is the smallest node reachable over links.

    links: two bigint columns u and v. Self-links and nulls are ignored,
    repeats and both directions are allowed. Nodes without a link to another
    node are not returned. Every step is a table in the scratch folder; the
    steps needed grow with the logarithm of the longest chain, and the driver
    sees only a row count and a checksum of each.
    """
    links = links.where("u is not null and v is not null and u <> v")
    edges = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    seen, step = None, 0
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        seen, step = now, step + 1
        flipped = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        spread = scratch.save(_stars(flipped, scratch, f"cc-{step}l", large=True), f"cc-{step}a")
        edges = scratch.save(_stars(spread, scratch, f"cc-{step}s", large=False), f"cc-{step}")
        scratch.drop(f"cc-{step - 1}", f"cc-{step}a", f"cc-{step}l-low", f"cc-{step}s-low")


def components_of_table(links: DataFrame, scratch: Scratch, few: int = FEW_LINKS) -> DataFrame:
    """The same for links that are a saved table: a few links need one task and no steps."""
    if links.count() > few:
        return connected_components(links, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        u, v = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in held)]).astype(np.int64) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        found = nodes[local_components(at[: len(u)], at[len(u) :], len(nodes))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found)], ["node", "component"])

    given = links.where("u is not null and v is not null and u <> v").select("u", "v")
    return scratch.save(given.coalesce(1).mapInArrow(run, "node bigint, component bigint"), "found")
