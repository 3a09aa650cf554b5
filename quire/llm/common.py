"""Helpers shared by the corpus operators: tables, scratch space, text units."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at once.
BATCH_ROWS = 500

_ROOTS: list[tuple[SparkSession, str]] = []


def _give_memory_back() -> None:
    """Has the C library return large freed blocks at once.

    Python workers are used again for task after task; what one task needed
    for a moment would otherwise stay with its worker and count against the
    executor. M_MMAP_THRESHOLD (-3) and M_TRIM_THRESHOLD (-1), where there is glibc.
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)
        libc.mallopt(-1, 8 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


if TaskContext.get() is not None:  # in a worker; the driver's process is its owner's
    _give_memory_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _release() -> None:
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):
            _delete(spark, root)


class Scratch:
    """Intermediate tables in the folder that all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests, a single machine) a temporary folder is used.
    A table that was written survives the loss of any executor. What a result
    still reads stays until the driver ends; ``drop`` frees the rest earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quire.scratch.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="quire-")
            spark.conf.set("quire.scratch.dir", base)
        # Texts are long: batches of a few hundred rows keep what executors and their workers hold small. A session that has its own number keeps it.
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.spark, self.root = spark, f"{base}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            _delete(self.spark, f"{self.root}/{label}")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for null."""
    return text.encode().split() if text else []


#: Multiplier of the SplitMix64 finaliser and of the polynomial hashes (odd, so it has an inverse).
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (SplitMix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes, edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, label):
            return label
        label = new
