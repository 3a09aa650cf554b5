"""Streams of new books and of reading marks. An extension: nothing here is needed for batch results."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import books as B


def ingest_books(spark: SparkSession, inbox: str, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Reads every book file that arrives under inbox into the tables under out, each content once.

    A batch's books are told from those of other batches by a digest of their
    bytes, so that a book that comes again under another name is skipped. What
    a batch writes is a partition of its own in each table, named by the query
    and the batch's number: a batch that fails between two tables is done again
    and replaces what it had written.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(inbox)

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        label = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId') or hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}-{number}"
        books = batch.select(F.sha2("content", 256).alias("book_id"), "content").dropDuplicates(["book_id"])
        try:
            known = session.read.parquet(f"{out}/publication").where(F.col("batch") != label).select("book_id")
            books = books.join(known, "book_id", "left_anti")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        books = books.persist()
        read = B.read_books(books).persist()
        tables = {"spine": B.exploded(read, "spine"), "nav": B.exploded(read, "nav"), "diagnostics": B.exploded(read, "diagnostics"), "blocks": B.read_blocks(books), "publication": read.select("book_id", "opf_path", "fatal")}
        try:
            for name, df in tables.items():
                df.withColumn("part", F.pmod(F.xxhash64("book_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("part").parquet(f"{out}/{name}/batch={label}")
        finally:
            read.unpersist()
            books.unpersist()

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reading_activity(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(window, event_type, n, value) of a stream of events(ts, event_type, value); rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
