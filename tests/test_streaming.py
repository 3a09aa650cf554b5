import datetime

import pytest
from pyspark.sql import functions as F

from quire.streaming.ingest import ingest_books, reading_activity
from tests.test_books import book


def test_ingest(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "a.epub").write_bytes(book())
    (inbox / "bad.epub").write_bytes(b"no book")
    ingest_books(spark, str(inbox), out, mark, buckets=2).awaitTermination()
    (inbox / "again.epub").write_bytes(book())
    (inbox / "b.epub").write_bytes(book(title="Other"))
    ingest_books(spark, str(inbox), out, mark, buckets=2).awaitTermination()
    assert spark.read.parquet(f"{out}/publication").count() == 3
    assert spark.read.parquet(f"{out}/spine").count() == 12 and spark.read.parquet(f"{out}/blocks").count() == 24


def test_a_batch_that_failed_is_replaced(spark, tmp_path, monkeypatch):
    from quire.streaming import ingest

    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "a.epub").write_bytes(book())
    real = ingest.B.read_blocks

    def broken(books):
        return real(books).withColumn("text", F.raise_error(F.lit("lost")))

    monkeypatch.setattr(ingest.B, "read_blocks", broken)
    with pytest.raises(Exception, match="lost"):
        ingest_books(spark, str(inbox), out, mark, buckets=2).awaitTermination()
    assert spark.read.parquet(f"{out}/spine").count() > 0
    monkeypatch.setattr(ingest.B, "read_blocks", real)
    ingest_books(spark, str(inbox), out, mark, buckets=2).awaitTermination()
    spine = spark.read.parquet(f"{out}/spine")
    assert spine.count() == spine.dropDuplicates(["book_id", "pos"]).count() > 0 and spark.read.parquet(f"{out}/publication").count() == 1


def test_activity(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 0, 0)
    rows = [(t + datetime.timedelta(minutes=m), k, 1.0) for m, k in ((0, "a"), (1, "a"), (11, "a"), (12, "b"), (45, "b"))]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = reading_activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("activity").collect()) == [1, 1, 1, 2]
