"""Streams without repeats equal the batch, however files come and whatever fails between."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill import streaming
from corpusmill.operators import conversations as V

ROW = "conv_id bigint, turns array<struct<role:string,content:string>>, ts timestamp"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Writes rows (id, content) as one more file of the stream."""
    written = []

    def add(rows):
        frame = spark.createDataFrame([(i, [("user", c), ("assistant", "a")]) for i, c in rows], "conv_id bigint, turns array<struct<role:string,content:string>>")
        frame.withColumn("ts", F.timestamp_seconds(F.col("conv_id"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        written.extend(rows)
        return written

    return add


def stream(spark, tmp_path, files=1):
    return streaming.read(spark, str(tmp_path / "in"), spark.createDataFrame([], ROW).schema, files_per_trigger=files)


def test_kept_rows_equal_the_batch_over_shuffled_files_and_restarts(spark, tmp_path, arrivals, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACTED", 2)
    rng = random.Random(1)
    rows = [(i, f"text {i % 17}") for i in range(60)]
    rng.shuffle(rows)
    at = str(tmp_path / "kept")
    for part in (rows[:20], rows[20:45], rows[45:]):
        for i in range(0, len(part), 12):
            written = arrivals(part[i : i + 12])
        streaming.keep_first(stream(spark, tmp_path), at, str(tmp_path / "checkpoint")).awaitTermination()
        table = streaming.kept_first(spark, at, spark.createDataFrame([], ROW).schema)
        batch = spark.createDataFrame([(i, [("user", c), ("assistant", "a")]) for i, c in written], "conv_id bigint, turns array<struct<role:string,content:string>>")
        assert sorted(r["conv_id"] for r in table.read().collect()) == sorted(r["conv_id"] for r in V.deduplicate(batch).collect())
        assert table.read().agg(F.sum("copies")).first()[0] == len(written)


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path, arrivals):
    arrivals([(2, "a"), (1, "a"), (3, "b")])
    at = str(tmp_path / "kept")
    for n in range(2):
        # A fresh checkpoint reads everything again.
        streaming.keep_first(stream(spark, tmp_path), at, str(tmp_path / f"checkpoint{n}")).awaitTermination()
    rows = streaming.kept_first(spark, at, spark.createDataFrame([], ROW).schema).read().collect()
    assert sorted((r["conv_id"], r["copies"]) for r in rows) == [(1, 2), (3, 1)]


def test_unrepeated(spark, tmp_path, arrivals):
    def run(rows):
        streaming.transform(rows, lambda r: r.select("conv_id", "ts"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r["conv_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrivals([(1, "a"), (2, "b")])
    assert run(streaming.unrepeated(stream(spark, tmp_path))) == [1, 2]
    arrivals([(3, "a"), (4, "c")])
    assert run(streaming.unrepeated(stream(spark, tmp_path))) == [1, 2, 4]


def test_unrepeated_forgets_after_a_while(spark, tmp_path, arrivals):
    def run():
        rows = streaming.unrepeated(stream(spark, tmp_path), "ts", "10 seconds")
        streaming.transform(rows, lambda r: r.select("conv_id"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r["conv_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrivals([(1, "a")])
    arrivals([(5, "a")])
    assert run() in ([1], [5])
    # State is given up at the end of the batch after the one that moved the watermark.
    for row in ((1000, "z"), (1500, "y"), (2000, "a")):
        arrivals([row])
        got = run()
    assert got[-3:] == [1000, 1500, 2000]
