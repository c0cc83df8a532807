"""Tables that several writers change at once."""

import threading

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.jobs import JobLog
from corpusmill.operators.versioned import ResultCache, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table", "k string, n bigint", "k")


def rows_of(table, version=None):
    return {r["k"]: r["n"] for r in table.read(version).collect()}


def some(spark, **values):
    return spark.createDataFrame(list(values.items()), "k string, n bigint")


def test_versions_parts_and_time_travel(spark, table):
    assert rows_of(table) == {} and table.version() == 0 and table.compact() == 0
    assert table.upsert(some(spark, a=1, b=2)) == 1
    table.upsert(some(spark, b=3, c=4))
    table.delete(some(spark, a=0, z=0))
    assert rows_of(table) == {"b": 3, "c": 4} and rows_of(table, 1) == {"a": 1, "b": 2} and rows_of(table, 2) == {"a": 1, "b": 3, "c": 4}
    table.upsert(some(spark, a=9))
    table.delete_where(F.col("n") == 4)
    assert rows_of(table) == {"a": 9, "b": 3}
    assert table.update(lambda rows: None) == 5
    assert table.compact() == 6 and rows_of(table) == {"a": 9, "b": 3} and len(table._parts(6)) == 1
    assert table.vacuum(older_than_seconds=3600) == 0
    table.upsert(some(spark, b=1))
    assert table.vacuum(older_than_seconds=-1) == 5 and table.versions() == [7] and rows_of(table) == {"a": 9, "b": 1}


def at_once(n, work):
    failures = []

    def run(i):
        try:
            work(i)
        except Exception as failure:  # noqa: BLE001 - shown below
            failures.append(failure)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures, failures


def test_writers_at_once_lose_nothing(spark, table):
    table.upsert(some(spark, sum=0))

    def work(i):
        other = VersionedTable(spark, table.folder, "k string, n bigint", "k")
        for j in range(3):
            other.update(lambda rows: rows.where("k = 'sum'").withColumn("n", F.col("n") + 1))
            other.upsert(some(spark, **{f"w{i}-{j}": j}))
        if i == 0:
            other.compact()

    at_once(3, work)
    assert rows_of(table) == {"sum": 9, **{f"w{i}-{j}": j for i in range(3) for j in range(3)}}
    assert table.versions() == list(range(1, table.version() + 1))


def test_a_version_is_made_once(table):
    made = []
    at_once(8, lambda i: made.append(table._create(1, [str(i)])))
    assert sorted(made) == [False] * 7 + [True]


def test_a_version_is_made_once_where_links_are_missing(table):
    table.local = False
    assert table._create(1, ["a"]) and not table._create(1, ["b"]) and table._parts(1) == ["a"]
    assert table.versions() == [1]


def test_cache(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    entries = spark.createDataFrame([("a", "1", "m", "p", 5), ("b", "2", "m", "p", 7)], "cache_key string, value string, model string, provider string, tokens_used bigint")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    cache.put(entries, at(1000))
    keys = spark.createDataFrame([("a",), ("a",), ("none",)], "cache_key string")
    cache.touch(keys, at(2000))
    cache.touch(keys, at(3000))
    got = {r["cache_key"]: r for r in cache.read().withColumn("at", F.unix_timestamp("accessed_at")).collect()}
    assert (got["a"]["access_count"], got["a"]["at"], got["b"]["access_count"], got["b"]["at"]) == (4, 3000, 0, 1000) and len(got) == 2
    assert {(r["cache_key"], r["hit"]) for r in cache.get(keys, at(1000)).collect()} == {("a", True), ("none", False)}
    cache.put(entries.where("cache_key = 'b'"), at(90_000))
    cache.prune(at(90_001), older_than_days=1)
    assert [r["cache_key"] for r in cache.read().collect()] == ["b"]


def test_one_worker_gets_a_job(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "jobs"))
    job = log.create("load", spark.createDataFrame([("x",)], "item_id string"))
    got = []
    at_once(3, lambda i: got.append(JobLog(spark, log.folder).take(job, f"w{i}")))
    assert sorted(got) == [False, False, True]
    owner = f"w{[r['owner'][1] for r in log.owners.read().collect()][0]}"
    assert log.take(job, owner) and not log.release(job, "another")
    assert log.release(job, owner, "completed") and log.jobs().first()["status"] == "completed"
    assert log.take(job, "another") and log.jobs().first()["status"] == "running"


def test_events_at_one_time(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "jobs"))
    row = lambda event, item, error: ("j", "load", event, item, error, 2)
    events = [row("started", None, None), row("created", None, None), row("item", "x", "bad"), row("item", "x", None), row("item", "y", None), row("item", "y", "bad"), row("completed", None, None)]
    frame = spark.createDataFrame(events, "job_id string, job_type string, event string, item_id string, error string, total bigint").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    frame.repartition(3).write.parquet(f"{log.folder}/events")
    job = log.jobs().first()
    assert job["status"] == "completed" and job["processed"] == 2 and job["failed"] == 0
    assert {r["failed"] for r in log.items("j").collect()} == {False}
