"""Jobs as an append-only event log in a folder: state is a query, nothing is rewritten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.shared import cut, drop_cut
from corpusmill.operators.versioned import VersionedTable

EVENT = "job_id string, job_type string, event string, item_id string, error string, total bigint, ts timestamp"
#: Events that set a job's status, and the status.
STATUS = {"created": "pending", "started": "running", "paused": "paused", "completed": "completed", "failed": "failed", "cancelled": "cancelled", "deleted": "deleted"}


def _item_turn() -> Column:
    """Order of an item's results: by time; at one time success counts."""
    return F.struct("ts", F.col("error").isNull().alias("ok"))


class JobLog:
    """The log of jobs below ``folder``; each call appends one file.

    Who works on a job is a versioned table beside it, so of several workers one gets it.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.owners = VersionedTable(spark, f"{folder}/owners", "job_id string, owner string", "job_id")

    def take(self, job_id: str, owner: str) -> bool:
        """Whether ``owner`` may work on the job from now on: nobody else does.  Its status is then running."""
        taken = False

        def claim(rows: DataFrame) -> DataFrame | None:
            nonlocal taken
            now = rows.where(F.col("job_id") == job_id).first()
            taken = now is None or now["owner"] == owner
            return self.spark.createDataFrame([(job_id, owner)], "job_id string, owner string") if taken else None

        self.owners.update(claim)
        if taken:
            self.record(job_id, "started")
        return taken

    def release(self, job_id: str, owner: str, event: str = "paused") -> bool:
        """End ``owner``'s work on the job with an event of its status; false where another has it."""
        if self.owners.read().where((F.col("job_id") == job_id) & (F.col("owner") == owner)).isEmpty():
            return False
        self.record(job_id, event)
        self.owners.delete(self.spark.createDataFrame([(job_id,)], "job_id string"))
        return True

    def create(self, job_type: str, items: DataFrame, job_id: str | None = None) -> str:
        """A new job over the ids in ``items`` (item_id)."""
        job_id = job_id or uuid.uuid4().hex
        items.select("item_id").write.parquet(f"{self.folder}/items/job_id={job_id}")
        self.record(job_id, "created", job_type=job_type, total=items.count())
        return job_id

    def record(self, job_id: str, event: str, job_type: str | None = None, total: int | None = None) -> None:
        if event not in STATUS:
            raise ValueError(f"unknown event: {event}")
        row = self.spark.createDataFrame([(job_id, job_type, event, None, None, total)], EVENT.rpartition(",")[0])
        row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/events")

    def record_items(self, job_id: str, results: DataFrame) -> None:
        """Append (item_id, error) of items that were tried; a null error is success."""
        rows = results.select(F.lit(job_id).alias("job_id"), F.lit(None).cast("string").alias("job_type"), F.lit("item").alias("event"), "item_id", "error", F.lit(None).cast("bigint").alias("total"), F.current_timestamp().alias("ts"))
        rows.write.mode("append").parquet(f"{self.folder}/events")

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{self.folder}/events")

    def items(self, job_id: str) -> DataFrame:
        """item_id, failed: last state of each item that was tried."""
        tried = self.events().where((F.col("job_id") == job_id) & (F.col("event") == "item"))
        return tried.groupBy("item_id").agg(F.max_by(F.col("error").isNotNull(), _item_turn()).alias("failed"))

    def todo(self, job_id: str, retry_failed: bool = True) -> DataFrame:
        """Items without a result; on resumption failed ones are tried again."""
        done = self.items(job_id)
        every = self.spark.read.parquet(f"{self.folder}/items/job_id={job_id}")
        return every.join(done.where(~F.col("failed")) if retry_failed else done, "item_id", "left_anti")

    def jobs(self) -> DataFrame:
        """job_id, job_type, status, created_at, total, processed, failed, progress."""
        # Of events at one time the one that comes later in a job's life counts.
        status = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("event"))
        order = F.array_position(F.array(*map(F.lit, STATUS)), F.col("event")).alias("order")
        log = self.events()
        heads = log.where("event <> 'item'").groupBy("job_id").agg(F.max("job_type").alias("job_type"), F.max_by(status, F.struct("ts", order)).alias("status"), F.min("ts").alias("created_at"), F.max("total").alias("total"))
        tried = log.where("event = 'item'").groupBy("job_id", "item_id").agg(F.max_by(F.col("error").isNotNull(), _item_turn()).alias("bad"))
        counts = tried.groupBy("job_id").agg(F.count_if(~F.col("bad")).alias("processed"), F.count_if("bad").alias("failed"))
        joined = heads.where("status <> 'deleted'").join(counts, "job_id", "left").fillna(0, ["processed", "failed"])
        return joined.withColumn("progress", F.when(F.col("total") > 0, (F.col("processed") + F.col("failed")) * 100.0 / F.col("total")).otherwise(0.0))

    def delete(self, job_id: str) -> bool:
        """Take a job off the list; false where it is not on it."""
        if self.jobs().where(F.col("job_id") == job_id).isEmpty():
            return False
        self.record(job_id, "deleted")
        return True

    def clean_up(self, older_than_days: float = 30) -> int:
        """Take jobs off the list that were created longer ago; their number."""
        limit = F.current_timestamp().cast("double") - older_than_days * 86_400
        old = self.jobs().where(F.col("created_at").cast("double") < limit).select("job_id", F.lit(None).cast("string").alias("job_type"), F.lit("deleted").alias("event"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("bigint").alias("total"), F.current_timestamp().alias("ts"))
        gone = cut(old, "gone")
        gone.write.mode("append").parquet(f"{self.folder}/events")
        n = gone.count()
        drop_cut(gone)
        return n
