"""Structured Streaming forms of row-wise operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.conversations import content_hash
from corpusmill.operators.formats import FORMATS
from corpusmill.operators.versioned import VersionedTable

#: Layouts that need other rows of their source, so only batches can make them.
_GROUPED = ("grpo",)


def read(spark: SparkSession, folder: str, schema: Any, glob: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def export(conversations: DataFrame, layouts: list[str], folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch prepared once and written in every layout, until what is there is done.

    A batch overwrites the folder of its own number, so that one that is repeated after a
    failure leaves no second copy.
    """
    if bad := [x for x in layouts if x in _GROUPED or x not in FORMATS]:
        raise ValueError(f"not row-wise: {', '.join(bad)}")

    def fan_out(batch: DataFrame, number: int) -> None:
        rows = (prepare(batch) if prepare else batch).persist()
        for layout in layouts:
            FORMATS[layout](rows).write.mode("overwrite").json(f"{folder}/{layout}/batch={number}")
        rows.unpersist()

    return conversations.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transform(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Any narrow operator, such as pruning or redaction, from a stream to Parquet files."""
    return operator(rows).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unrepeated(conversations: DataFrame, time: str | None = None, keep_for: str | None = None) -> DataFrame:
    """The stream without conversations whose content came before, in this micro-batch or an earlier one.

    What came is keyed state that survives a restart from the checkpoint.  With the event
    ``time`` and an interval ``keep_for``, state older than that is given up, and so what comes
    again after longer may pass; without, it grows with the contents.  Of copies in one
    micro-batch one passes, whichever; ``keep_first`` is exact in that.
    """
    hashed = conversations.withColumn("content_hash", content_hash(F.col("turns")))
    if time is None:
        return hashed.dropDuplicates(["content_hash"]).drop("content_hash")
    return hashed.withWatermark(time, keep_for).dropDuplicatesWithinWatermark(["content_hash"]).drop("content_hash")


#: Micro-batches after which the table of kept rows is compacted.
COMPACTED = 20


def kept_first(spark: SparkSession, folder: str, schema: Any) -> VersionedTable:
    """The table below ``folder`` that ``keep_first`` keeps, by content hash, for conversations of ``schema``."""
    return VersionedTable(spark, folder, schema.add("content_hash", "string").add("copies", "long"), "content_hash")


def keep_first(conversations: DataFrame, folder: str, checkpoint: str, order: str = "conv_id") -> StreamingQuery:
    """Keeps a table of the first conversation by ``order`` of each content, and how many copies came.

    Whatever the files' order and the batches they come in, the table is what ``deduplicate``
    gives for all that came so far: the least of each content is state, and what a batch
    changes replaces its rows in a versioned table.  A batch repeated after a failure
    puts the same rows in again.
    """
    spark = conversations.sparkSession
    schema = type(conversations.schema)(list(conversations.schema.fields))
    first = F.min_by(F.struct(*conversations.columns), order).alias("first")
    least = conversations.withColumn("content_hash", content_hash(F.col("turns"))).groupBy("content_hash").agg(first, F.count("*").alias("copies"))
    table = kept_first(spark, folder, schema)

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch.select("content_hash", "first.*", "copies"))
        if number % COMPACTED == COMPACTED - 1:
            table.compact()

    return least.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
