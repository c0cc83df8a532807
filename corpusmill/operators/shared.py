"""What operators share: tables in the folder that driver and executors share, and dealing small tables over all cores."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the path the driver has it at."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), _ROOT) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster
    there is none that all could read, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _local_folder()
    return folder


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


#: Rows and bytes that a pass works on at once: what it makes of them, which may be many times as much, is held together.
PASS_ROWS = 256
PASS_BYTES = 2_000_000


def bounded(batches: Iterator[Any], rows: int = PASS_ROWS, most: int = PASS_BYTES) -> Iterator[Any]:
    """Parts of Arrow batches with at most ``rows`` rows and ``most`` bytes in texts and binaries, or one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, min(int(np.searchsorted(ends, before + most, "right")) - at, rows))
            yield batch.slice(at, n)
            at += n


class _Spent(threading.local):
    """Paths of tables cut inside the open ``spent_tables`` blocks of a thread, the innermost last."""

    def __init__(self) -> None:
        self.paths: list[list[str]] = []


_spent = _Spent()


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps then start from files that survive a lost executor, and the work before is
    done once.  A ``spent_tables`` block around this deletes the table, but where ``keep``.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _spent.paths and not keep:
        _spent.paths[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder; a ``spent_tables`` block around this deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"
    if _spent.paths:
        _spent.paths[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    _delete(df.sparkSession, df.cut_path)
    for paths in _spent.paths:
        if df.cut_path in paths:
            paths.remove(df.cut_path)


@contextmanager
def spent_tables(spark: SparkSession) -> Iterator[None]:
    """At the block's end, delete the tables cut inside it."""
    _spent.paths.append([])
    try:
        yield
    finally:
        for path in _spent.paths.pop():
            _delete(spark, path)


#: A table of up to this many bytes is dealt over all cores.
SMALL_TABLE = 64_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores where it is a small table.

    A small file is one group of rows, which no scan reads in parts, however many tasks
    are planned for it.  What this shuffles is bounded whatever the input; larger tables
    are split by their scan.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_TABLE else df
