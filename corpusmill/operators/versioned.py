"""A keyed table in a folder that several jobs may change at once, as Parquet parts and a list of them for each version.

A change writes its rows as a new part and then commits: it creates the next version's
list, which only one writer can.  A writer that comes second takes the newer version as
its base and tries again, so no change is lost and readers see whole versions only.
Of rows of one key the latest part's counts; deleted keys are rows that say so.  ``compact``
folds the parts into one, ``vacuum`` deletes files that no kept version lists.

Locally the list is created by a hard link, elsewhere by a rename that does not
overwrite, which HDFS makes atomic; object stores without such a rename need one writer.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attempts at a commit before a writer gives up.
ATTEMPTS = 100
_DELETED, _PART = "deleted__", "part__"


class Conflict(RuntimeError):
    """Other writers came first too often."""


class VersionedTable:
    """Rows of ``schema``, one for each value of ``key``, below ``folder``; a folder without versions is an empty table."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        path = self._path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.files.getUri().getScheme() == "file"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    # Versions

    def versions(self) -> list[int]:
        """Numbers of the versions whose lists are kept, the newest last."""
        place = self._path(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in self.files.listStatus(place)] if self.files.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _parts(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self.files.open(self._path(f"{self.folder}/versions/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        return (self.versions() or [0])[-1]

    def _create(self, version: int, parts: list[str]) -> bool:
        """Whether this writer's list became that version."""
        final = self._path(f"{self.folder}/versions/{version:020d}.json")
        draft = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}.draft")
        stream = self.files.create(draft, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        try:
            if self.local:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            jvm = self.spark._jvm
            none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, final, none)
            return True
        except FileExistsError:
            return False
        except Exception as failure:
            if "FileAlreadyExists" in str(failure):
                return False
            raise
        finally:
            self.files.delete(draft, False)

    def _commit(self, change: Callable[[int, list[str]], list[str] | None]) -> int:
        """Commit the list that ``change`` makes of the newest version and its list, again and again until it is the next one; the version."""
        for tried in range(ATTEMPTS):
            base = self.version()
            parts = change(base, self._parts(base))
            if parts is None:
                return base
            if self._create(base + 1, parts):
                return base + 1
            time.sleep(random.random() * 0.01 * min(tried + 1, 20))
        raise Conflict(f"no commit to {self.folder} in {ATTEMPTS} attempts")

    # Rows

    def _read(self, parts: list[str]) -> DataFrame:
        """Key, other columns, deleted and the part's place in the list, one row for each key."""
        stored = T.StructType([*self.schema.fields, T.StructField(_DELETED, T.BooleanType())])
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*stored.fields, T.StructField(_PART, T.IntegerType())]))
        # One scan of all parts; a part's place in the list is told from its files' folder.
        places = F.create_map(*[F.lit(x) for i, p in enumerate(parts) for x in (p, i)])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.folder}/data/{p}" for p in parts])
        rows = rows.withColumn(_PART, F.element_at(places, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))
        if len(parts) == 1:
            return rows
        values = F.struct(*[c for c in rows.columns if c != self.key])
        return rows.groupBy(self.key).agg(F.max_by(values, _PART).alias("v")).select(self.key, "v.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        parts = self._parts(self.version() if version is None else version)
        return self._read(parts).where(~F.col(_DELETED)).select(*self.schema.fieldNames())

    def _write(self, rows: DataFrame, deleted: bool = False) -> str:
        part = uuid.uuid4().hex
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*columns, F.lit(deleted).alias(_DELETED)).write.parquet(f"{self.folder}/data/{part}")
        return part

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in, in place of those of the same keys; each key once.  The new version."""
        part = self._write(rows)
        return self._commit(lambda base, parts: [*parts, part])

    def delete(self, keys: DataFrame) -> int:
        """Take the rows of ``keys`` out.  The new version."""
        part = self._write(keys.select(self.key), True)
        return self._commit(lambda base, parts: [*parts, part])

    def update(self, change: Callable[[DataFrame], DataFrame | None]) -> int:
        """Put in what ``change`` makes of the table's rows; made anew where another writer comes first.

        Where ``change`` gives None, the table stays as it is.
        """

        def again(base: int, parts: list[str]) -> list[str] | None:
            rows = change(self.read(base))
            return None if rows is None else [*parts, self._write(rows)]

        return self._commit(again)

    def delete_where(self, condition: Column) -> int:
        """Take out the rows for which ``condition`` holds when the change is committed."""

        def again(base: int, parts: list[str]) -> list[str]:
            return [*parts, self._write(self.read(base).where(condition).select(self.key), True)]

        return self._commit(again)

    def compact(self) -> int:
        """Fold the parts into one; what others add meanwhile stays behind it."""
        base = self.version()
        old = self._parts(base)
        if len(old) < 2:
            return base
        part = self._write(self.read(base))

        def fold(newest: int, parts: list[str]) -> list[str] | None:
            # Another compaction may have been first; then this one is not needed.
            return [part, *parts[len(old) :]] if parts[: len(old)] == old else None

        return self._commit(fold)

    def vacuum(self, keep: int = 1, older_than_seconds: float = 3600.0) -> int:
        """Delete parts that none of the last ``keep`` versions lists, and older lists; how many parts.

        Younger parts stay, since a writer may be about to commit them.
        """
        versions = self.versions()
        kept = {p for v in versions[-keep:] for p in self._parts(v)}
        data = self._path(f"{self.folder}/data")
        before = (time.time() - older_than_seconds) * 1000
        gone = [s.getPath() for s in self.files.listStatus(data) if s.getPath().getName() not in kept and s.getModificationTime() <= before] if self.files.exists(data) else []
        for path in gone:
            self.files.delete(path, True)
        for v in versions[:-keep]:
            self.files.delete(self._path(f"{self.folder}/versions/{v:020d}.json"), False)
        return len(gone)


class ResultCache(VersionedTable):
    """Results by cache key, with times of creation and last access and a count of accesses."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder, "cache_key string, value string, model string, provider string, tokens_used bigint, created_at timestamp, accessed_at timestamp, access_count bigint", "cache_key")

    def put(self, entries: DataFrame, at: Column | None = None) -> int:
        """Entries (cache_key, value, model, provider, tokens_used), created now; one of a key that is there replaces it."""
        at = F.current_timestamp() if at is None else at
        return self.upsert(entries.withColumns({"created_at": at, "accessed_at": at, "access_count": F.lit(0).cast("bigint")}))

    def touch(self, keys: DataFrame, at: Column | None = None) -> int:
        """Count an access to each entry for each of its rows in ``keys``; keys without an entry do nothing."""
        at = F.current_timestamp() if at is None else at
        asked = keys.groupBy("cache_key").agg(F.count("*").alias("times"))
        return self.update(lambda rows: rows.join(asked, "cache_key").withColumns({"accessed_at": at, "access_count": F.col("access_count") + F.col("times")}))

    def get(self, items: DataFrame, now: Column | None = None, ttl_days: float = 30) -> DataFrame:
        """``items`` with their entries' columns and ``hit``; entries created longer ago are none."""
        from corpusmill.operators.state import lookup

        return lookup(items, self.read(), F.current_timestamp() if now is None else now, ttl_days)

    def prune(self, now: Column | None = None, older_than_days: float = 30) -> int:
        """Take out entries created longer ago."""
        now = F.current_timestamp() if now is None else now
        return self.delete_where(F.col("created_at").cast("double") < now.cast("timestamp").cast("double") - older_than_days * 86_400)
