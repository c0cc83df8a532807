"""Calls of a generator from Spark tasks: a bounded number in flight, a shared rate, pauses, results kept at once.

A job's limits hold for all its tasks together: rows are dealt over as many tasks as may
run at once, and each has its share of the calls in flight and of the calls a minute
(speculative copies of tasks would exceed them).
A task keeps its share of calls in flight and gives results in the order of its rows.

With a log folder every finished call is appended to a file there before its result is
used.  A task that runs again reads what its earlier attempts wrote and repeats only the calls
that were in flight; a later job over the same folder calls only for keys without an answer.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any, NamedTuple, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.clients import Client, ClientError
from corpusmill.operators.shared import bounded, importable
from corpusmill.operators.state import pause


class Generator(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class Call(NamedTuple):
    """What a row's call came to; tokens are the client's or estimates."""

    response: str | None
    error: str | None
    attempts: int
    tokens_in: int = 0
    tokens_out: int = 0


CALL = "response string, error string, attempts int, tokens_in bigint, tokens_out bigint"


@dataclass(frozen=True)
class Limits:
    """What a job may do to a service, over all its tasks.

    ``concurrency`` calls are in flight at most and ``rpm`` a minute are started at most; a failed call
    is tried ``attempts`` times, with the pauses of ``state.pause`` between, in units of ``second``.
    """

    concurrency: int = 10
    rpm: float | None = None
    attempts: int = 5
    second: float = 1.0

    def __post_init__(self) -> None:
        if self.concurrency < 1 or self.attempts < 1 or self.second < 0 or (self.rpm is not None and self.rpm <= 0):
            raise ValueError(f"limits out of range: {self}")

    def share(self, task: int, tasks: int) -> Limits:
        """One of ``tasks`` tasks' part: calls in flight add up to all, and so do the calls a minute."""
        own = self.concurrency // tasks + (task < self.concurrency % tasks)
        return replace(self, concurrency=own, rpm=self.rpm and self.rpm * own / self.concurrency)


def limits_of(generator: Generator, limits: Limits | None) -> Limits:
    """``limits``, else those of the provider whose client this is, else the usual ones."""
    return limits or Limits(getattr(generator, "concurrency", 10), getattr(generator, "rpm", None))


class Limiter:
    """Starts of calls at least ``60 / rpm`` seconds apart, for all threads of a task."""

    def __init__(self, rpm: float | None) -> None:
        self.gap, self.next, self.lock = 60 / rpm if rpm else 0.0, float("-inf"), threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            start = max(self.next, time.monotonic())
            self.next = start + self.gap
        time.sleep(max(0.0, start - time.monotonic()))


def _called(generator: Generator, system: str, user: str) -> tuple[str, int, int]:
    """(response, tokens in, tokens out); the tokens that a client reports, else estimates."""
    if isinstance(generator, Client):
        reply = generator.chat([{"role": "system", "content": system or ""}, {"role": "user", "content": user or ""}])
        if reply.tokens_in or reply.tokens_out:
            return reply.content, reply.tokens_in, reply.tokens_out
        text = reply.content
    else:
        text = generator.generate(system, user)
    return text, max(1, len((system or "") + (user or "")) // 4), max(1, len(text) // 4) if text else 0


def answer(generator: Generator, limiter: Limiter, system: str, user: str, limits: Limits) -> Call:
    """One row's call, tried again after client errors.

    A rate limit is waited out for 2^k seconds, another client error for half of that; any
    other failure is final.
    """
    error = None
    for tried in range(1, limits.attempts + 1):
        limiter.wait()
        try:
            text, tokens_in, tokens_out = _called(generator, system, user)
            return Call(text, None, tried, tokens_in, tokens_out)
        except ClientError as failure:
            error = f"{type(failure).__name__}: {failure}"
            if tried < limits.attempts:
                time.sleep(limits.second * pause(tried - 1, failure.kind))
        except Exception as failure:  # noqa: BLE001 - reported in the row
            return Call(None, f"{type(failure).__name__}: {failure}", tried)
    return Call(None, error, limits.attempts)


class CallLog:
    """Results of one partition's calls as lines of JSON, a file for each attempt of its task.

    ``folder`` may be on any file system that pyarrow opens, and must be one that executors
    share.  Each line is flushed before its result is used.
    """

    def __init__(self, folder: str, partition: int) -> None:
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(folder)
        self.folder = f"{path.rstrip('/')}/partition={partition}"
        self.lock, self.stream = threading.Lock(), None

    def results(self) -> dict[Any, Call]:
        """What earlier attempts wrote; a line that was cut off is none."""
        from pyarrow import fs

        found = {}
        for file in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.files.open_input_stream(file.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue
                    found[row["key"]] = Call(*(row[f] for f in Call._fields))
        return found

    def append(self, key: Any, call: Call) -> None:
        line = json.dumps({"key": key, **call._asdict()}).encode() + b"\n"
        with self.lock:
            if self.stream is None:
                self.files.create_dir(self.folder)
                self.stream = self.files.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.json", compression=None)
            self.stream.write(line)
            self.stream.flush()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class Caller:
    """A task's calls: its share of the limits, and its log where there is one."""

    def __init__(self, generator: Generator, limits: Limits, tasks: int, folder: str | None) -> None:
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        self.generator, self.limits = generator, limits.share(number % tasks, tasks)
        self.limiter = Limiter(self.limits.rpm)
        self.log = CallLog(folder, number) if folder else None
        self.known = self.log.results() if self.log else {}

    def _one(self, key: Any, system: str, user: str) -> Call:
        call = answer(self.generator, self.limiter, system, user, self.limits)
        if self.log:
            self.log.append(key, call)
        return call

    def calls(self, items: Iterable[tuple[Any, str, str]]) -> Iterator[tuple[Any, Call]]:
        """(key, result) for each (key, system, user), in order; a bounded number is in flight or waits to be given."""
        waiting: deque[tuple[Any, Any]] = deque()
        with ThreadPoolExecutor(max(1, self.limits.concurrency)) as pool:
            for key, system, user in items:
                known = self.known.get(key)
                waiting.append((key, known or pool.submit(self._one, key, system, user)))
                if len(waiting) > 2 * self.limits.concurrency:
                    yield self._given(*waiting.popleft())
            while waiting:
                yield self._given(*waiting.popleft())
        if self.log:
            self.log.close()

    @staticmethod
    def _given(key: Any, call: Any) -> tuple[Any, Call]:
        return key, call if isinstance(call, Call) else call.result()


#: Results that a task hands over at once.
RESULTS = 64


def dealt(rows: DataFrame, limits: Limits) -> tuple[DataFrame, int]:
    """``rows`` over as many tasks as may call at once, and how many those are."""
    tasks = min(limits.concurrency, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks), tasks


def generate(rows: DataFrame, key: str, system: Column, user: Column, generator: Generator, limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """``key``, response, error, attempts, tokens_in, tokens_out: one call per row; an error is its row's own.

    The job keeps to ``limits`` over all tasks.  ``log`` is a folder of this job's results,
    kept as calls finish (see ``CallLog``); rows of one key then have one result.  The key is a string or a number.
    A null prompt is an empty one.  An empty table makes no calls.
    """
    importable(rows.sparkSession)
    limits = limits_of(generator, limits)
    source, tasks = dealt(rows.select(key, system.alias("system"), user.alias("user")), limits)
    run_folder = f"{log.rstrip('/')}/run={uuid.uuid4().hex}" if log else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(generator, limits, tasks, run_folder)
        kind = None

        def items() -> Iterator[tuple[Any, str, str]]:
            nonlocal kind
            for batch in bounded(batches):
                kind = batch.schema.field(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        def given(some: list[tuple[Any, Call]]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array([c[i] for _, c in some], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], kind), *columns], names=[key, *Call._fields])

        some = []
        for one in caller.calls(items()):
            some.append(one)
            if len(some) == RESULTS:
                yield given(some)
                some = []
        if some:
            yield given(some)

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, {CALL}")


def rewritten(rows: DataFrame, column: str, texts: Callable[[Any], list[tuple[Any, str]]], put: Callable[[Any, dict[Any, str]], Any], generator: Generator, limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """``rows`` with ``column`` rewritten by calls: ``texts`` gives a value's prompts by place, ``put`` puts the answers in.

    All other columns stay.  Equal prompts of up to a thousand rows are called for once; where a
    call fails, ``put`` gets no answer for its place.
    """
    importable(rows.sparkSession)
    limits = limits_of(generator, limits)
    source, tasks = dealt(rows, limits)
    at = rows.columns.index(column)
    run_folder = f"{log.rstrip('/')}/run={uuid.uuid4().hex}" if log else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(generator, limits, tasks, run_folder)
        for batch in bounded(batches, 1_000):
            values = batch.column(at).to_pylist()
            asked = [texts(v) for v in values]
            prompts = {hashlib.sha256(p.encode()).hexdigest(): p for own in asked for _, p in own}
            answers = {prompts[k]: c.response for k, c in caller.calls((k, "", p) for k, p in prompts.items()) if c.response}
            columns = batch.columns
            columns[at] = pa.array([put(v, {place: answers[p] for place, p in own if p in answers}) for v, own in zip(values, asked, strict=True)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return source.mapInArrow(run, source.schema)


def logged(rows: DataFrame, key: str, log: str) -> DataFrame:
    """``key`` and results of all answered calls that jobs left below ``log``, one of each key; none where there is no such folder."""
    kind = rows.schema[key].dataType.simpleString()
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{key} {kind}, {CALL}")
    lines = spark.read.schema(f"key {kind}, {CALL}").json(f"{log.rstrip('/')}/run=*/partition=*/*.json")
    whole = F.struct(*Call._fields)
    first = lines.where("key is not null and response is not null").groupBy(F.col("key").alias(key)).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("call"))
    return first.select(key, "call.*")


def resumed(rows: DataFrame, key: str, system: Column, user: Column, generator: Generator, log: str, limits: Limits | None = None) -> DataFrame:
    """As ``generate``, over the rows whose key has no answer below ``log`` yet; the others have the one that is there."""
    have = logged(rows, key, log)
    named = rows.select(key, system.alias("system"), user.alias("user"))
    rest = named.join(have.select(key), key, "left_anti")
    return have.join(named.select(key), key, "left_semi").unionByName(generate(rest, key, F.col("system"), F.col("user"), generator, limits, log))
