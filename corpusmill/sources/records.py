"""Records of big CSV, JSON and JSON-lines files, each file read by many tasks.

Spark's text source cuts a file into blocks at a separator: line breaks, or for JSON commas,
since an array may be one line.  A piece between separators need not be a record: a quoted
cell may hold line breaks, a string or an inner object commas.  Whether it is depends on what
came before, so reading takes three steps:

1. Each block is summed up for every state it may begin in: the state it ends in and the
   records that begin in it.  That is a row a block.
2. From these rows, file by file, follow the state that each block begins in and the number
   of its first record.
3. Each block is cut into records.  One that runs over a block's end is put together from its
   parts by file and number; only such parts are shuffled.

The rows of step 2, one for each block of input (``spark.sql.files.maxPartitionBytes``), are
broadcast; so are the headers of CSV files, one for each file.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.shared import cut, importable

#: The separator of each kind's pieces.
SEPARATORS = {"csv": "\n", "json": ",", "jsonl": "\n"}

_TO_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_ESCAPED = re.compile(r"\\.", re.S)
_SUMMARY = "file_path string, block bigint, first string, ends array<bigint>, starts array<map<bigint,bigint>>"


# A state is a number.  CSV: 1 inside a quoted cell, else 0.  JSON: 2 * depth, and 1 more inside a string.


def csv_after(line: str, state: int, delimiter: str) -> int:
    """The state after a line of CSV: whether a quoted cell is still open, as the csv module has it."""
    if '"' not in line:
        return state
    at = 0
    while True:
        if state or line.startswith('"', at):
            closed = _TO_CLOSE.match(line, at if state else at + 1)
            if not closed:
                return 1
            at, state = closed.end(), 0
        at = line.find(delimiter, at) + 1
        if not at:
            return 0


def json_after(piece: str, state: int) -> int:
    """The state after a piece of JSON between commas."""
    inside = state & 1
    if '"' in piece or inside:
        if "\\" in piece:
            piece = _ESCAPED.sub("", piece)
        parts = piece.split('"')
        # Every second part lies outside strings.
        piece = "".join(parts[inside::2])
        inside ^= len(parts) - 1 & 1
    depth = (state >> 1) + piece.count("[") + piece.count("{") - piece.count("]") - piece.count("}")
    return 2 * depth + inside


def _after(kind: str, delimiter: str) -> Callable[[str, int], int]:
    return {"csv": lambda piece, state: csv_after(piece, state, delimiter), "json": json_after, "jsonl": lambda piece, state: 0}[kind]


def _begins(kind: str, piece: str, state: int, first: bool) -> bool:
    """Whether a record begins with the piece, given the state before it; empty lines are none."""
    if kind == "json":
        return first or state == 2
    return state == 0 and piece.strip("\r") != "" and (kind == "csv" or not piece.isspace())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str]]:
    """(file, block, whether it is the block's first, piece) of every piece in order."""
    last = None
    for batch in batches:
        for path, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield path, block, (path, block) != last, piece
            last = path, block


def _summed_up(kind: str, delimiter: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block, from either state at depth 0: the state it ends in, and how many pieces begin in each state."""
    after = _after(kind, delimiter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("ends", pa.list_(pa.int64())), ("starts", pa.list_(pa.map_(pa.int64(), pa.int64())))])
        row: dict[str, Any] = {}
        for path, block, fresh, piece in _blocks(batches):
            if fresh:
                if row:
                    yield pa.RecordBatch.from_pylist([{**row, "starts": [list(s.items()) for s in row["starts"]]}], schema=schema)
                row = {"file_path": path, "block": block, "first": piece.lstrip()[:1], "ends": [0, 1], "starts": [{}, {}]}
            for i in (0, 1):
                state, starts = row["ends"][i], row["starts"][i]
                if kind == "json" or _begins(kind, piece, state, False):
                    starts[state] = starts.get(state, 0) + 1
                row["ends"][i] = after(piece, state)
        if row:
            yield pa.RecordBatch.from_pylist([{**row, "starts": [list(s.items()) for s in row["starts"]]}], schema=schema)

    return run


def _followed(kind: str) -> Callable[[Any], Any]:
    """For a file's summaries: the state each block begins in, the number of its first record, and whether the file is one record."""

    def run(rows):
        import pandas as pd

        rows = rows.sort_values("block")
        state, number, out = 0, 0, []
        whole = kind == "json" and rows["first"].iloc[0] != "["
        for path, block, ends, starts in zip(rows["file_path"], rows["block"], rows["ends"], rows["starts"], strict=True):
            out.append((path, block, state, number, whole))
            # The block was summed up from depth 0; its own depth is added to all that it met.
            lifted = state & ~1
            begun = dict(starts[state & 1]).get(2 - lifted, 0) if kind == "json" else sum(dict(starts[state]).values())
            number += (block == 0) if whole else begun + (kind == "json" and block == 0)
            state = int(ends[state & 1]) + lifted
        return pd.DataFrame(out, columns=["file_path", "block", "state", "number", "whole"])

    return run


def _cut_up(kind: str, delimiter: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records and parts of records: (file_path, i, block, record, part)."""
    after, separator = _after(kind, delimiter), SEPARATORS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("file_path", "i", "block", "record", "part")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        out: list[tuple] = []
        pieces: list[str] = []
        place, number, state, whole, cut_off = None, -1, 0, False, False

        def done(last: bool) -> None:
            if pieces and number >= 0:
                out.append((place[0], number, place[1], separator.join(pieces), cut_off or last))
            pieces.clear()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for path, block, piece, start, first_number, one in zip(*columns, strict=True):
                fresh = (path, block) != place
                if fresh:
                    done(True)
                    place, number, state, whole, cut_off = (path, block), first_number - 1, start, one, True
                if (not whole or fresh and block == 0) and _begins(kind, piece, state, fresh and block == 0):
                    done(False)
                    number, cut_off = number + 1, False
                elif kind != "json" and state == 0:
                    # An empty line between records is part of none.
                    done(False)
                    continue
                pieces.append(piece)
                state = after(piece, state)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        done(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def read_records(spark: SparkSession, path: str | list[str], kind: str, delimiter: str = ",") -> DataFrame:
    """file_path, i, record: the text of each record of ``csv``, ``json`` or ``jsonl`` files, numbered from 0 in each file.

    Of CSV, record 0 is the header.  Of JSON, records are the elements of an array, or a
    file that is no array as a whole.  Empty lines and files have no records.
    """
    importable(spark)
    read = spark.read.option("lineSep", SEPARATORS[kind]).text(path)
    pieces = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = pieces.mapInArrow(_summed_up(kind, delimiter), _SUMMARY)
    # Written once: both later steps need the same rows.
    states = cut(sums.groupBy("file_path").applyInPandas(_followed(kind), "file_path string, block bigint, state bigint, number bigint, whole boolean"), "blocks")
    placed = pieces.join(F.broadcast(states), ["file_path", "block"]).select("file_path", "block", "value", "state", "number", "whole")
    parts = cut(placed.mapInArrow(_cut_up(kind, delimiter), "file_path string, i bigint, block bigint, record string, part boolean"), "records")
    joined = parts.where("part").groupBy("file_path", "i").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    mended = joined.select("file_path", "i", F.array_join(F.transform("parts", lambda p: p["record"]), SEPARATORS[kind]).alias("record"))
    records = parts.where("not part").select("file_path", "i", "record").unionByName(mended)
    if kind != "json":
        return records
    # The brackets of the array are not its elements'.
    inner = records.join(F.broadcast(states.where("block = 0").select("file_path", "whole")), "file_path")
    last = F.max("i").alias("last")
    ends = F.broadcast(parts.groupBy("file_path").agg(last))
    opened = F.when((F.col("i") == 0) & ~F.col("whole"), F.regexp_replace("record", r"^\s*\[", "")).otherwise(F.col("record"))
    closed = F.when((F.col("i") == F.col("last")) & ~F.col("whole"), F.regexp_replace(opened, r"\]\s*$", "")).otherwise(opened)
    return inner.join(ends, "file_path").select("file_path", "i", closed.alias("record")).where(F.regexp_like("record", F.lit(r"\S")))


def record_texts(records: DataFrame, kind: str, delimiter: str = ",", text_column: str | None = None) -> DataFrame:
    """file_path, i, text, error of each record as the loaders write it: "[Row i]" and cells, or "[Entry i]" and indented JSON.

    A line of JSON lines that does not parse is "[Line i]" and the line; another record that
    does not is an error of its own.
    """
    importable(records.sparkSession)
    if kind == "csv":
        headers = F.broadcast(records.where("i = 0").select("file_path", F.col("record").alias("header")))
        records = records.where("i > 0").join(headers, "file_path")
    else:
        records = records.withColumn("header", F.lit(None).cast("string"))

    def cells(line: str) -> list[str]:
        return next(csv.reader(io.StringIO(line, newline=""), delimiter=delimiter), [])

    def said(i: int, record: str, header: str | None) -> str:
        if kind == "csv":
            row = dict(zip(cells(header or ""), cells(record), strict=False))
            if text_column is not None:
                return f"[Row {i}] {row.get(text_column, '')}"
            return "\n".join([f"[Row {i}]", *(f"{k}: {v.strip()}" for k, v in row.items() if k and v.strip())])
        try:
            return f"[Entry {i + 1}]\n{json.dumps(json.loads(record), indent=2, ensure_ascii=False)}"
        except ValueError:
            if kind == "json":
                raise
            return f"[Line {i + 1}] {record.strip()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for row in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True):
                try:
                    texts.append(said(*row))
                    errors.append(None)
                except (ValueError, csv.Error) as failure:
                    texts.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file_path", "i", "text", "error"])

    return records.select("file_path", "i", "record", "header").mapInArrow(run, "file_path string, i bigint, text string, error string")
