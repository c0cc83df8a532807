"""What the operators of this folder share: text passes, tables in the shared folder, labels.

Every operator reads ``doc_id`` and ``text`` (others as named) and ignores further
columns, whatever their names, those that differ in case only included.  Rows are never
dropped for a null: a null text counts as an empty one and a null ``doc_id`` stays null
in the result.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.shared import cut, drop_cut, importable, spent_tables, spread

__all__ = ["cut", "drop_cut", "importable", "spent_tables", "spread"]

#: Documents, and bytes of text, handled at once inside a batch, so that long texts do not add up.
SLICE = 256
SLICE_BYTES = 8_000_000


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def as_text(column: pa.Array) -> list[str]:
    """Each text; a null is empty."""
    return pc.fill_null(column, "").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most ``size`` rows and ``most`` bytes in a text column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, before + most, "right")) - at
            n = max(1, min(n, size, batch.num_rows - at))
            yield batch.slice(at, n)
            at += n


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by their exact names: a further ``DOC_ID`` makes no ``doc_id`` ambiguous."""
    places = [df.columns.index(n) for n in names]
    return df.toDF(*[f"column{i}" for i in range(len(df.columns))]).select(*[F.col(f"column{i}").alias(n) for i, n in zip(places, names, strict=True)])


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the text as a string."""
    return pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))


def text_pass(docs: DataFrame, ddl: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """One narrow pass over (doc_id, text): no shuffle.

    ``work`` gets small batches of the two columns and yields, for each, a dict of
    column name to values; ``ddl`` names the columns that follow ``doc_id``.
    """
    source = id_and_text(docs)
    importable(docs.sparkSession)
    fields = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(ddl).fields])
    names = fields.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        for columns in work(slices(batches, 1)):
            arrays = [x if isinstance(x := columns[n], pa.Array) else pa.array(x, schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, fields)


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with names of its columns that no two share, ``doc_id`` and ``text`` as they are; ``toDF(*docs.columns)`` turns back."""
    kept = {docs.columns.index(n) for n in ("doc_id", "text")}
    return docs.toDF(*[n if i in kept else f"column{i}" for i, n in enumerate(docs.columns)])


def row_pass(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """A narrow pass over all columns that drops or rewrites rows; the columns stay as they are."""
    importable(docs.sparkSession)
    plain, at = plain_names(docs), docs.columns.index("text")
    return plain.mapInArrow(lambda batches: work(slices(batches, at)), plain.schema).toDF(*docs.columns)


#: A key that holds more than this part of all rows is hot; there are fewer hot keys than this.
HOT = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each ``key`` once and in ``copies`` how many of ``total`` rows have it.

    Rows of hot keys are joined by broadcast where they lie, so that they do not meet in
    one task; the others meet in a shuffle.
    """
    hot = F.broadcast(table.where(F.col(copies) * HOT > total).drop(copies))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(copies) * HOT <= total).drop(copies), key)
    return rows.join(hot, key).unionByName(rest)


def held_out() -> F.Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _smallest(rows: DataFrame, turn: Column, most: int) -> DataFrame:
    """``rows``, less most of those that can't be among the ``most`` with the smallest hash ``turn``.

    Few rows then reach the sort, however many partitions there are.  The bound doubles until
    it lets at least ``most`` rows pass, so that none of those is lost.
    """
    n = rows.count()
    share = (1.2 * most + 20) / max(n, 1)
    while share < 1:
        below = rows.where(turn < int(share * (1 << 64)) - (1 << 63))
        if below.count() >= most:
            return below
        share *= 2
    return rows


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, ddl: str, measure: Callable[[list[bytes]], list]) -> DataFrame:
    """(doc_id, label, measured) of at most ``most`` labelled documents outside the held-out third, one row each.

    The ids with the smallest hash are taken, so the choice does not depend on the order
    or the number of partitions; only they and their labels are broadcast, which ``most``
    bounds.  A document labelled twice has the larger label; null labels do not count.
    ``measure`` turns texts into values of type ``ddl`` where the texts lie, so texts are
    not shuffled; of rows that share a doc_id the one whose text has the smallest hash
    counts, picked before the shuffle.
    """
    usable = pick(labels, "doc_id", label).toDF("doc_id", "label").where("label is not null and doc_id is not null")
    usable = usable.where(~held_out()).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    turn = F.xxhash64("doc_id")
    usable = _smallest(usable, turn, most)
    chosen = usable.orderBy(turn, "doc_id").limit(most)
    source = id_and_text(docs).withColumn("order", F.xxhash64("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "order", "text")
    importable(docs.sparkSession)
    fields = T.StructType([*source.schema.fields[:3], *T.StructType.fromDDL(f"measured {ddl}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(fields).field("measured").type
        for batch in slices(batches, 3):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(measure(as_bytes(batch.column(3))), kind)], names=fields.fieldNames())

    first = F.min_by(F.struct("label", "measured"), "order").alias("first")
    return source.mapInArrow(run, fields).groupBy("doc_id").agg(first).select("doc_id", "first.label", "first.measured")


#: 64-bit words that a broadcast filter may have.
FILTER_WORDS = 1 << 19


def key_filter(keys: DataFrame, n: int, *columns: str) -> tuple[DataFrame, list[Column]]:
    """A filter of bounded size for ``n`` rows of ``keys``, and the columns that a table needs to be held against it.

    The filter is a table (word, filled) to broadcast; a row of another table may have its
    key among ``keys`` where ``filled & mark = mark``.  It lets none of ``keys`` slip.
    """
    words = max(1, min(FILTER_WORDS, n // 4))
    word = F.pmod(F.xxhash64(*columns), F.lit(words)).alias("word")
    other = F.xxhash64(*columns, F.lit(1))
    one = F.lit(1).cast("long")
    marks = [F.call_function("shiftleft", one, F.shiftright(other, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(3)]
    mark = marks[0].bitwiseOR(marks[1]).bitwiseOR(marks[2]).alias("mark")
    return keys.select(word, mark).groupBy("word").agg(F.bit_or("mark").alias("filled")), [word, mark]


def may_be_in(rows: DataFrame, filled: DataFrame, marks: list[Column]) -> DataFrame:
    """``rows`` with a boolean ``suspected``: whether the filter lets their keys pass."""
    return rows.select("*", *marks).join(F.broadcast(filled), "word", "left").withColumn("suspected", F.coalesce(F.col("filled").bitwiseAND(F.col("mark")) == F.col("mark"), F.lit(False))).drop("word", "mark", "filled")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")


def drop_suspects(docs: DataFrame, suspects: DataFrame, null_ids: bool = False, repeated: bool = False) -> DataFrame:
    """``docs`` without the rows that ``suspects`` (doc_id, text_hash, stays) says must go.

    ``suspects`` names each (doc_id, text_hash) that goes, or that several rows share: of
    those, where it stays, the row with the smallest hash of all columns does.  Rows that a
    broadcast filter rules out as suspects stay where they are; the others are looked up by
    a join, which makes the result exact.  Rows with a null doc_id all stay, unless
    ``null_ids`` says that ``suspects`` judges them too.  With ``repeated``, ``suspects`` names only
    what goes, and rows that share an id and a text stay or go together.
    """
    plain = plain_names(docs)
    filled, marks = key_filter(suspects, suspects.count(), "doc_id", "text_hash")
    held = may_be_in(plain.select("*", text_hash()), filled, marks)
    suspected = F.col("suspected") if null_ids else F.col("suspected") & F.col("doc_id").isNotNull()
    sure = held.where(~suspected).select(*plain.columns)
    names = suspects.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    looked_up = held.where(suspected).select(*plain.columns, "text_hash").join(names, same, "left").where("stays is null or stays").drop("id", "hash", "stays")
    if repeated:
        return sure.unionByName(looked_up.drop("text_hash")).toDF(*docs.columns)
    # A row that the table of suspects lacks is the only one of its id and hash.
    row = F.struct(*plain.columns)
    single = looked_up.groupBy("doc_id", "text_hash").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return sure.unionByName(single).toDF(*docs.columns)
