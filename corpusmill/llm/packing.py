"""Packing by minimum bin slack: documents into windows of a fixed number of tokens.

A document's whole windows stand alone; its rest, shorter than a window, is packed with
other rests.  Only how many rests there are of each length matters for which lengths go
together, and there are fewer lengths than a window has tokens.  So the driver plans on
that histogram, whose size is bounded by the window: bitset subset-sum dynamic
programming picks the multiset of remaining lengths that comes closest to the
capacity, backtracking gives its counts, and it is used as often as they allow.  The
plan is broadcast, and each rest finds its place by its rank among those of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import as_text, cut, importable, text_pass

WINDOW = 1024
#: Rests of one length that are ranked in one group: at most this many, or a ``GROUPS``-th of all where that is less.
RANKED = 50_000
GROUPS = 1000
#: Copies of one rest that become rows in one go.
DEALT = 1024
#: Sequence ids of packed rests start here; whole windows have ids below.
PACKED = 1 << 62


class Encoder:
    """Token ids as the tokenizer file gives them without special tokens added.

    The rank file of the same vocabulary encodes several times faster.  It serves texts
    of characters up to U+024F, whose classes are the same in every Unicode version, and
    without the tokenizer's special strings; the tokenizer itself encodes the others.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.plain = re.compile("[\x00-ɏ]*").fullmatch
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())).search

    def ids(self, text: str) -> np.ndarray:
        if self.plain(text) and not self.special(text):
            return np.array(self.fast(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, whole: each document's windows and its rest, in one narrow pass.

    ``whole`` numbers whole windows, unique over the table; it is null for a rest.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(vocabulary, ranks, pattern)
        whole = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, start, length, crc, total, number = [], [], [], [], [], []
            for row, text in enumerate(as_text(batch.column(1))):
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    rows.append(row)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(crc32(piece.tobytes()))
                    total.append(len(ids))
                    number.append(whole if len(piece) == window else None)
                    whole += len(piece) == window
            yield {"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "whole": number}

    return text_pass(docs, "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, whole bigint", work)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to ``capacity`` from below.

    Bit s of a bitset says that some choice among the lengths so far sums to s.  Lengths
    come from the longest down, so that backtracking prefers long ones.
    """
    reach, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            used = min(part, left)
            steps.append((length, used, reach))
            reach |= reach << (length * used) & mask
            left -= used
            part *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, used, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + used
            at -= length * used
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(counts by length of one sequence, how many such sequences), until no rest is left.

    Each pattern holds the longest length that is left and the fullest filling beside it.
    It is used as often as its counts allow, so each uses up a length: patterns do not
    outnumber lengths by much, whatever the number of documents.
    """
    left = {k: n for k, n in histogram.items() if n}
    patterns = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        pattern = fullest({k: n for k, n in rest.items() if n and k <= window - longest}, window - longest) if window > longest else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        patterns.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return patterns


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Length to its segments, one row each: first rank, rests a sequence, first sequence, offset there."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            table.setdefault(length, []).append((taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to the table that ``pieces`` makes.

    Sequences are gapless from offset 0; one that is not full is padded to the window, but
    where its tokens are a power of two.  Rests of one length are ranked in salted
    groups, so no length lands in one task however many have it.
    """
    spark = pieces.sparkSession
    importable(spark)
    # Written once: ranks, histogram and result must come from the same rows.
    table = cut(pieces, "pieces")
    names = [c for c in pieces.columns if c != "whole"]
    # Equal rests are counted where they lie and ranked as one row, however many there are.
    rests = table.where("whole is null").groupBy(*names).agg(F.count("*").alias("copies"))
    counts = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.sum("copies").alias("n")).collect()}
    # A row for each length: fewer than the window has tokens.
    group = max(1, min(RANKED, -(-sum(counts.values()) // GROUPS)))
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // group)) for k, n in counts.items()], "length bigint, salts bigint"))
    salted = rests.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    by_salt = salted.groupBy("length", "salt").agg(F.sum("copies").alias("n"))
    before = by_salt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    upto = F.sum("copies").over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, 0))
    first = salted.withColumn("local", upto - F.col("copies")).join(before, ["length", "salt"]).select(*names, "copies", (F.col("before") + F.col("local")).alias("rank"))
    # The copies of a row that has many are dealt out in runs before they become rows again.
    run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(DEALT).cast("bigint"))).alias("run")
    runs = first.where(F.col("copies") > DEALT).select("*", run).select(*names, F.least(F.col("copies") - F.col("run"), F.lit(DEALT).cast("bigint")).alias("copies"), (F.col("rank") + F.col("run")).alias("rank"))
    dealt = first.where(F.col("copies") <= DEALT).unionByName(runs.repartition("rank", *names))
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("nth")
    ranked = dealt.select("*", nth).select(*names, (F.col("rank") + F.col("nth")).alias("rank"))
    shared = spark.sparkContext.broadcast(slots(plan(counts, window)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own, segments = np.flatnonzero(length == k), shared.value[k]
                at = segments[np.searchsorted(segments[:, 0], rank[own], "right") - 1]
                copy, nth = np.divmod(rank[own] - at[:, 0], at[:, 1])
                sequence[own], offset[own] = PACKED + at[:, 2] + copy, at[:, 3] + nth * k
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ranked.select(*names).schema.add("sequence_id", T.LongType()).add("offset", T.LongType())
    packed = ranked.mapInArrow(place, fields)
    return packed.unionByName(table.where("whole is not null").select(*names, F.col("whole").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its whole text's ids and then id 0; every id lies in just one piece.  A
    null or empty text is the one id 0.  Repeated rows are packed as often as they
    come; an empty table gives no pieces.
    """
    return pack(pieces(docs, vocabulary, ranks, pattern, window), window)
