"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

A first scan takes of each text only its length and the hash of its first ``PREFIX``
bytes, and writes these small rows.  Lengths that one row alone has drop out, then pairs
of length and prefix hash that one row alone has.  The keys that survive fill a filter of
bounded size, which is broadcast to a second scan: only texts that it lets pass are hashed
whole, and only their hashes are shuffled.  A text that the filter lets pass by error is
found to be alone by its full hash, so the filter's size changes no result; where very
many groups survive it fills up and more texts are hashed.

Texts are never shuffled.  Groups are counted before the shuffle and hot groups of copies
are joined where their rows lie, so no group gathers in one task.  The main path is JVM
expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, drop_cut, drop_suspects, hot_join, id_and_text, key_filter, may_be_in, text_hash

#: Bytes of a text that the second step looks at.
PREFIX = 256


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, text (a null is empty), length in bytes, hash of the first bytes; nothing of this shuffles."""
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("length", F.octet_length("text")).withColumn("prefix", F.xxhash64(F.substring(F.col("text").cast("binary"), 1, PREFIX)))


def _shared(keys: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``n`` of the groups of ``keys`` that more than one row has; ``n`` of a row counts its copies."""
    return keys.groupBy(*columns).agg(F.sum("n").alias("n")).where("n > 1")


def surviving(docs: DataFrame) -> DataFrame:
    """(length, prefix, n) that more than one row has: the first two steps.

    The result is a table in the shared folder, to be dropped with ``drop_cut``.
    """
    # A row for each length and prefix, however many copies have them.
    keys = cut(_sized(docs).groupBy("length", "prefix").agg(F.count("*").alias("n")), "keys")
    lengths = _shared(keys, "length").select("length", F.col("n").alias("rows"))
    pairs = hot_join(keys, lengths.withColumn("rows", F.col("rows").cast("bigint")), "length", "rows", keys.agg(F.sum("n")).first()[0] or 0)
    survivors = cut(_shared(pairs, "length", "prefix"), "survivors")
    drop_cut(keys)
    return survivors


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id is kept; of rows equal in
    both one, whichever, since nothing here tells them apart.  ``keep_id`` is null only where
    all ids of the group are.  A null text is an empty one.  ``text_sha256`` is
    null for a text that the refinement found alone without reading it whole, unless
    ``digest_all`` asks for every text's.  Texts may be of any length; an empty table gives
    none.
    """
    survivors = surviving(docs)
    filled, marks = key_filter(survivors, survivors.count(), "length", "prefix")
    held = may_be_in(_sized(docs), filled, marks)
    whole = F.sha2(F.col("text").cast("binary"), 256)
    digest = whole if digest_all else F.when(F.col("suspected"), whole)
    # Written once: the number of a row must be the same in every step.
    rows = cut(held.select("doc_id", digest.alias("digest"), "suspected", F.monotonically_increasing_id().alias("number")), "digests")
    alone = rows.where("not suspected").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    suspects = rows.where("suspected").select("doc_id", "digest", "number")
    groups = suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "number")).alias("keep"), F.count("*").alias("group_size"), F.count("*").alias("copies"))
    joined = hot_join(suspects, groups, "digest", "copies", suspects.count())
    grouped = joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("number") == F.col("keep.number")).alias("kept"), F.col("digest").alias("text_sha256"))
    drop_cut(survivors)
    return alone.unionByName(grouped)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, all columns as they are: the row with the largest doc_id.

    Of rows equal in id and text, the one with the smallest hash of all its columns stays, so
    the choice does not depend on partitions.  Where all ids of a text are null, its rows can't be
    told apart by id and the one with the smallest hash stays likewise; a null id goes where
    a copy has one.
    """
    survivors = surviving(docs)
    filled, marks = key_filter(survivors, survivors.count(), "length", "prefix")
    texts = may_be_in(_sized(docs), filled, marks).where("suspected")
    ids = cut(texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), text_hash()).groupBy("doc_id", "digest", "text_hash").agg(F.count("*").alias("n")), "copies")
    keep = F.max("doc_id").alias("keep_id")
    groups = ids.groupBy("digest").agg(keep, F.count("*").alias("copies"))
    judged = hot_join(ids, groups, "digest", "copies", ids.count())
    stays = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    suspects = judged.select("doc_id", "text_hash", stays.alias("stays"), "n").where("not stays or n > 1").drop("n")
    suspects = cut(suspects, "suspects")
    drop_cut(survivors)
    drop_cut(ids)
    return drop_suspects(docs, suspects, null_ids=True)


def oracle_sql() -> str:
    """``exact_groups`` with all digests as DuckDB SQL over ``documents``."""
    return """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text)"""
