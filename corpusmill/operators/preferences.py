"""Preference pairs from scored conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.conversations import first_content
from corpusmill.operators.formats import score
from corpusmill.operators.shared import cut


def scored(conversations: DataFrame, order: str = "conv_id") -> DataFrame:
    """conv_id, source_chunk_id, ord, prompt, response, score of each conversation; the score may be null."""
    return conversations.select(
        "conv_id",
        "source_chunk_id",
        F.col(order).alias("ord"),
        F.coalesce(first_content(F.col("turns"), "user"), F.lit("")).alias("prompt"),
        F.coalesce(first_content(F.col("turns"), "assistant"), F.lit("")).alias("response"),
        score(F.col("judge_overall"), F.col("confidence_score")).alias("score"),
    )


_PAIR = ("prompt", "chosen", "rejected", "chosen_score", "rejected_score", "source_chunk_id", "best_conv_id", "worst_conv_id", "cross_source")


def _pairs(rows: DataFrame, min_gap: float, cross: bool, source: Column) -> DataFrame:
    """From columns best and worst: the gap and text tests, and the pair's row."""
    prompt = F.when(F.col("best.prompt") != "", F.col("best.prompt")).otherwise(F.col("worst.prompt"))
    made = rows.select(
        prompt.alias("prompt"),
        F.col("best.response").alias("chosen"),
        F.col("worst.response").alias("rejected"),
        F.col("best.score").alias("chosen_score"),
        F.col("worst.score").alias("rejected_score"),
        source.alias("source_chunk_id"),
        F.col("best.conv_id").alias("best_conv_id"),
        F.col("worst.conv_id").alias("worst_conv_id"),
        F.lit(cross).alias("cross_source"),
    )
    return made.where((F.col("chosen_score") - F.col("rejected_score") >= min_gap) & (F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != ""))


def in_source_pairs(conversations: DataFrame, min_gap: float = 0.1, order: str = "conv_id") -> DataFrame:
    """The best and the worst conversation of each source with two scored ones at least.

    Of equal scores the first by order is best and the last is worst.  Both are found by
    aggregates that combine before the shuffle, so a source with very many conversations
    costs its task no more than another.
    """
    row = F.struct("conv_id", "prompt", "response", "score")
    rows = scored(conversations, order).where("score is not null and source_chunk_id is not null")
    best = F.max_by(row, F.struct("score", (-F.col("ord")).alias("o"))).alias("best")
    worst = F.min_by(row, F.struct("score", (-F.col("ord")).alias("o"))).alias("worst")
    grouped = rows.groupBy("source_chunk_id").agg(best, worst, F.count("*").alias("n")).where("n >= 2")
    return _pairs(grouped, min_gap, False, F.col("source_chunk_id")).select(*_PAIR)


def ranked_globally(rows: DataFrame, sort: list[Column], buckets: int | None = None) -> DataFrame:
    """Adds rank (from 1) and total over the whole table without one task that sorts it all.

    Rows are dealt by range, ranked within their range, and offset by the sizes of the
    ranges before, of which there are as many as partitions.  The dealt rows are written
    first: ranges come from a sample, so they must be drawn once only.
    """
    dealt = cut(rows.repartitionByRange(*([buckets] if buckets else []), *sort).withColumn("_part", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*sort)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    window = Window.orderBy("_part")
    offsets = sizes.select("_part", (F.sum("_n").over(window) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    return local.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def cross_source_pairs(conversations: DataFrame, min_gap: float = 0.1, order: str = "conv_id") -> DataFrame:
    """Conversations that are alone in their source, paired from the outside in by score.

    A pair that fails the gap or the text test uses up both.
    """
    rows = scored(conversations, order)
    alone = conversations.groupBy("source_chunk_id").agg(F.count("*").alias("n")).where("n < 2").select("source_chunk_id")
    single = rows.where("score is not null").join(alone, "source_chunk_id", "left_semi")
    ranked = ranked_globally(single, [F.col("score").desc(), F.col("ord").asc()])
    row = F.struct("conv_id", "prompt", "response", "score")
    # Both of a pair have the smaller of rank and total + 1 - rank in common; the middle one stays alone.
    pairs = ranked.where("rank * 2 <> total + 1").groupBy(F.least(F.col("rank"), F.col("total") + 1 - F.col("rank")).alias("pair")).agg(F.min_by(row, "rank").alias("best"), F.max_by(row, "rank").alias("worst"))
    return _pairs(pairs, min_gap, True, F.lit(None).cast(conversations.schema["source_chunk_id"].dataType)).select(*_PAIR)


def to_dpo(pairs: DataFrame) -> DataFrame:
    return pairs.select("prompt", "chosen", "rejected", F.bround("chosen_score", 4).alias("score_chosen"), F.bround("rejected_score", 4).alias("score_rejected"))


def to_kto(pairs: DataFrame) -> DataFrame:
    """Two rows a pair."""
    both = F.explode(F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label"))))
    return pairs.select("prompt", both.alias("x")).select("prompt", "x.completion", "x.label")


def to_orpo(pairs: DataFrame) -> DataFrame:
    return pairs.select("prompt", "chosen", "rejected")


def to_grpo(pairs: DataFrame) -> DataFrame:
    return pairs.select("prompt", F.array("chosen", "rejected").alias("completions"), F.array(F.bround("chosen_score", 4), F.bround("rejected_score", 4)).alias("rewards"))
