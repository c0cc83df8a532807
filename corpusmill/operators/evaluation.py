"""Evaluation without a model: judge arithmetic, n-gram contamination and the gate."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import split_words
from corpusmill.operators.conversations import contents, heuristic_valid
from corpusmill.operators.shared import importable
from corpusmill.schema import EvalThresholds


def normalized_score(value: Column) -> Column:
    """Clamped to 0..10, two decimals; null where there is none."""
    return F.when(value.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(10.0), value)), 2))


def normalize_scores(scores: Column) -> Column:
    """A map of rubric scores, clamped; ``overall`` is the mean of the others where it is missing."""
    clamped = F.map_filter(scores, lambda k, v: v.isNotNull())
    parts = F.transform(F.map_values(F.map_filter(clamped, lambda k, _: k != "overall")), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(10.0), v)))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts)
    out = F.transform_values(clamped, lambda _, v: normalized_score(v))
    missing = ~F.map_contains_key(clamped, F.lit("overall")) & (F.size(parts) > 0)
    return F.when(missing, F.map_concat(out, F.create_map(F.lit("overall"), F.bround(mean, 2)))).otherwise(out)


def confidence(overall: Column) -> Column:
    """A tenth of the overall, clamped to 0..1; null where there is none."""
    return F.when(overall.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall / 10)))


def agreement(one: Column, other: Column) -> Column:
    """Of two judges: 1 less a tenth of their difference, three decimals."""
    return F.bround(1 - F.abs(one - other) / 10, 3)


def grams(text: Column, n: Column) -> Column:
    """Distinct n-grams of lower-cased words; n is a column, at least 1."""
    words = split_words(F.lower(text))
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>")))
    return F.get(made, F.lit(0))


#: Characters of references whose n-grams may be broadcast.
REFERENCE_CHARS = 8_000_000


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(name, "text", F.size(split_words(F.lower(F.col("text")))).alias("words")).where("words > 0")


def _exploded(docs: DataFrame, n: int, short: list[int]) -> DataFrame:
    """doc_id, d_words, k, n_grams, g: all distinct n-grams of the documents, native."""
    own = F.array(F.least(F.lit(n), F.col("words")))
    sizes = F.array_distinct(F.concat(own, F.filter(F.array(*[F.lit(k) for k in short]), lambda k: k <= F.col("words")))) if short else own
    each = _counted(docs, "doc_id").select("doc_id", F.col("words").alias("d_words"), F.explode(sizes).alias("k"), "text")
    return each.select("doc_id", "d_words", "k", grams(F.col("text"), F.col("k")).alias("gs")).select("doc_id", "d_words", "k", F.size("gs").alias("n_grams"), F.explode("gs").alias("g"))


def _shared(docs: DataFrame, references: list[str], n: int, short: list[int]) -> DataFrame:
    """The same for those n-grams only that a reference has: looked up by hash where the texts lie."""
    importable(docs.sparkSession)
    source = docs.select("doc_id", "text")
    fields = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("d_words int, k int, n_grams int, g string").fields])
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def hashed(words: list[str], k: int) -> Any:
        import numpy as np

        own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        out = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + own[i : len(words) - k + 1 + i]
        return out

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        known: dict[int, Any] = {}  # hashes are this process's own
        for k in range(1, n + 1):
            found = [hashed(words, k) for text in shared.value if len(words := text.lower().split()) >= k]
            known[k] = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        for batch in batches:
            rows: list[tuple[int, int, int, int, str]] = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").lower().split()
                for k in {min(n, len(words)), *(x for x in short if x <= len(words))} - {0}:
                    own, first = np.unique(hashed(words, k), return_index=True)
                    rows += [(at, len(words), k, len(own), " ".join(words[i : i + k])) for i in first[np.isin(own, known[k])].tolist()]
            columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            numbers = [pa.array(c, pa.int32()) for c in columns[1:4]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *numbers, pa.array(columns[4], pa.string())], names=fields.fieldNames())

    return source.mapInArrow(run, fields)


#: 64-bit words of the filter of reference n-grams: what is broadcast, however many there are.
FILTER_WORDS = 1 << 20


def _sifted(docs: DataFrame, ref: DataFrame) -> DataFrame:
    """Rows (k, g) of the documents less most that no reference has, by a filter where they lie; rows that one has all stay."""
    key, bits = F.xxhash64("k", "g"), F.xxhash64("g", "k")
    word = F.pmod(key, F.lit(FILTER_WORDS)).alias("word")
    one = F.lit(1).cast("long")
    marks = [F.call_function("shiftleft", one, F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(3)]
    mark = marks[0].bitwiseOR(marks[1]).bitwiseOR(marks[2]).alias("mark")
    filled = ref.select(word, mark).groupBy("word").agg(F.bit_or("mark").alias("filled"))
    kept = docs.select("*", word, mark).join(F.broadcast(filled), "word").where(F.col("filled").bitwiseAND(F.col("mark")) == F.col("mark"))
    return kept.drop("word", "mark", "filled")


def ngram_overlap(docs: DataFrame, references: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, ref_id, overlap: the share of a document's distinct n-grams that a reference has; pairs with some only.

    ``docs`` has doc_id and text, ``references`` ref_id and text.  The n of a pair is the
    least of n and both numbers of words, so a document has its n-grams at its own size and
    at those of shorter references.  Where the references are small, which is counted, their
    n-grams are broadcast and only shared ones leave the documents; beyond that they meet in
    a join, and a filter of bounded size says which documents' n-grams may be shared, so
    that few others are shuffled until it fills up.
    """
    r = _counted(references, "ref_id")
    size = r.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.array_sort(F.collect_set(F.when(F.col("words") < n, F.col("words")))).alias("short")).first()
    sizes = F.array(*[F.lit(k) for k in range(1, n + 1)])
    ref = r.select("ref_id", F.col("words").alias("r_words"), F.explode(F.filter(sizes, lambda k: k <= F.col("words"))).alias("k"), "text").select("ref_id", "r_words", "k", F.explode(grams(F.col("text"), F.col("k"))).alias("g"))
    if size["chars"] <= REFERENCE_CHARS:
        doc = _shared(docs, [row["text"] for row in r.select("text").collect()], n, size["short"])
    else:
        doc = _sifted(_exploded(docs, n, size["short"]), ref)
    pairs = doc.join(ref, ["k", "g"]).where(F.col("k") == F.least(F.lit(n), F.col("d_words"), F.col("r_words")))
    return pairs.groupBy("doc_id", "ref_id").agg((F.count("*") / F.max("n_grams")).alias("overlap"))


def contaminated(docs: DataFrame, references: DataFrame, threshold: float = 0.3, n: int = 8) -> DataFrame:
    """doc_id, overlap: documents that some reference overlaps by ``threshold`` at least, with the largest overlap."""
    return ngram_overlap(docs, references, n).groupBy("doc_id").agg(F.max("overlap").alias("overlap")).where(F.col("overlap") >= threshold)


def evaluate(conversations: DataFrame, references: DataFrame | None = None, thresholds: EvalThresholds | None = None, n: int = 8, overlap: float = 0.3) -> DataFrame:
    """One row: totals, rates, means, failures (joined by "; ") and whether the gate is passed; no rows fail it."""
    limits = thresholds or EvalThresholds()
    rows = conversations.select("conv_id", heuristic_valid(F.col("turns")).cast("int").alias("valid"), "confidence_score", "judge_overall", F.lit(0).alias("contaminated"))
    if references is not None:
        texts = conversations.select(F.col("conv_id").alias("doc_id"), F.array_join(contents(F.col("turns")), " ").alias("text"))
        hit = contaminated(texts, references, overlap, n).select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("hit"))
        rows = rows.drop("contaminated").join(hit, "conv_id", "left").withColumn("contaminated", F.coalesce("hit", F.lit(0))).drop("hit")
    whole = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("mean_confidence"), F.avg("judge_overall").alias("mean_judge_overall"), F.coalesce(F.sum("contaminated"), F.lit(0)).alias("contaminated"))
    rates = whole.withColumns({"valid_rate": F.coalesce(F.try_divide("valid", "total"), F.lit(0.0)), "contamination_rate": F.coalesce(F.try_divide("contaminated", "total"), F.lit(0.0))})
    percent = lambda name, sign, limit: F.format_string(f"{name} %.1f%% {sign} {limit * 100:.1f}%%", F.col(name) * 100)
    failures = F.array_compact(
        F.array(
            F.when(F.col("total") == 0, "empty dataset"),
            F.when((F.col("total") > 0) & (F.col("valid_rate") < limits.min_valid_rate), percent("valid_rate", "<", limits.min_valid_rate)),
            F.when((F.col("total") > 0) & (F.col("mean_confidence") < limits.min_mean_confidence), F.format_string(f"mean_confidence %.3f < {limits.min_mean_confidence:.3f}", "mean_confidence")),
            F.when(F.col("mean_judge_overall") < limits.min_judge_overall, F.format_string(f"mean_judge_overall %.2f < {limits.min_judge_overall:.2f}", "mean_judge_overall")),
            F.when(F.col("contamination_rate") > limits.max_contamination_rate, percent("contamination_rate", ">", limits.max_contamination_rate)),
        )
    )
    return rates.withColumn("failures", F.array_join(failures, "; ")).withColumn("passed", F.col("failures") == "")
