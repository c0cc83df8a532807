"""The engine's jobs: ingest, synthesize, export, validate and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.pii import PiiOptions
from corpusmill.operators import chunks as C
from corpusmill.operators import conversations as V
from corpusmill.operators import evaluation, formats, splits, synthesis, vectors
from corpusmill.operators.generation import Generator, Limits
from corpusmill.operators.shared import cut
from corpusmill.schema import EvalThresholds, IngestConfig, SplitConfig
from corpusmill.sources.documents import read_folder


def ingest(spark: SparkSession, folder: str, config: IngestConfig | None = None, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, failed files) of a folder: load, chunk, then tables, prefix, embeddings, redaction in that order."""
    config = config or IngestConfig()
    files = read_folder(spark, folder, recursive, structured=config.structured)
    made = C.chunk(files.where("error is null"), config.chunk)
    made = C.serialize_tables(made, config.tables)
    if config.context_prefix:
        made = C.contextual_prefix(made)
    if config.pii:
        # Redaction changes the text, so embeddings of the text before would leak it.
        made = C.redact_chunks(made, PiiOptions(redact=config.redact))
    if config.embed:
        made = made.join(vectors.hash_embed(made, "chunk_id", "content").dropDuplicates(["chunk_id"]), "chunk_id", "left")
    return made, files.where("error is not null").select("file_path", "error")


def synthesize(chunks: DataFrame, mode: str = "teach", generator: Generator | None = None, cache: DataFrame | None = None, limits: Limits | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pruned conversations, new cache entries); ``limits`` and ``log`` as in ``generation``."""
    made, entries = synthesis.synthesize(chunks, mode, generator=generator, cache=cache, limits=limits, log=log)
    return V.prune(made), entries


def synthesize_chain(
    chunks: DataFrame, mode: str | None = None, generator: Generator | None = None, scaffolded: bool = False, judged: bool = False, limits: Limits | None = None, log: str | None = None
) -> DataFrame:
    """Conversations of chunks (chunk_id, content, title, source_type): built by ``mode`` or, without one, by questions;
    answers set out in steps; what comes to nothing as two turns on the content; pruned; rated.

    Each step that calls the generator is written before the next one reads it.  All keep to
    ``limits``, the provider's own where none are given; ``log`` lets a chain by ``mode`` be taken up again.
    """
    if mode is not None:
        made, _ = synthesis.synthesize(chunks, mode, generator=generator, limits=limits, log=log)
    else:
        asked = synthesis.socratic(chunks, generator, limits)
        plain = synthesis.conversation_turns(F.lit(None).cast("string"), F.col("content"))
        made = chunks.join(asked, "chunk_id").select(
            F.sha2(F.concat_ws("|", "chunk_id", F.lit("socratic")), 256).alias("conv_id"),
            F.col("chunk_id").alias("source_chunk_id"),
            F.coalesce("turns", plain).alias("turns"),
            "reasoning_trace",
            F.lit(None).cast("double").alias("confidence_score"),
            F.lit(None).cast("double").alias("judge_overall"),
        )
    if scaffolded:
        made = cut(synthesis.scaffold(made, generator, limits), "scaffold")
    made = V.prune(made)
    if not judged:
        return made
    sources = made.join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), "content"), "source_chunk_id")
    rated = cut(synthesis.judge(sources, F.col("content"), generator or synthesis.OfflineGenerator(), limits=limits), "judged")
    return made.drop("judge_overall", "confidence_score").join(rated, "conv_id", "left")


def export(conversations: DataFrame, layouts: list[str], folder: str, split: SplitConfig | None = None, order: str = "conv_id") -> DataFrame:
    """Deduplicate, split, write each layout; returns the validation report of what came in.

    With a split every part is written to its own folder.
    """
    conversations = cut(conversations, "export")  # every layout and split starts from it
    kept = cut(V.deduplicate(conversations, order), "export-kept")
    parts = {"": kept}
    if split is not None:
        named = splits.random_split(kept, order, split)
        parts = {f"/{name}": named.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
    for name, rows in parts.items():
        for layout in layouts:
            out = formats.FORMATS[layout](rows).write.mode("overwrite")
            (out.parquet if layout == "parquet" else out.json)(f"{folder}/{layout}{name}")
    return V.report(conversations)


def validate_export(spark: SparkSession, folder: str, layouts: list[str]) -> dict[str, bool]:
    """Whether each layout's files hold rows and none of them is invalid."""
    out = {}
    for layout in layouts:
        rows = (spark.read.parquet if layout == "parquet" else spark.read.json)(f"{folder}/{layout}")
        result = formats.format_valid(rows, layout).first()
        out[layout] = bool(result["rows"] and result["valid"])
    return out


def export_stats(spark: SparkSession, folder: str) -> DataFrame:
    """layout, files, bytes of what an export wrote; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    part = F.regexp_extract("path", f"/{folder.rstrip('/').rpartition('/')[2]}/([^/]+)/", 1)
    return files.where(F.regexp_like("path", F.lit("/part-[^/]*$"))).groupBy(part.alias("layout")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def evaluate(conversations: DataFrame, references: DataFrame | None = None, thresholds: EvalThresholds | None = None) -> DataFrame:
    return evaluation.evaluate(conversations, references, thresholds)


_SIZES = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"))


def dataset_card(conversations: DataFrame, name: str, layouts: list[str]) -> str:
    """A card with the statistics of the exported set, in Markdown with a metadata head."""
    stats = V.statistics(conversations).first().asDict()
    bucket = next((label for limit, label in _SIZES if stats["conversations"] < limit), "n>1M")
    lines = ["---", f"pretty_name: {name}", "size_categories:", f"- {bucket}", "task_categories:", "- text-generation", "---", "", f"# {name}", "", "| statistic | value |", "|-|-|"]
    lines += [f"| {k} | {v} |" for k, v in stats.items()]
    return "\n".join([*lines, "", f"Layouts: {', '.join(layouts)}", ""])
