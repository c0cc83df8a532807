"""Command line: ingest, synthesize, export, validate, evaluate, jobs.

    python -m corpusmill ingest FOLDER OUT [--size N --overlap N --prefix --embed --pii --structured]
    python -m corpusmill synthesize CHUNKS OUT [--mode MODE] [--provider NAME --model NAME --settings FILE] [--scaffold --judge --concurrency N --rpm N --log FOLDER]
    python -m corpusmill export CONVERSATIONS OUT --formats sharegpt,dpo [--split]
    python -m corpusmill validate CONVERSATIONS
    python -m corpusmill evaluate CONVERSATIONS [--references FOLDER]
    python -m corpusmill jobs FOLDER

Tables are folders of Parquet files.  validate and evaluate exit with 1 where they fail.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import conversations, formats
from corpusmill.operators.clients import Providers
from corpusmill.operators.generation import limits_of
from corpusmill.operators.jobs import JobLog
from corpusmill.operators.state import list_jobs
from corpusmill.operators.synthesis import MODES, get_generator
from corpusmill.plans import jobs
from corpusmill.schema import ChunkConfig, IngestConfig, SplitConfig


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("folder")
    ingest.add_argument("out")
    ingest.add_argument("--size", type=int, default=1000)
    ingest.add_argument("--overlap", type=int, default=200)
    ingest.add_argument("--chunker", default="auto")
    for flag in ("prefix", "embed", "pii", "structured"):
        ingest.add_argument(f"--{flag}", action="store_true")
    synthesize = commands.add_parser("synthesize")
    synthesize.add_argument("chunks")
    synthesize.add_argument("out")
    synthesize.add_argument("--mode", choices=sorted(MODES), default="teach")
    synthesize.add_argument("--provider", default="offline")
    synthesize.add_argument("--model")
    synthesize.add_argument("--settings", help="TOML or JSON file with custom providers")
    synthesize.add_argument("--scaffold", action="store_true")
    synthesize.add_argument("--judge", action="store_true")
    synthesize.add_argument("--concurrency", type=int, help="calls in flight over all tasks; else the provider's limit")
    synthesize.add_argument("--rpm", type=float, help="calls a minute over all tasks; else the provider's limit")
    synthesize.add_argument("--log", help="folder of finished calls, to take a job up again")
    export = commands.add_parser("export")
    export.add_argument("conversations")
    export.add_argument("out")
    export.add_argument("--formats", default="sharegpt")
    export.add_argument("--split", action="store_true")
    validate = commands.add_parser("validate")
    validate.add_argument("conversations")
    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("conversations")
    evaluate.add_argument("--references")
    listing = commands.add_parser("jobs")
    listing.add_argument("folder")
    listing.add_argument("--status")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("corpusmill").getOrCreate()
    if a.command == "ingest":
        chunks, failed = jobs.ingest(spark, a.folder, IngestConfig(ChunkConfig(a.size, a.overlap, a.chunker), context_prefix=a.prefix, embed=a.embed, pii=a.pii, structured=a.structured))
        chunks.write.mode("overwrite").parquet(a.out)
        failed.show(truncate=False)
    elif a.command == "synthesize":
        chunks, providers = spark.read.parquet(a.chunks), Providers()
        if a.settings:
            providers.load(a.settings)
        generator = get_generator(a.provider, providers, **({"model": a.model} if a.model else {}))
        chunks = chunks if "source_type" in chunks.columns else chunks.withColumn("source_type", F.lit("text"))
        own = limits_of(generator, None)
        limits = replace(own, concurrency=a.concurrency or own.concurrency, rpm=a.rpm or own.rpm)
        made = jobs.synthesize_chain(chunks, a.mode, generator, a.scaffold, a.judge, limits, a.log)
        made.write.mode("overwrite").parquet(a.out)
    elif a.command == "export":
        layouts = a.formats.split(",")
        if unknown := set(layouts) - set(formats.FORMATS):
            raise SystemExit(f"unknown formats: {', '.join(sorted(unknown))}")
        jobs.export(spark.read.parquet(a.conversations), layouts, a.out, SplitConfig() if a.split else None).show()
    elif a.command == "validate":
        report = conversations.report(spark.read.parquet(a.conversations))
        report.show()
        return 0 if report.first()["is_valid"] else 1
    elif a.command == "evaluate":
        references = spark.read.parquet(a.references) if a.references else None
        report = jobs.evaluate(spark.read.parquet(a.conversations), references)
        report.show(truncate=False)
        return 0 if report.first()["passed"] else 1
    else:
        list_jobs(JobLog(spark, a.folder).jobs(), status=a.status).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
