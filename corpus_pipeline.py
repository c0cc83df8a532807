"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and
works on all rows its predecessor kept; ``run`` writes what a stage returns as Parquet
in the shared folder and reads it again for the next one.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near copies stays.
3. decontamination: documents contaminated by benchmark passages go.
4. secrets: found secrets are masked in the text; no document goes.
5. packing: what is left is packed into sequences of 1024 tokens.

Rows with a null doc_id or text pass like others; a null text counts as empty.  Very long
texts are read whole by every stage.  Of repeated rows near_duplicates keeps one, but for a
null doc_id.  An empty table gives no sequences.  Further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, packing, quality_classifier, secret_scan, simhash_dedup
from corpusmill.llm.common import cut, drop_cut, spent_tables, spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_quality(docs, quality_classifier.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("packing", pack),
]

#: A trained classifier, fingerprints and token ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last one.

    Tables that a stage made for itself, and what it read, are deleted once its rows are written.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for name, stage in STAGES:
        with spent_tables(spark):
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            drop_cut(before)
        before = docs
    return docs
