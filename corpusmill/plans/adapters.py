"""The driver's tables in the shapes that operators take, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.conversations import assemble
from corpusmill.operators.shared import bounded, importable, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; small ones of texts are dealt over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def written(rows: DataFrame, name: str, make: Callable[..., bytes]) -> DataFrame:
    """A file (file_path, file_name, content) for each row, of that name, made of the row's values; the first is its path."""
    importable(rows.sparkSession)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in bounded(batches):
            made = [make(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(made), pa.string()), pa.array(made, pa.binary())], names=["file_path", "file_name", "content"])

    return rows.mapInArrow(run, "file_path string, file_name string, content binary")


def _scored(conv: DataFrame) -> DataFrame:
    return conv.withColumns(
        {
            "source_chunk_id": F.expr("conv_id div 2"),
            "reasoning_trace": F.lit(None).cast("string"),
            "judge_overall": F.when(F.col("conv_id") % 5 != 0, (F.col("conv_id") * 53 % 101) / F.lit(10.0)),
            "confidence_score": F.when(F.col("conv_id") % 7 != 0, (F.col("conv_id") * 37 % 101) / F.lit(100.0)),
        }
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, with scores made from the id."""
    return _scored(assemble(table(spark, sf_dir, "conversations")))


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and, for every fourth id, a copy under another one."""
    conv = conversations(spark, sf_dir)
    return conv.unionByName(conv.where("conv_id % 4 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with filler openings in every third turn and some very short turns."""
    rows = table(spark, sf_dir, "conversations")
    text = F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), "ok").when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure! "), F.col("text"))).otherwise(F.col("text"))
    return _scored(assemble(rows.withColumn("text", text)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files: the first line is a title, every fifth after it a header."""
    marked = F.transform(F.split("content", "\n"), lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return files(spark, sf_dir).select("doc_id", F.regexp_replace("file_path", "txt$", "md").alias("file_path"), F.array_join(marked, "\n").alias("content"), F.lit("markdown").alias("source_type"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python files of two definitions that hold the whole text, each on one line."""
    body = F.replace(F.col("content"), F.lit("\n"), F.lit(" "))
    name = F.col("doc_id").cast("string")
    content = F.concat(F.lit("def f_"), name, F.lit("(x):\n    '''"), body, F.lit("'''\n\nclass C_"), name, F.lit(":\n    y = '''"), body, F.lit("'''\n"))
    return files(spark, sf_dir).select("doc_id", F.regexp_replace("file_path", "txt$", "py").alias("file_path"), content.alias("content"), F.lit("code").alias("source_type"), F.lit("python").alias("language"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as Markdown files that hold a table, some with a second row, and a line after it."""
    key, more = F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "\n|  | x |  |").otherwise("")
    rest = F.when(F.col("p_partkey") % 3 == 0, "\n\nno | table").otherwise("\nend")
    content = F.concat(F.lit("part "), "p_name", F.lit("\n| key | a |\n|:---|---:|\n| "), key, F.lit(" | "), "p_brand", F.lit(" |"), more, rest)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), key, F.lit(".md")).alias("file_path"), content.alias("content"), F.lit("").alias("chunk_id"))


# The same in DuckDB, each as a common table expression.
_SCORES = """conv_id // 2 AS source_chunk_id, CAST(NULL AS VARCHAR) AS reasoning_trace,
  CASE WHEN conv_id % 5 <> 0 THEN (conv_id * 53 % 101) / 10.0::DOUBLE END AS judge_overall,
  CASE WHEN conv_id % 7 <> 0 THEN (conv_id * 37 % 101) / 100.0::DOUBLE END AS confidence_score"""
_TURNS = "list({'role': role, 'content': text} ORDER BY turn) AS turns"
CONV = f"conv AS (SELECT conv_id, {_TURNS}, {_SCORES} FROM conversations GROUP BY conv_id)"
DUPLICATED = f"""base AS (SELECT conv_id, {_TURNS}, {_SCORES} FROM conversations GROUP BY conv_id),
conv AS (SELECT * FROM base UNION ALL SELECT conv_id + 1000000, * EXCLUDE (conv_id) FROM base WHERE conv_id % 4 = 0)"""
FILLED = f"""changed AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN 'ok' WHEN turn % 3 = 1 THEN 'Sure! ' || text ELSE text END AS text FROM conversations),
conv AS (SELECT conv_id, {_TURNS}, {_SCORES} FROM changed GROUP BY conv_id)"""
FILES = "files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS file_path, text AS content FROM documents)"
HEADED = """headed AS (SELECT doc_id, source || '/' || doc_id || '.md' AS file_path, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: CASE WHEN i = 1 THEN '# ' || x WHEN (i - 1) % 5 = 0 THEN '## ' || x ELSE x END), chr(10)) AS content FROM documents)"""
CODE = """code AS (SELECT doc_id, source || '/' || doc_id || '.py' AS file_path,
  'def f_' || doc_id || '(x):' || chr(10) || '    ''''''' || replace(text, chr(10), ' ') || '''''''' || chr(10) || chr(10) || 'class C_' || doc_id || ':' || chr(10) || '    y = ''''''' || replace(text, chr(10), ' ') || '''''''' || chr(10) AS content FROM documents)"""
