"""Training-corpus pipeline: five stages, each over all rows that the one before kept.

run() writes every stage's result in the shared folder and reads it again. Stages that change a text
also set n_chars. The last returns the token ids of each row with the digests of its encoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.bpe import encode_documents
from quaestor.llm.common import written
from quaestor.llm.lines import dedup_lines
from quaestor.llm.mixing import mixed_documents
from quaestor.llm.near import without_near_duplicates
from quaestor.llm.queries import rank_file
from quaestor.llm.toxicity import clean_documents, train


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars being the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labels, doesn't reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return clean_documents(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without their source's boilerplate lines."""
    return _counted(dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole copy that is taken, and one with the further blocks taken of a document."""
    return _counted(mixed_documents(docs), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens."""
    ranks = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, ids=True, keep=("lang", "source"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the model, the sketches and the encoder; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
