"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.bpe import encode_documents
from quaestor.llm.exact import EXACT_SQL, exact_groups
from quaestor.llm.hamming import TOP_K_SQL, exact_top_k, sign_code
from quaestor.llm.licenses import license_scan, license_sql
from quaestor.llm.lines import dedup_lines, dedup_lines_sql
from quaestor.llm.mixing import mix, mix_sql
from quaestor.llm.near import near_duplicates
from quaestor.llm.suffix import SUBSTRING_SQL, dedup_substrings
from quaestor.llm.toxicity import THRESHOLD, held_out, score_documents, train

from quaestor.llm.urls import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return filter_urls(_table(spark, sf_dir, "pages"))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every fiftieth embedding, among all."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding"), strict=True).alias("code"))
    return exact_top_k(codes, codes.where(F.col("id") % 50 == 0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines dropped from every document, its source being the site."""
    done = dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of every document."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by source weights takes of every document."""
    return mix(_table(spark, sf_dir, "documents")).drop("epochs", "blocks")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that long strings repeat elsewhere."""
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def rank_file(path: str) -> bytes:
    """A tokenizer's rank file, read on the driver; it goes to the workers as a broadcast."""
    with open(path, "rb") as file:
        return file.read()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    ranks = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the number of offending sentences."""
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_hamming_top_k": op2_hamming_top_k,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_mix_sources": op5_mix_sources,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op2_hamming_top_k": TOP_K_SQL,
    "op3_line_dedup": dedup_lines_sql(),
    "op4_license_scan": license_sql(),
    "op5_mix_sources": mix_sql(),
    "op6_suffix_dedup": SUBSTRING_SQL,
    "op9_exact_dedup": EXACT_SQL,
}
