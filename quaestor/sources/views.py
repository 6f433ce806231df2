"""Views that bind the question/answer model to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions: uid, question_title (first line), question_body, author_name, question_view_count, lang."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("uid"),
        F.substring_index("text", "\n", 1).alias("question_title"),
        F.col("text").alias("question_body"),
        F.col("source").alias("author_name"),
        F.col("n_chars").alias("question_view_count"),
        "lang",
    )


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers marked as accepted: uid, answer_accepted."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), (F.col("quality") == 1).alias("answer_accepted"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as forum threads: conv_id, post_number, author, body."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("post_number"), F.col("role").alias("author"), F.col("text").alias("body"))


def qa_pairs(thread: DataFrame) -> DataFrame:
    """Each user post with the assistant post right after it: conv_id, question_number, question_body, answer_body."""
    order = Window.partitionBy("conv_id").orderBy("post_number")
    ahead = thread.withColumns({"next_author": F.lead("author").over(order), "answer_body": F.lead("body").over(order)})
    pairs = ahead.where((F.col("author") == "user") & (F.col("next_author") == "assistant"))
    return pairs.select("conv_id", F.col("post_number").alias("question_number"), F.col("body").alias("question_body"), "answer_body")


#: Names that the conversations of questions() are about, in turn.
PRODUCTS = ("outlook", "word", "ipad")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one answer each: uid, question_title (first line), question_body, answer_body, product, question_view_count (characters of the answer)."""
    pairs = qa_pairs(posts(spark, sf_dir))
    name = F.element_at(F.array(*[F.lit(p) for p in PRODUCTS]), (F.pmod("conv_id", F.lit(len(PRODUCTS))) + 1).cast("int"))
    return pairs.select(
        F.concat_ws("_", "conv_id", "question_number").alias("uid"), F.substring_index("question_body", "\n", 1).alias("question_title"), "question_body", "answer_body",
        name.alias("product"), F.length("answer_body").alias("question_view_count"),
    )


def equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents of equal text (a, b): each one and the first of its text. Texts are known by their digests."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = own.groupBy("sha").agg(F.min("doc_id").alias("b"))
    return own.join(first, "sha").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Registers the tables and the views docs, accepted and posts for spark.sql()."""
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for view in (docs, accepted, posts):
        view(spark, sf_dir).createOrReplaceTempView(view.__name__)
