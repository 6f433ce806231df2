"""Writers of the file formats around a question/answer corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.sources.shared import written


def qa_json(df: DataFrame, path: str, product: str) -> None:
    """Question/answer rows as JSON lines, with uid, product, crawl date and the domain of source_url."""
    site = F.coalesce(F.try_parse_url("source_url", F.lit("AUTHORITY")), F.lit("")) if "source_url" in df.columns else F.lit("")
    df.withColumns({"uid": F.expr("uuid()"), "product": F.lit(product), "source_domain": site, "crawl_date": F.current_timestamp()}).write.mode("append").json(path)


def index(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Documents or postings as Parquet; overwriting is how an index is emptied."""
    df.write.mode("overwrite" if overwrite else "append").parquet(path)


def classification_log(df: DataFrame, path: str) -> None:
    df.select("class", "url").write.mode("append").csv(path)


def predictions(df: DataFrame, path: str) -> None:
    """Ranked uids as CSV in a folder for each model and query."""
    df.select("model", "query_uid", "rank", "uid").write.mode("overwrite").partitionBy("model", "query_uid").option("header", True).csv(path)


def vocabulary(df: DataFrame, path: str) -> None:
    """Words in the order of their ids, one on a line, in one file: a vocabulary is a list of bounded size."""
    df.orderBy("id").select("word").coalesce(1).write.mode("overwrite").text(path)


def examples(df: DataFrame, path: str) -> None:
    """Encoder examples as Parquet."""
    df.write.mode("overwrite").parquet(path)


def frequencies(df: DataFrame, path: str) -> None:
    """Words and frequencies as CSV with a header."""
    df.select("word", "frequency").write.mode("overwrite").option("header", True).csv(path)


def page_test(analysed: DataFrame, labels: DataFrame, path: str) -> None:
    """Three outputs of one analysis: items (JSON: url, posts), classes (CSV: url, predicted), counts (CSV: url, expected, actual).

    analysed: url and the columns of pages.analyse(); labels: url, expected_posts. Only pages that should have posts are counted.
    The analysis is written once and read three times.
    """
    once = written(analysed.select("url", "posts", (F.col("class") == "results").alias("predicted")), "page-test")
    once.select("url", "posts").write.mode("overwrite").json(f"{path}/items")
    once.select("url", F.initcap(F.col("predicted").cast("string")).alias("predicted")).write.mode("overwrite").csv(f"{path}/classes")
    counted = once.join(labels.where("expected_posts > 0"), "url")
    counted.select("url", F.col("expected_posts").alias("expected"), F.size("posts").alias("actual")).write.mode("overwrite").csv(f"{path}/counts")


def fasttext(df: DataFrame, path: str) -> None:
    """Label and text on each line."""
    df.select(F.concat_ws(" ", "label", "text").alias("value")).write.mode("overwrite").text(path)


def rendered(question: str, answer: str):
    """Question and answer as one piece of HTML."""
    return F.concat(F.lit("<h4>"), F.col(question), F.lit("</h4><p>"), F.col(answer), F.lit("</p>"))


def urls_by_class(df: DataFrame) -> DataFrame:
    """All URLs of each class, as a table of rows in order of the class: class, url."""
    return df.select("class", "url").repartitionByRange("class", "url").sortWithinPartitions("class", "url")
