"""Readers of the file formats around a question/answer corpus. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHOR = "struct<author_id:string,author_name:string,author_reputation:int,thread_count:int,reply_count:int,average_reply_length:int,member_since:timestamp,likes_received:int>"
QA = (
    "uid string, product string, source_url string, source_domain string, crawl_date timestamp,"
    f" answer struct<answer_number:int,answer_author:{AUTHOR},answer_date:timestamp,answer_upvotes:int,answer_accepted:boolean,answer_body:string,answer_in_reply_to:int>,"
    f" question struct<question_upvotes:int,question_body:string,question_tags:array<string>,question_view_count:int,question_title:string,question_author:{AUTHOR},"
    "question_date:timestamp,question_extra_info:array<string>,question_original_url:string>, _corrupt string"
)


def qa_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Question/answer pairs as JSON lines; unreadable lines keep their text in _corrupt."""
    df = spark.read.schema(QA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df if limit is None else df.limit(limit)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quoted values may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """Lines of word and frequency, parted by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("frequency"))


def labelled_urls(spark: SparkSession, path: str) -> DataFrame:
    """url and expected_posts without a header; rows with Yes or No for a number are left out."""
    raw = spark.read.schema("url string, expected string").csv(path)
    return raw.where(~F.col("expected").rlike("Yes|No")).select("url", F.col("expected").try_cast("int").alias("expected_posts"))


def predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """A folder of CSV files, one for each query uid, with ranked uids: model, query_uid, rank, uid."""
    rows = spark.read.schema("rank int, uid string").option("header", True).csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return rows.select(F.lit(model).alias("model"), name.alias("query_uid"), "rank", "uid")


def product_names(spark: SparkSession, path: str) -> DataFrame:
    """Product names, one on a line; what follows a tab doesn't count."""
    return spark.read.text(path).select(F.trim(F.substring_index("value", "\t", 1)).alias("name")).where("name <> ''")


def vocabulary(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """Words of a vocabulary file, one on a line: id (line number, from first), word. A file is read whole, as lines of parts have no numbers."""
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    rows = spark.read.text(path, wholetext=True).where("value <> ''").select(F.posexplode(lines).alias("pos", "word"))
    return rows.select((F.col("pos") + first).alias("id"), "word")


def vectors(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """Word vectors as text lines, of the words of a vocabulary: word, vector."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("float")).alias("vector"))
    return rows.join(vocab.select("word"), "word", "left_semi")


def string_list(text):
    """A list written as text, with single or double quotes, as an array."""
    return F.transform(F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>"), lambda x: F.trim(x))


def search_url(keyword: str, pages: int = 10, start: int = 0, base: str = "https://www.google.com/search", language: str | None = None, place: tuple[str, str, str] | None = None) -> str:
    """Address of a page of search results. A language also asks for results that aren't personal; place is (id, key, name in base 64)."""
    from urllib.parse import urlencode

    parts = {"q": keyword, "num": pages, "start": start}
    if language:
        parts |= {"hl": language, "gl": language, "pws": 0, "as_qdr": "all"}
    suffix = f"&tci=g:{place[0]}&uule=w+CAIQICI{place[1]}{place[2]}" if place else ""
    return f"{base}?{urlencode(parts)}{suffix}"


def fetched_results(status, html, mark: str):
    """Whether a fetched page is one of search results: status 200, and a text of such pages in it."""
    return F.coalesce((status == 200) & F.contains(html, F.lit(mark)), F.lit(False))
