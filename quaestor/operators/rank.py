"""Ranking over postings: TF-IDF, BM25, word and author rank, their combination, top k.

Each ranker takes documents or an Index of them. Given an index it reads the postings of the
question's words and no text; given documents it searches the texts for these words, and nothing else
is ever counted. A question is a short list of words on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import tokens
from quaestor.operators import index as I
from quaestor.operators import models
from quaestor.operators.dataset import MAX_CONTEXT, MAX_UTTERANCE, clamped, shuffled, text_features
from quaestor.operators.index import Index, postings, question_terms

Source = DataFrame | Index


def stemmed_postings(docs: DataFrame) -> DataFrame:
    """Postings by stem: words are chosen as they stand, and those of a stem are counted together."""
    return postings(docs, "stem")


def query_postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the query's words only: texts are searched for them before anything is counted."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return I.postings_of(docs, lambda text: F.filter(tokens(text), lambda w: F.array_contains(wanted, w)))


def _terms(source: Source, question: str) -> list[str]:
    return source.terms(question) if isinstance(source, Index) else question_terms(question)


def _asked(source: Source, terms: list[str]) -> DataFrame:
    return source.asked(terms) if isinstance(source, Index) else query_postings(source, terms)


def _sizes(source: Source) -> DataFrame:
    return source.documents if isinstance(source, Index) else I.sizes_of(source)


def _total(source: Source) -> int:
    return source.total if isinstance(source, Index) else source.count()


def tfidf(source: Source, question: str, title_boost: float = 1.0, body_boost: float = 1.0, document_frequency: bool = False) -> DataFrame:
    """Scores of all documents that hold a word of the question: uid, score.

    In each zone: boost * (part of the question's words found) * sum(freq * idf / sqrt(length)), and
    the zones add up. idf is 1 + ln(N / (df + 1)), with df the number of documents that hold the word, or
    1 by default (the ranking to be matched counts df within each document). The part found is distinct
    words / words of the question, where only the literal analyser counts repeated words.
    """
    terms = _terms(source, question)
    own = _asked(source, terms)
    total = F.lit(float(_total(source)))
    if document_frequency:
        df = own.groupBy("zone", "word").agg(F.count(F.lit(1)).alias("df"))
        own = own.join(F.broadcast(df), ["zone", "word"])  # two rows for each word of the question
    else:
        own = own.withColumn("df", F.lit(1))
    own = own.join(_sizes(source).select("uid", "length"), "uid").where("length > 0")
    each = F.col("freq") * (1 + F.ln(total / (F.col("df") + 1))) / F.sqrt("length")
    boost = F.when(F.col("zone") == "title", F.lit(float(title_boost))).otherwise(F.lit(float(body_boost)))
    zones = own.groupBy("uid", "zone").agg((F.first(boost) * F.count(F.lit(1)) / F.lit(max(len(terms), 1)) * F.sum(each)).alias("s"))
    return zones.groupBy("uid").agg(F.round(F.sum("s"), 6).alias("score"))


def bm25(source: Source, question: str, k1: float = 1.2, b: float = 0.75, products: dict[str, float] | None = None) -> DataFrame:
    """Sum over words of the better zone's BM25: uid, score.

    products adds a boost to the documents that already match and whose column product has that value (documents only).
    """
    own = _asked(source, _terms(source, question))
    sizes = _sizes(source)
    if isinstance(source, Index):
        stats = source.zones
    else:
        means = sizes.agg(F.count(F.lit(1)).alias("total"), *[F.avg(f"{z}_size").alias(z) for z in I.ZONES])
        stats = means.select("total", F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(z).alias("mean")) for z in I.ZONES])).alias("x")).select("x.zone", "total", "x.mean")
    df = own.groupBy("zone", "word").agg(F.count(F.lit(1)).alias("df"))
    wide = own.join(F.broadcast(df), ["zone", "word"]).join(F.broadcast(stats), "zone")  # both tables are as small as the question
    wide = wide.join(sizes.select("uid", "title_size", "body_size"), "uid")
    size = F.when(F.col("zone") == "title", F.col("title_size")).otherwise(F.col("body_size"))
    idf = F.ln(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("freq") * (k1 + 1) / (F.col("freq") + k1 * (1 - b + b * size / F.col("mean")))
    words = wide.groupBy("uid", "word").agg(F.max(idf * part).alias("s"))
    scores = words.groupBy("uid").agg(F.round(F.sum("s"), 6).alias("score"))
    if not products:
        return scores
    extra = reduce(lambda e, p: e.when(F.col("product") == p[0], F.lit(float(p[1]))), products.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return scores.join(source.select("uid", "product"), "uid").select("uid", F.round(F.col("score") + extra, 6).alias("score"))


def word_rank(source: Source, question: str) -> DataFrame:
    """Word rank in closed form: uid, score.

    Every round of the iteration adds the same amount, so its number cancels when scores are divided
    by the largest of all nodes, words or documents.
    """
    edges = _asked(source, _terms(source, question))
    by_doc = edges.groupBy("word", "uid").agg(F.count(F.lit(1)).alias("edges"))
    den = by_doc.groupBy("word").agg(F.max(F.struct("uid", "edges")).alias("m")).select("word", F.col("m.edges").alias("den"))
    same = den.groupBy("den").agg(F.count(F.lit(1)).alias("n"))
    share = den.join(same, "den").select("word", (1.0 / (F.col("n") * F.col("den"))).alias("c"))
    each = edges.join(F.broadcast(share), "word")  # one row for each word of the question
    return _normalised(each.groupBy("uid").agg(F.sum("c").alias("s")), each.groupBy("word").agg(F.sum("c").alias("s")))


def author_rank(source: Source) -> DataFrame:
    """Author rank in closed form: uid, score. A document gets 1 / (authors with as many documents as its own)."""
    known = (source.documents if isinstance(source, Index) else source).where(F.col("author_name").isNotNull()).select("uid", "author_name")
    counts = known.groupBy("author_name").agg(F.count(F.lit(1)).alias("n_docs"))
    same = counts.groupBy("n_docs").agg(F.count(F.lit(1)).alias("n"))
    share = counts.join(same, "n_docs").select("author_name", (1.0 / F.col("n")).alias("c"), "n_docs")
    each = known.join(share, "author_name")
    return _normalised(each.groupBy("uid").agg(F.sum("c").alias("s")), share.select((F.col("c") * F.col("n_docs")).alias("s")))


def _normalised(documents: DataFrame, others: DataFrame) -> DataFrame:
    """Divides document scores by the largest score of any node; 0 where that is 0."""
    most = documents.select("s").unionByName(others.select("s")).agg(F.max("s").alias("most"))
    return documents.crossJoin(F.broadcast(most)).select("uid", F.round(F.coalesce(F.try_divide("s", "most"), F.lit(0.0)), 6).alias("score"))  # one row


def combined_rank(source: Source, question: str, author: float = 1.0, word: float = 1.0) -> DataFrame:
    """author * author rank + word * word rank of documents with a word of the question: uid, score."""
    a = author_rank(source).withColumnRenamed("score", "a")
    w = word_rank(source, question).withColumnRenamed("score", "w")
    return w.join(a, "uid", "left").select("uid", F.round(author * F.coalesce("a", F.lit(0.0)) + word * F.col("w"), 6).alias("score"))


def top_k(scores: DataFrame, k: int, *ties: Column) -> DataFrame:
    """The k best by score, later uid first among equals."""
    return scores.orderBy(F.desc("score"), *(ties or (F.desc("uid"),))).limit(k)


def ranked(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """Adds the 0-based rank within each group and keeps the first k."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("uid"))
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def fan_out(docs: DataFrame, question: str, k: int, source: Source | None = None) -> DataFrame:
    """Answers of three rankers to one question, with their text: model, rank, uid, question_title.

    The rankers read source, an index of docs, if there is one.
    """
    source = docs if source is None else source
    models = {"bm25": bm25(source, question), "tfidf": tfidf(source, question), "graph": combined_rank(source, question)}
    return _listed(models, docs, k)


def _listed(scores: dict[str, DataFrame], docs: DataFrame, k: int) -> DataFrame:
    frames = [top_k(found, k).withColumn("model", F.lit(name)) for name, found in scores.items()]
    lists = ranked(reduce(DataFrame.unionByName, frames), ["model"], k)
    wanted = F.broadcast(lists)  # k rows for each ranker
    return docs.select("uid", "question_title").join(wanted, "uid").select("model", "rank", "uid", "score", "question_title")


def scored_texts(found: DataFrame, question: str, vocab: DataFrame, weights: models.EncoderWeights) -> DataFrame:
    """Encoder scores of texts (uid, question_body) as answers to a question: uid, score. The question is the context."""
    asked = found.sparkSession.createDataFrame([("question", question)], "uid string, question_body string")
    context = text_features(asked, vocab).select(F.col("ids").alias("context"), clamped(F.col("n_words"), MAX_CONTEXT).alias("context_len"))
    utterance = text_features(found, vocab).select("uid", F.col("ids").alias("utterance"), clamped(F.col("n_words"), MAX_UTTERANCE).alias("utterance_len"))
    scored = models.pair_scores(utterance.crossJoin(F.broadcast(context)), weights)  # one question
    return scored.select("uid", F.round("probability", 6).alias("score"))


def rerank(candidates: DataFrame, docs: DataFrame, question: str, vocab: DataFrame, weights: models.EncoderWeights) -> DataFrame:
    """Encoder scores of retrieved candidates (uid): uid, score. Only their texts are read on; there are as many as the first stage was asked for."""
    found = docs.join(F.broadcast(candidates.select("uid")), "uid").select("uid", "question_body")
    return scored_texts(found, question, vocab, weights)


def retrieve_rerank(source: Source, docs: DataFrame, question: str, vocab: DataFrame, weights: models.EncoderWeights, n: int, k: int) -> DataFrame:
    """The n best by BM25, ordered anew by the encoder; the k best of them: uid, score."""
    return top_k(rerank(top_k(bm25(source, question), n), docs, question, vocab, weights), k)


def neural_fan_out(source: Source, docs: DataFrame, question: str, vocab: DataFrame, weights: models.EncoderWeights, n: int, k: int) -> DataFrame:
    """Answers of the graph, of the encoder's new order of the search results, and of the search: model, rank, uid, score, question_title."""
    lists = {"graph": combined_rank(source, question), "neural": retrieve_rerank(source, docs, question, vocab, weights, n, k), "search": bm25(source, question)}
    return _listed(lists, docs, k)


def answer(source: Source, docs: DataFrame, question: str, k: int = 10) -> DataFrame:
    """Answers to a free-text question by TF-IDF, best first: uid, score, question_title, question_body."""
    best = F.broadcast(top_k(tfidf(source, question), k))  # k rows
    return docs.select("uid", "question_title", "question_body").join(best, "uid").select("uid", "score", "question_title", "question_body").orderBy(F.desc("score"), F.desc("uid"))


def suggestions(docs: DataFrame, k: int, seed: int = 8) -> DataFrame:
    """k titles to suggest as questions, drawn by hash: uid, question_title. Empty titles are left out."""
    titled = docs.where("question_title <> ''").select("uid", "question_title")
    return shuffled(titled, seed).limit(k)


def keyword_rank(docs: DataFrame, keywords: str, field: str, source: Source | None = None) -> DataFrame:
    """BM25 score multiplied by a numeric field of docs: uid, score."""
    scores = bm25(docs if source is None else source, keywords)
    return scores.join(docs.select("uid", F.col(field).alias("_f")), "uid").select("uid", F.round(F.col("score") * F.col("_f"), 6).alias("score"))
