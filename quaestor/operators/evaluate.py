"""Retrieval evaluation: duplicate closure, first-match ranks, recall and precision, confusion, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.sources.shared import written


def duplicate_closure(links: DataFrame) -> DataFrame:
    """Symmetric transitive closure of a duplicate relation (a, b): each uid with its class, the smallest uid.

    Nodes take the smallest label around them, then that label's label; labels reach across a class in
    a number of rounds that grows with the logarithm of its width.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "closure")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "uid"), "closure")
    while True:
        near = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["uid"] == near["a"]).select("uid", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("uid").alias("label"), F.col("label").alias("further"))
        after = written(lower.join(jump, "label", "left").select("uid", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "closure")
        if after.where("label <> old").isEmpty():
            return after.select("uid", F.col("label").alias("class_uid"))
        labels = after.select("uid", "label")


def first_match(queries: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """0-based rank of each wanted uid in each model's list: k + 1 beyond k, k + 2 if absent.

    queries: query_uid, uid (wanted); predictions: model, query_uid, rank, uid.
    """
    models = predictions.select("model").distinct()
    wanted = queries.crossJoin(F.broadcast(models))  # a row for each ranker
    found = wanted.join(predictions.groupBy("model", "query_uid", "uid").agg(F.min("rank").alias("rank")), ["model", "query_uid", "uid"], "left")
    return found.withColumn("rank", F.when(F.col("rank").isNull(), k + 2).when(F.col("rank") > k, k + 1).otherwise(F.col("rank")))


def closure_best_ranks(predictions: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Best rank of any other member of a question's class of duplicates: model, query_uid, best_rank.

    predictions: model, query_uid, rank, uid; classes: uid, class_uid as duplicate_closure() gives them. Beyond k the rank is
    k + 1, and k + 2 where no member is listed. Questions without duplicates, and models without a list for a question, have
    no row. Members are recognised by their class, so a class is never paired out.
    """
    of = lambda uid, name: classes.select(F.col("uid").alias(uid), F.col("class_uid").alias(name))
    listed = predictions.join(of("query_uid", "_own"), "query_uid").join(of("uid", "_found"), "uid", "left")
    hit = (F.col("_own") == F.col("_found")) & (F.col("uid") != F.col("query_uid"))
    best = listed.groupBy("model", "query_uid").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))
    return best.select("model", "query_uid", F.when(F.col("rank").isNull(), k + 2).when(F.col("rank") > k, k + 1).otherwise(F.col("rank")).alias("best_rank"))


def original_links(rows: DataFrame) -> DataFrame:
    """Each duplicate question with the question that it points at: uid, original_uid (null if that one isn't there).

    rows: uid, source_url, question_original_url (null where a question is no duplicate). Of rows with one URL the smallest uid counts.
    """
    known = rows.groupBy(F.col("source_url").alias("question_original_url")).agg(F.min("uid").alias("original_uid"))
    return rows.where(F.col("question_original_url").isNotNull()).join(known, "question_original_url", "left").select("uid", "original_uid")


def labelled_predictions(labels: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    """Labels beside predictions of the same key; where either side lacks one, its columns are null."""
    return labels.join(predictions, on, "full")


def best_ranks(matches: DataFrame) -> DataFrame:
    """Best rank over all wanted uids: model, query_uid, best_rank."""
    return matches.groupBy("model", "query_uid").agg(F.min("rank").alias("best_rank"))


def rank_statistics(best: DataFrame, k: int) -> DataFrame:
    """Of each model: queries, misses (rank beyond k) and their share, mean and mean square of the other ranks (-1 and null if all miss)."""
    hit = F.col("best_rank") <= k
    return best.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(~hit).alias("n_misses"),
        F.round(F.avg(F.when(hit, 0.0).otherwise(1.0)), 6).alias("miss_share"),
        F.round(F.coalesce(F.avg(F.when(hit, F.col("best_rank"))), F.lit(-1.0)), 6).alias("mean_rank"),
        F.round(F.avg(F.when(hit, F.col("best_rank") * F.col("best_rank"))), 6).alias("second_order"),
    )


def precision_recall(queries: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """Of each model and query: hits among the first k, divided by k's list (precision) and by what is wanted (recall)."""
    first = predictions.where(F.col("rank") < k)
    size = first.groupBy("model", "query_uid").agg(F.count(F.lit(1)).alias("n_listed"))
    hits = first.join(queries, ["query_uid", "uid"], "left_semi").groupBy("model", "query_uid").agg(F.count(F.lit(1)).alias("n_hits"))
    wanted = queries.groupBy("query_uid").agg(F.count_distinct("uid").alias("n_wanted"))
    wide = size.join(wanted, "query_uid").join(hits, ["model", "query_uid"], "left")
    n = F.coalesce("n_hits", F.lit(0))
    return wide.select("model", "query_uid", n.alias("n_hits"), F.round(n / F.col("n_listed"), 6).alias("precision"), F.round(n / F.col("n_wanted"), 6).alias("recall"))


def recall_at(ranks: DataFrame, *cuts: int) -> DataFrame:
    """Share of queries whose true answer ranks among the first k, for each k. ranks: rank (from 0)."""
    return ranks.agg(*[F.round(F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in cuts])


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """True and false positives and negatives, with recall, precision and accuracy (null where undefined)."""
    counts = rows.agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn")
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return counts.withColumns(
        {
            "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
            "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
            "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
        }
    )


def parse_completeness(rows: DataFrame) -> DataFrame:
    """rows: expected, actual. Share of pages with exactly the expected posts, and of all posts found."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.round(F.avg(F.when(F.col("actual") == F.col("expected"), 1.0).otherwise(0.0)), 6).alias("exact_share"),
        F.round(F.try_divide(F.sum("actual"), F.sum("expected")), 6).alias("posts_share"),
    )


def coefficient_grid(components: DataFrame, grid: DataFrame) -> DataFrame:
    """Sum of the combined score of wanted documents for each pair of coefficients, best first.

    components: a, w of wanted documents; grid: coeff_author, coeff_word, a few rows.
    """
    wide = components.crossJoin(F.broadcast(grid))
    return wide.groupBy("coeff_author", "coeff_word").agg(F.round(F.sum(F.col("coeff_author") * F.col("a") + F.col("coeff_word") * F.col("w")), 6).alias("total"))
