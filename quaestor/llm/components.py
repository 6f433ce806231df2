"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """Components of links (a bigint, b bigint): each linked node with its smallest member (node, root).

    Large-star and small-star rounds: each node first hands its larger neighbours, then its smaller
    ones, to the smallest; the table never outgrows the links and ends as stars. Every round is
    written in the shared folder. Self-links and repeated links don't matter.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = written(small.select("x.a", "x.b").where("a <> b").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
