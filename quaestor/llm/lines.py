"""Line dedup by site-relative frequency.

A line is boilerplate of a site if more than max_ratio of the site's pages hold it, and min_pages
at least. Counts come in two passes: first by 64-bit line hash, which can only count too high; then
the few lines whose hash passed are counted by their exact text. A site has fewer than (lines of a
page) / max_ratio such lines on average, so they travel to the pages as one small array for each
site. These tables are measured: while small they are broadcast and no text is shuffled; with very
many sites the join is shuffled, and AQE splits the pages of a hot site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import measured, text_key, written

#: Parameters of the registered query and the pipeline.
MAX_RATIO = 0.05
MIN_PAGES = 3
_BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _own_lines(text: Column) -> Column:
    """Distinct lines of a page, trimmed, without blank ones."""
    return F.array_distinct(F.filter(F.transform(_lines(text), lambda x: _trimmed(x)), lambda x: x != ""))


def with_site(df: DataFrame, by_site: DataFrame, how: str = "left") -> DataFrame:
    """Joins a per-site table; the null site matches itself."""
    right = by_site.withColumnRenamed("site", "_site")
    return df.join(right, F.col("site").eqNullSafe(F.col("_site")), how).drop("_site")


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """Boilerplate lines of each site. pages: site, text. Returns site, boiler (array of lines).

    With copies_once equal texts of a site count as one page, both for a line and for the site.
    """
    if copies_once:
        pages = pages.select("site", "text").distinct()
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = measured(totals, "site_pages")

    def frequent(counts: DataFrame) -> DataFrame:
        common = with_site(counts.where(F.col("n") >= min_pages), totals, "inner")
        return common.where(F.col("n") > F.col("n_pages") * max_ratio)

    hashed = pages.select("site", F.explode(F.transform(_own_lines(F.col("text")), lambda x: F.xxhash64(x))).alias("h"))
    likely = frequent(hashed.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))).groupBy("site").agg(F.collect_set("h").alias("hashes"))
    likely = measured(likely, "likely_lines")
    narrowed = with_site(pages.select("site", "text"), likely, "inner")
    exact = narrowed.select("site", F.explode(F.filter(_own_lines(F.col("text")), lambda x: F.array_contains(F.col("hashes"), F.xxhash64(x)))).alias("line"))
    found = frequent(exact.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))).groupBy("site").agg(F.collect_set("line").alias("boiler"))
    return measured(found, "boilerplate")


def _one_whole(wide: DataFrame) -> DataFrame:
    """One row of each text of a site that would lose all its lines keeps them; the others stay emptied."""
    wide = wide.withColumn("emptied", (F.size(_own_lines(F.col("row.text"))) > 0) & (F.size(F.filter("kept", lambda x: _trimmed(x) != "")) == 0))
    # Written, so that the numbers of the rows stay.
    emptied = written(wide.where("emptied").withColumn("at", F.monotonically_increasing_id()), "emptied")
    first = measured(emptied.groupBy("site", text_key("row.text")).agg(F.min("at").alias("whole")).select("whole"), "whole_rows")
    emptied = emptied.join(first, F.col("at") == F.col("whole"), "left")
    emptied = emptied.withColumn("kept", F.when(F.col("whole").isNotNull(), F.col("lines")).otherwise(F.col("kept")))
    return wide.where(~F.col("emptied")).unionByName(emptied.select(*wide.columns))


def dedup_lines(docs: DataFrame, site_column: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """Removes each site's boilerplate lines.

    Returns the input's columns and rows, with the lines gone from text; the other lines stay as
    they are, in order. Columns _n_lines and _n_dropped are added, in
    place of any of these names. A null text stays null (no
    lines), an empty text has one blank line; blank lines are neither counted nor dropped. A null
    site is a site. Each row counts as a page, repeated rows too, so enough copies of a document make
    its own lines boilerplate. With copies_once equal texts of a site count as one page, and of each
    text that would lose all its lines one row stays whole.
    """
    pages = docs.select(F.col(site_column).alias("site"), "text")
    boiler = boilerplate(pages, max_ratio, min_pages, copies_once)
    columns = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    wide = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("row"), F.col(site_column).alias("site"))
    wide = with_site(wide, boiler)
    lines = _lines(F.col("row.text"))
    wide = wide.withColumn("lines", lines)
    kept = F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("boiler"), _trimmed(x))))
    wide = wide.withColumn("kept", kept)
    if copies_once:
        wide = _one_whole(wide)
    text = F.when(F.col("row.text").isNull() | (F.size("kept") == F.size("lines")), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return wide.select(
        *[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns],
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("_n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("_n_dropped"),
    )


def dedup_lines_sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for the registered query."""
    blank = "' ' || chr(9) || chr(13)"
    return f"""
    with d as (select doc_id, source, text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    n as (select source, count(*) as n_pages from d group by source),
    l as (select source, unnest(list_distinct([trim(x, {blank}) for x in lines if trim(x, {blank}) <> ''])) as line from d),
    f as (select source, line, count(*) as n from l group by source, line having count(*) >= {min_pages}),
    b as (select f.source, list(line) as boiler from f join n on f.source is not distinct from n.source where f.n > n.n_pages * {max_ratio} group by f.source),
    k as (select d.*, [x for x in lines if not list_contains(coalesce(boiler, []), trim(x, {blank}))] as kept
          from d left join b on d.source is not distinct from b.source)
    select doc_id, case when text is null then 0 else len(lines) end as n_lines, len(lines) - len(kept) as n_dropped,
           sha256(array_to_string(kept, chr(10))) as kept_sha256
    from k
    """
