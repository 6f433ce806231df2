"""Pages of the fixture folder, with what must be found in them written by hand."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quaestor.functions import urls as U
from quaestor.functions.dates import find_dates
from quaestor.operators import pages as P
from quaestor.sources import readers, sinks

FOLDER = Path(__file__).parent / "fixtures/pages"
URLS = {
    "superuser": "https://superuser.com/questions/7/mail",
    "macrumors": "http://forums.macrumors.com/threads/1",
    "forum": "http://forum.example.com/t/1",
    "index": "http://forums.macrumors.com/forums/9",
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, url, (FOLDER / f"{name}.html").read_text()) for k, (name, url) in enumerate(URLS.items())]
    return spark.createDataFrame([*rows, (9, None, None), (10, "https://superuser.com/questions/8", "")], "page_id long, url string, html string")


def test_superuser_thread(frame):
    rows = P.site_answers(frame).where("domain = 'superuser.com'").orderBy("answer_number").collect()
    assert [(r.answer_number, r.answer_body, r.answer_upvotes) for r in rows] == [(0, "Start it in safe mode.", 4), (1, "Try again.", None)]
    q = rows[0]
    assert (q.question_title, q.question_body, q.question_tags, q.question_upvotes, q.question_view_count) == ("Mail won't open", "It stops\nat the start.", ["mail", "outlook"], 12, 340)
    assert (q.author_id, q.question_date, q.question_original_url) == ("superuser.com_ann", dt.datetime(2013, 2, 19, 9, 10), "https://superuser.com/questions/3/mail")


def test_macrumors_thread(frame):
    rows = P.site_answers(frame, product="IPAD").where("domain = 'macrumors.com'").orderBy("answer_number").collect()
    assert [(r.answer_number, r.question_body, r.answer_body) for r in rows] == [(0, "My screenis dark.", "Is it on?"), (1, "My screenis dark.", "Yesit is.")]
    assert (rows[0].question_title, rows[0].question_tags, rows[0].author_id, rows[0].question_date) == (None, ["ipad"], "macrumors.com_bob", dt.datetime(2013, 2, 9))
    assert {r.domain for r in P.site_answers(frame, product="watch").collect()} == {"superuser.com"}


def test_forum_and_index_pages(frame):
    got = {r.page_id: r for r in P.analyse(frame).collect()}
    assert {k: got[k]["class"] for k in (2, 3, 9, 10)} == {2: "results", 3: "index", 9: "other", 10: "other"}
    assert [(p.author, p.author_link, p.date) for p in got[2].posts] == [("ann", "/u/ann", dt.datetime(2015, 5, 1)), ("bob", "/u/bob", dt.datetime(2015, 5, 2, 10, 30))]
    assert [p.body.split()[0] for p in got[2].posts] == ["My", "Printers"]
    assert got[3].result_links == ["/how-to-1", *[f"/t/{k}" for k in range(2, 10)], "//forums.macrumors.com/t/10"] and len(got[3].pagination_links) == 2


def test_routes(frame):
    got = {r.page_id: r.c for r in frame.select("page_id", P.site_route(F.col("url")).alias("c")).collect()}
    assert got == {0: "results", 1: "results", 2: "other", 3: "index", 9: "other", 10: "results"}


def test_frontier(spark, frame):
    analysed, seen = P.analyse(frame), spark.createDataFrame([("http://forums.macrumors.com/t/2",), ("http://forums.macrumors.com?page=2",)], "url string")
    links = sorted(r.link for r in P.frontier(analysed, frame, seen).collect())
    assert len(links) == 10 and "http://forums.macrumors.com/t/10" in links and "http://forums.macrumors.com/t/2" not in links
    assert [r.link for r in P.frontier(analysed, frame, seen, 3).collect()] == links[:3]


def test_guided_links(frame):
    got = {r.link for r in P.guided_links(frame, P.GUIDES["macrumors"]).where("page_id = 3").collect()}
    assert got == {"http://forums.macrumors.com/threads/1", "http://forums.macrumors.com/threads/3#last", "http://forums.macrumors.com?page=2", "http://forums.macrumors.com/threads/9"}
    assert not P.guided_links(frame, P.GUIDES["eset"]).where("page_id = 3").collect()


@pytest.mark.parametrize(
    "link,want",
    [
        ("a/b", "http://h:8/a/b"), ("/a", "http://h:8/a"), ("../../a", "http://h:8/a"), ("./a", "http://h:8/a"), ("//x/y", "http://x/y"), ("?q=1", "http://h:8?q=1"), ("#t", "http://h:8#t"),
        ("", "http://h:8"), ("mailto:a@b", "mailto:a@b"), ("https://z/1", "https://z/1"),
    ],
)
def test_absolute_links(spark, link, want):
    rows = spark.createDataFrame([(link, "http://h:8/deep/page?x"), (link, "nothing")], "l string, p string").select(U.absolute(F.col("l"), F.col("p")).alias("a")).collect()
    assert [r.a for r in rows] == [want, link]


@pytest.mark.parametrize(
    "text,want",
    [
        ("5 May 2013 10:30 but nothing", dt.datetime(2013, 5, 5, 10, 30)), ("posted 10:30 want to 5 May 2013", dt.datetime(2013, 5, 5)), ("5 May 2013 10:30 MSK", dt.datetime(2013, 5, 5, 7, 30)),
        ("5 May 2013 10:30 pacific", dt.datetime(2013, 5, 5, 17, 30)), ("10:30 a.m. UTC 5 May 2013", dt.datetime(2013, 5, 5, 10, 30)),
    ],
)
def test_zones(text, want):
    assert [m for m, *_ in find_dates(text)] == [want]


def test_outputs(spark, frame, tmp_path):
    labels = spark.createDataFrame([(URLS["forum"], 2), (URLS["index"], 0)], "url string, expected_posts int")
    analysed = P.analyse(frame).join(frame.select("page_id", "url"), "page_id")
    sinks.page_test(analysed, labels, str(tmp_path / "t"))
    read = lambda name, schema: sorted(map(tuple, spark.read.schema(schema).csv(str(tmp_path / "t" / name)).collect()), key=str)
    assert read("counts", "url string, e int, a int") == [(URLS["forum"], 2, 2)]
    assert (URLS["forum"], "True") in read("classes", "url string, p string") and spark.read.json(str(tmp_path / "t/items")).count() == 6
    sinks.qa_json(spark.createDataFrame([("http://h:1/x",)], "source_url string"), str(tmp_path / "qa"), "p")
    row = spark.read.json(str(tmp_path / "qa")).first()
    assert (row.source_domain, row["product"]) == ("h:1", "p")
    (tmp_path / "v.txt").write_text("a\nb\n\nc\n")
    assert [tuple(r) for r in readers.vocabulary(spark, str(tmp_path / "v.txt"), 1).collect()] == [(1, "a"), (2, "b"), (3, ""), (4, "c")]
    assert readers.search_url("a b", 5, language="en", place=("1", "k", "n")).endswith("&hl=en&gl=en&pws=0&as_qdr=all&tci=g:1&uule=w+CAIQICIkn")
