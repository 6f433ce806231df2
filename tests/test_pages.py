import datetime as dt

import pytest

from quaestor.functions.dates import contains_strict_date, find_dates, macrumors_date, superuser_date
from quaestor.operators import pages as P

BODY = "word " * 40
SITE = "http://forum.example.com/t/1"


def post(i, body=BODY, css="author", href="http://forum.example.com/u/{}", date="posted May {}, 2015", extra=""):
    return f'<div class="post"><span class="{css}"><a href="{href.format(i)}">name{i}</a></span><i>{date.format(i + 1)}</i><div class="b">{body}</div>{extra}</div>'


def page(*posts):
    return "<html><head><script>var x='</p>'</script></head><body><div id=c>" + "".join(posts) + "</div></body></html>"


CASES = {
    "three": (SITE, page(*[post(i) for i in range(3)]), "results", 3, ""),
    "one": (SITE, page(post(0)), "other", 0, "no lowest_valid_container"),
    "short": (SITE, page(*[post(i, "few words") for i in range(3)]), "other", 0, "no lowest_valid_container"),
    "long": (SITE, page(post(0), post(1), post(2, "word " * 1100)), "results", 2, ""),
    "other_host": (SITE, page(*[post(i, href="http://else.example.org/u/{}") for i in range(3)]), "other", 0, "no lowest_valid_container"),
    "date_in_anchor": (SITE, page(*[post(i, date='<a title="May {}, 2015">when</a>') for i in range(3)]), "other", 0, "no lowest_valid_container"),
    "form": (SITE, page(*[post(i, extra='<input type="password">') for i in range(3)]), "other", 0, "no lowest_valid_container"),
    "blog": ("http://forum.example.com/blog/1", page(*[post(i) for i in range(3)]), "other", 0, "url blacklisted"),
    "nested": (SITE, page(post(0), "<div>" + "".join(post(i) for i in range(1, 4)) + "</div>"), "results", 4, ""),
    "captcha": ("http://forum.example.com/captcha?x", page(post(0)), "captcha", 0, "no lowest_valid_container"),
    "index": ("http://forum.example.com/", '<body><div class="Pagination"><a href="/p2">2</a></div><ul>' + "".join(f'<li><a href="/how-{i}">q</a>' for i in range(12)) + "</ul></body>", "index", 0, "no lowest_valid_container"),
    "no_pagination": ("http://forum.example.com/", "<body><ul>" + "".join(f'<li><a href="/how-{i}">q</a>' for i in range(12)) + "</ul></body>", "other", 0, "no lowest_valid_container"),
    "empty": (SITE, "", "other", 0, "no body"),
    "null": (None, None, "other", 0, "no body"),
}


def frame(spark):
    return spark.createDataFrame([(i, u, h) for i, (u, h, *_) in enumerate(CASES.values())], "page_id long, url string, html string")


def test_classes_and_posts(spark):
    got = {r.page_id: r for r in P.analyse(frame(spark)).collect()}
    for i, (name, (_, _, kind, n, reason)) in enumerate(CASES.items()):
        assert (got[i]["class"], len(got[i].posts), got[i].reason) == (kind, n, reason), name
    first = got[0].posts[0]
    assert (first.author, first.author_link, first.date, first.body) == ("name0", "http://forum.example.com/u/0", dt.datetime(2015, 5, 1), BODY.strip())
    index = got[list(CASES).index("index")]
    assert index.result_links[:2] == ["/how-0", "/how-1"] and index.pagination_links == ["/p2"]


def test_answers_and_pertinence(spark):
    rows = P.question_answers(P.analyse(frame(spark)), frame(spark)).where("page_id = 0").orderBy("answer_number").collect()
    assert [(r.answer_number, r.answer.author_name, r.question.author_name) for r in rows] == [(1, "name1", "name0"), (2, "name2", "name0")]
    assert rows[0].question.author_id == "forum.example.com_name0"
    off = {r.page_id: r.is_pertinent for r in P.analyse(frame(spark), product="Office Suite").collect()}
    on = {r.page_id: r.is_pertinent for r in P.analyse(frame(spark), product="WORD Suite").collect()}
    assert off[0] is False and on[0] is True


def test_open_paragraphs_and_deep_pages():
    body = P.parse_body("<body><p>one<p><b>two<p>three<ul><li>a<li>b</ul><br>x &amp; y</body>")
    assert [n.text() for n in body.walk() if n.tag == "li"] == ["a", "b"]
    assert body.text() == "onetwothreeabx & y"
    assert len(P.visible_text("<body>" + "<div>" * 5000 + "deep" + "</div>" * 5000)) == 4


def test_search_results(spark):
    links = spark.createDataFrame([(1, "u", i, x) for i, x in enumerate(["/url?q=A&sa=1", "/url?q=webcache:A&sa", "/url?q=B&sa=2", "/other", "/url?q=C&sa", "/url?q=D"])], "page_id long, url string, pos int, link string")
    assert [r.target for r in P.serp_results(links, "/url?q=", "webcache").collect()] == ["A"]


@pytest.mark.parametrize("text,strict", [("May 16, 2015", True), ("July 2016", False), ("Monday", False), ("12-05-2015", True), ("19 February 2013 09:10", True), ("1-2-3", False), ("", False), ("no date here", False)])
def test_strict_dates(text, strict):
    assert contains_strict_date(text) is strict
    assert bool(find_dates(text)) is strict


def test_found_moments():
    got = find_dates("On May 16, 2015 and again 12-05-1999; never 3 May 1200.")
    assert [m for m, *_ in got] == [dt.datetime(2015, 5, 16), dt.datetime(1999, 12, 5)]


def test_site_dates(spark):
    df = spark.createDataFrame([("Feb 19 '13 at 09:10", "Feb 09, 2013 at 09:10 PM"), ("Feb 19 at 09:10", "Mar 7, 1999"), ("Feb 19 '95 at 09:10", "x")], "a string, b string")
    rows = df.select(superuser_date(df.a).cast("string").alias("a"), macrumors_date(df.b).cast("string").alias("b")).collect()
    assert [r.a for r in rows] == ["2013-02-19 09:10:00", "1970-02-19 09:10:00", "1995-02-19 09:10:00"]
    assert [r.b for r in rows] == ["2013-02-09 21:10:00", "1999-03-07 00:00:00", None]
