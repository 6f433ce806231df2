"""Page queries over forum pages that are built from the tables, so that SQL knows what must be found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import pages
from quaestor.plans.catalogue import query
from quaestor.sources.views import table

#: Turns of a conversation, and documents of an index, on one page.
TURNS, ENTRIES = 10, 15
_BLANK = r"[ \t\n\r\f\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _plain(text):
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def _threads(spark, sf_dir, *extra) -> DataFrame:
    """One row for each page: page_id, posts (turn, role, text, in order)."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    page = (F.col("conv_id") * 1000 + F.floor(F.col("turn") / TURNS)).alias("page_id")
    return turns.select(page, F.struct("turn", "role", "text").alias("p")).groupBy("page_id").agg(F.array_sort(F.collect_list("p")).alias("posts"))


def forum_pages(spark, sf_dir) -> DataFrame:
    """Threads as pages of a forum: each post has an author's link, a date and its text."""
    post = lambda p: F.concat(
        F.lit('<div class="post"><span class="author"><a href="http://forum.example.com/u/'), p["role"], F.lit('">'), p["role"],
        F.lit('</a></span> <i>posted May '), (p["turn"] % 28 + 1).cast("string"), F.lit(', 2015</i> <div class="b">'), _escaped(_plain(p["text"])), F.lit("</div></div>"),
    )
    html = F.concat(F.lit('<html><head><script>var x="</p>"</script></head><body><div id="c">'), F.array_join(F.transform("posts", post), ""), F.lit("</div></body></html>"))
    return _threads(spark, sf_dir).select("page_id", F.concat(F.lit("http://forum.example.com/t/"), "page_id").alias("url"), html.alias("html"))


POSTS = f"""turns as (select conv_id * 1000 + turn // {TURNS} as page_id, turn, role, trim(regexp_replace(text, '{_BLANK}', ' ', 'g')) as body from conversations where text is not null),
  blocks as (select *, role || ' posted May ' || (turn % 28 + 1) || ', 2015 ' || body as block from turns),
  shown as (select *, length(trim(block)) as n from blocks),
  found as (select page_id, count(*) filter (where n > 150) as n_blocks, count(*) filter (where n > 150 and n < 5000) as n_posts from shown group by page_id),
  classed as (select page_id, case when n_posts >= 2 then 'results' else 'other' end as class,
    case when n_blocks < 2 then 'no lowest_valid_container' when n_posts < 2 then 'not enough valid posts found' else '' end as reason, case when n_posts >= 2 then n_posts else 0 end as n_posts from found),
  posts as (select page_id, role, turn, case when length(body) > 150 then body else block end as body, row_number() over (partition by page_id order by turn, role, body) - 1 as k
    from shown join classed using (page_id) where class = 'results' and n > 150 and n < 5000)"""


@query(f"with {POSTS} select page_id, class, reason, n_posts::int as n_posts from classed")
def forum_pages_classify(spark, sf_dir):
    return pages.analyse(forum_pages(spark, sf_dir)).select("page_id", "class", "reason", F.size("posts").alias("n_posts"))


@query(f"""with {POSTS} select a.page_id, a.k::int as answer_number, 'forum.example.com' as source_domain, md5(q.body) as question_md5, md5(a.body) as answer_md5, 'forum.example.com_' || q.role as question_author,
  a.role as answer_author, make_timestamp(2015, 5, (a.turn % 28 + 1)::int, 0, 0, 0.0) as answer_date from posts a join posts q on q.page_id = a.page_id and q.k = 0 where a.k > 0""")
def forum_question_answers(spark, sf_dir):
    own = forum_pages(spark, sf_dir)
    rows = pages.question_answers(pages.analyse(own), own)
    return rows.select(
        "page_id", "answer_number", "source_domain", F.md5("question.question_body").alias("question_md5"), F.md5("answer.answer_body").alias("answer_md5"),
        F.col("question.author_id").alias("question_author"), F.col("answer.author_name").alias("answer_author"), F.col("answer.answer_date").alias("answer_date"),
    )


@query(f"with {POSTS} select page_id, md5(string_agg(block, '' order by turn, role, body)) as text_md5 from blocks group by page_id")
def forum_visible_text(spark, sf_dir):
    text = pages.visible_text_column(F.col("html"))
    return forum_pages(spark, sf_dir).select("page_id", F.md5(text).alias("text_md5"))


# Index pages and the frontier.


def index_pages(spark, sf_dir) -> DataFrame:
    """Lists of documents as index pages: English ones are questions by their links; every second page has no pagination."""
    entries = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / ENTRIES).alias("page_id")).agg(F.array_sort(F.collect_set(F.struct("doc_id", "lang"))).alias("d"))
    item = lambda d: F.concat(F.lit('<li><a href="/'), F.when(d["lang"] == "en", "how-to-").otherwise("t/"), d["doc_id"], F.lit('">entry</a></li>'))
    pagination = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<div class="PageNav"><a href="/page/'), F.col("page_id") + 1, F.lit('">next</a></div>'))).otherwise("")
    html = F.concat(F.lit("<body>"), pagination, F.lit("<ul>"), F.array_join(F.transform("d", item), ""), F.lit("</ul></body>"))
    return entries.select("page_id", F.concat(F.lit("http://list.example.org/page/"), "page_id").alias("url"), html.alias("html"))


LISTS = f"""e as (select distinct doc_id // {ENTRIES} as page_id, doc_id, lang, '/' || case when lang = 'en' then 'how-to-' else 't/' end || doc_id as link from documents),
  lists as (select page_id, count(*) as n, count(*) filter (where lang = 'en') as n_en from e group by page_id),
  classed as (select page_id, case when page_id % 2 = 0 and n > 9 and n_en > 0 then n else 0 end as n_links from lists)"""


@query(f"with {LISTS} select page_id, case when n_links > 0 then 'index' else 'other' end as class, n_links::int as n_result_links, (1 - page_id % 2)::int as n_pagination_links from classed")
def index_pages_classify(spark, sf_dir):
    return pages.analyse(index_pages(spark, sf_dir)).select("page_id", "class", F.size("result_links").alias("n_result_links"), F.size("pagination_links").alias("n_pagination_links"))


NEXT = f"""{LISTS}, reached as (select 'http://list.example.org' || link as link from e join classed using (page_id) where n_links > 0
    union select 'http://list.example.org/page/' || (page_id + 1) from classed where n_links > 0),
  fresh as (select link from reached where link not in (select 'http://list.example.org/page/' || page_id from classed) and link not in (select 'http://list.example.org/t/' || doc_id from e))"""


def _frontier(spark, sf_dir, budget=None):
    own = index_pages(spark, sf_dir)
    told = table(spark, sf_dir, "documents").where("lang <> 'en' or lang is null").select(F.concat(F.lit("http://list.example.org/t/"), "doc_id").alias("url"))
    return pages.frontier(pages.analyse(own), own, own.select("url").unionByName(told), budget)


@query(f"with {NEXT} select link from fresh")
def crawl_frontier(spark, sf_dir):
    return _frontier(spark, sf_dir)


@query(f"with {NEXT} select link from fresh order by link limit 40")
def crawl_frontier_budget(spark, sf_dir):
    return _frontier(spark, sf_dir, 40)


@query(f"with {LISTS} select page_id, 'http://list.example.org' || link as link from e where lang = 'en' and page_id >= 0")
def guided_links(spark, sf_dir):
    guide = pages.Guide((r"/how-to-[0-9]+", "/page/"), ("/page/", "login"), ())
    return pages.guided_links(index_pages(spark, sf_dir), guide)


# Pages of two sites with rules.


def site_pages(spark, sf_dir) -> DataFrame:
    """Threads as pages of the two sites with rules, every second conversation on each."""
    post = lambda kind: lambda p: F.concat(
        F.lit(f'<div class="{kind}"><span class="vote-count-post">'), p["turn"].cast("string"), F.lit('</span><div class="post-text">'), _escaped(p["text"]), F.lit("</div></div>")
    )
    rest = F.slice("posts", 2, F.size("posts"))
    head = F.col("posts")[0]
    superuser = F.concat(
        F.lit('<body><div id="question-header"><h1><a href="/q">Title '), F.col("page_id").cast("string"), F.lit("</a></h1></div>"), post("postcell")(head),
        F.lit('<div class="post-tag">outlook</div><div class="post-tag">mail</div><div id="qinfo"><p class="label-key"><b>asked</b></p><p class="label-key"><b>'), F.size("posts").cast("string"), F.lit(" times</b></p></div>"),
        F.lit('<div class="owner"><div class="user-action-time"><span class="relativetime">Feb 19 \'13 at 09:10</span></div><div class="user-details"><a href="/u">'), head["role"], F.lit("</a></div></div>"),
        F.when(F.col("page_id") % 4000 == 0, '<div class="question-originals-of-duplicate"><ul><li><a href="/questions/1">it</a></li></ul></div>').otherwise(""),
        F.array_join(F.transform(rest, post("answercell")), ""), F.lit("</body>"),
    )
    message = lambda p: F.concat(F.lit('<div class="messageText">'), _escaped(p["text"]), F.lit("</div>"))
    macrumors = F.concat(
        F.lit('<body><div id="content"><div><div><div><nav><fieldset><span><span>a</span><span>b</span><span><a><span>IPad</span></a></span></span></fieldset></nav></div><div><div><div><div><h1>Title '), F.col("page_id").cast("string"),
        F.lit('</h1></div></div></div></div></div></div></div><a class="username">'), head["role"], F.lit('</a><div class="messageDetails"><span class="DateTime" title="Feb 09, 2013 at 09:10 PM">x</span></div>'),
        F.array_join(F.transform("posts", message), ""), F.lit("</body>"),
    )
    even = F.floor(F.col("page_id") / 1000) % 2 == 0
    url = F.when(even, F.concat(F.lit("https://superuser.com/questions/"), "page_id")).otherwise(F.concat(F.lit("http://forums.macrumors.com/threads/"), "page_id"))
    return _threads(spark, sf_dir).select("page_id", url.alias("url"), F.when(even, superuser).otherwise(macrumors).alias("html"))


_SQUEEZED = "translate({}, chr(9) || chr(10) || chr(160), '')"


@query(f"""with t as (select conv_id * 1000 + turn // {TURNS} as page_id, conv_id % 2 = 0 as even, turn, role, text, row_number() over (partition by conv_id * 1000 + turn // {TURNS} order by turn, role, text) - 1 as k,
    count(*) over (partition by conv_id * 1000 + turn // {TURNS}) as n from conversations where text is not null),
  q as (select * from t where k = 0), a as (select *, {_SQUEEZED.format("text")} as squeezed from t where k > 0),
  r as (select *, row_number() over (partition by page_id order by k) - 1 as number from a where even or squeezed <> '')
  select r.page_id, case when r.even then 'superuser.com' else 'macrumors.com' end as domain, 'Title ' || r.page_id as question_title, md5(case when r.even then q.text else {_SQUEEZED.format("q.text")} end) as question_md5,
    case when r.even then 'mail,outlook' else 'ipad' end as tags, case when r.even then q.turn end::int as question_upvotes, case when r.even then q.n end::int as question_view_count,
    case when r.even then 'superuser.com_' else 'macrumors.com_' end || q.role as author_id, case when r.even then timestamp '2013-02-19 09:10:00' else timestamp '2013-02-09 21:10:00' end as question_date,
    case when r.even and r.page_id % 4000 = 0 then 'https://superuser.com/questions/1' end as question_original_url, r.number::int as answer_number, md5(case when r.even then r.text else squeezed end) as answer_md5,
    case when r.even then r.turn end::int as answer_upvotes from r join q using (page_id)""")
def site_question_answers(spark, sf_dir):
    rows = pages.site_answers(site_pages(spark, sf_dir), product="iPad")
    return rows.select(
        "page_id", "domain", "question_title", F.md5("question_body").alias("question_md5"), F.array_join("question_tags", ",").alias("tags"), "question_upvotes", "question_view_count", "author_id",
        F.col("question_date").cast("timestamp_ntz").alias("question_date"), "question_original_url", "answer_number", F.md5("answer_body").alias("answer_md5"), "answer_upvotes",
    )


@query(f"""with t as (select distinct conv_id * 1000 + turn // {TURNS} as page_id, conv_id % 2 as odd from conversations where text is not null) select page_id, 'results' as class from t""")
def site_pages_route(spark, sf_dir):
    return site_pages(spark, sf_dir).select("page_id", pages.site_route(F.col("url")).alias("class"))
