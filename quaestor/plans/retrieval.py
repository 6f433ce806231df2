"""Further queries over questions: stemmed and literal rankings, product queries, duplicates, small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions import urls as U
from quaestor.operators import dataset, evaluate, index, pages, rank, search
from quaestor.plans.catalogue import ASKED, BM25, DOCS, POSTINGS, QUESTION, TFIDF, TOP, WITH, indexed, query
from quaestor.plans.stem_sql import stem_ctes
from quaestor.sources import views
from quaestor.sources.views import docs, table

#: A question whose words come back in other forms, and repeat.
FORMS = "The tioning leaned, thheouble tioning ereds thaeas? of 2019"


def _needles(terms):
    return ", ".join(f"'{t}'" for t in sorted(set(terms)))


STEM_TERMS = index.question_terms(FORMS, "stem")
LITERAL_TERMS = index.question_terms(FORMS, "literal")
STEMMED = f"""{stem_ctes("postings")}, stemmed as (select uid, zone, stem as word, sum(freq) as freq from postings join stems using (word) group by uid, zone, stem),
  asked as (select * from stemmed where word in ({_needles(STEM_TERMS)}))"""


def _tfidf(n_terms: int) -> str:
    return f"""n as (select count(*)::double as total from docs),
  z as (select asked.uid, asked.zone, 1.0 * count(*) / {n_terms} * sum(freq * (1 + ln(n.total / 2)) / sqrt(2.0 * length(question_body))) as s
        from asked join docs on docs.uid = asked.uid, n where length(question_body) > 0 group by asked.uid, asked.zone)
  select uid, round(sum(s), 6) as score from z group by uid order by score desc, uid desc limit {TOP}"""


@query(f"{WITH}, {POSTINGS}, {STEMMED}, {_tfidf(len(STEM_TERMS))}")
def tfidf_stemmed_topk(spark, sf_dir):
    return rank.top_k(rank.tfidf(indexed(spark, sf_dir, "stem", FORMS), FORMS), TOP)


@query(f"{WITH}, {POSTINGS}, {STEMMED}, {BM25} select * from bm25 order by score desc, uid desc limit {TOP}")
def bm25_stemmed_topk(spark, sf_dir):
    return rank.top_k(rank.bm25(indexed(spark, sf_dir, "stem", FORMS), FORMS), TOP)


_MARKS = X.PUNCTUATION.replace("'", "''")


def _clean(column: str) -> str:
    return f"translate(regexp_replace(coalesce({column}, ''), '{X.ANY_URL}', '', 'g'), '{_MARKS}', '')"


def _literal_words(column: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace({_clean(column)}, '[ \t\n\r\f]+', ' ', 'g')), ' '), lambda w: w <> '')"


LITERAL = f"""literal as (select uid, zone, lower(word) as word from (
    select uid, 'title' as zone, unnest({_literal_words("question_title")}) as word from docs union all
    select uid, 'body', unnest({_literal_words("question_body")}) from docs)
    where length(word) > 3 and not regexp_matches(word, '^[0-9]+$') and word not in ({X.duck_stopwords()})),
  {stem_ctes("literal")},
  asked as (select uid, zone, stem as word, count(*) as freq from literal join stems using (word) where stem in ({_needles(LITERAL_TERMS)}) group by uid, zone, stem)"""


@query(f"with {DOCS}, {LITERAL}, {_tfidf(len(LITERAL_TERMS))}")
def tfidf_literal_topk(spark, sf_dir):
    return rank.top_k(rank.tfidf(indexed(spark, sf_dir, "literal", FORMS), FORMS), TOP)


@query(f"""with {DOCS}, c as (select uid, {_clean("question_body")} as clean from docs where question_body is not null)
  select uid, md5(clean) as clean_md5, length(clean) as length from c""")
def clean_text_any_scheme(spark, sf_dir):
    clean = docs(spark, sf_dir).where("question_body is not null").select("uid", X.clean(F.col("question_body"), any_scheme=True).alias("clean"))
    return clean.select("uid", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("length"))


@query(f"""{WITH}, w as (select unnest(list_concat(title, body)) as word from words),
  f as (select word, count(*) as n, row_number() over (order by count(*) desc, encode(word)) as position from w group by word having count(*) >= 10),
  {stem_ctes("f")} select stem as word, arg_min(n, position) as frequency from f join stems using (word) group by stem""")
def term_frequency_stems(spark, sf_dir):
    words = dataset.vocabulary(docs(spark, sf_dir)).select(F.col("id").alias("position"), "word", F.col("n").alias("frequency"))
    return dataset.term_frequencies(words)


# Product queries.

PRODUCTS = views.PRODUCTS
ABOUT = "la ipad der que nicht von las"
ABOUT_TERMS = X.query_terms(ABOUT)
QA = f"""t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)),
  qa as (select conv_id || '_' || turn as uid, string_split(text, chr(10))[1] as question_title, text as question_body, answer as answer_body,
    [{", ".join(f"'{p}'" for p in PRODUCTS)}][conv_id % {len(PRODUCTS)} + 1] as product from t where role = 'user' and next_role = 'assistant'),
  qw as (select *, {X.duck_tokens("question_title")} as title, {X.duck_tokens("answer_body")} as answer from qa)"""
_ANY = ", ".join(f"'{t}'" for t in ABOUT_TERMS)
_STARTS = "(len(list_filter({0}, lambda w: " + " or ".join(f"starts_with(w, '{t}')" for t in ABOUT_TERMS) + ")) > 0)"


@query(f"with {QA} select uid from qw where (list_has_any(title, [{_ANY}]) or list_has_any(answer, [{_ANY}])) and product = 'ipad'")
def product_baseline(spark, sf_dir):
    return search.baseline(views.questions(spark, sf_dir), ABOUT, list(PRODUCTS)).select("uid").run()


@query(f"with {QA} select uid from qw where ({_STARTS.format('title')} or {_STARTS.format('answer')}) and product = 'ipad'")
def product_baseline_prefix(spark, sf_dir):
    return search.baseline(views.questions(spark, sf_dir), ABOUT, list(PRODUCTS), prefixes=True).select("uid").run()


@query(f"""with {QA}, s as (select uid, case when {_STARTS.format("title")} then 3.0 else 0.0 end + case when {_STARTS.format("answer")} then 1.0 else 0.0 end as score from qw where product = 'ipad')
  select uid, (score + 5.0)::double as score from s where score > 0""")
def product_baseline_boosted(spark, sf_dir):
    found = search.baseline(views.questions(spark, sf_dir), ABOUT, list(PRODUCTS), prefixes=True, boosts=(3.0, 1.0, 5.0))
    return found.select("uid", "score").run()


ABOUT_BM25 = f"""docs as (select uid, question_title, question_body, product from qa),
  words as (select *, {X.duck_tokens("question_body")} as body, {X.duck_tokens("question_title")} as title from docs),
  {POSTINGS}, asked as (select * from postings where word in ({_ANY})), {BM25}"""


@query(f"""with {QA}, {ABOUT_BM25} select bm25.uid, round(bm25.score + case when product = 'ipad' then 5.0 else 0.0 end, 6) as score from bm25 join docs using (uid)
  order by score desc, uid desc limit {TOP}""")
def product_boost_bm25(spark, sf_dir):
    own = views.questions(spark, sf_dir).withColumn("author_name", F.lit(None).cast("string"))
    return rank.top_k(rank.bm25(own, ABOUT, products={search.product_of(ABOUT, list(PRODUCTS)): 5.0}), TOP)


@query(f"""with {DOCS} select uid, list_filter(string_split(regexp_replace(lower(question_title), '\\s+', ' ', 'g'), ' '), lambda w: w in ('and', 'le', 'the', 'die'))[1] as product from docs""")
def product_detect_first(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("The", "And", "LE", "die")])
    return docs(spark, sf_dir).select("uid", X.detected_product(F.col("question_title"), names).alias("product"))


@query(f"""{WITH}, {POSTINGS}, {ASKED}, {TFIDF}, best as (select * from tfidf order by score desc, uid desc limit {TOP})
  select best.uid, score, question_title, question_body from best join docs using (uid)""")
def answer_question(spark, sf_dir):
    return rank.answer(indexed(spark, sf_dir), docs(spark, sf_dir), QUESTION, TOP)


# Duplicates and evaluation.

CLASSES = """same as (select doc_id as uid, min(doc_id) over (partition by md5(text)) as class_uid, count(*) over (partition by md5(text)) as n from documents where text is not null),
  classes as (select uid, class_uid from same where n > 1)"""


@query(f"""with {CLASSES}, o as (select doc_id, row_number() over (order by n_chars nulls first, doc_id) - 1 as position from documents),
  m as (select 'next' as model, unnest(range(1, 10)) as k union all select 'previous', unnest(range(1, 10))),
  lists as (select a.doc_id as query_uid, m.model, m.k - 1 as rank, b.doc_id as uid from o a, m join o b on b.position = a.position + case when m.model = 'next' then m.k else -m.k end),
  best as (select model, query_uid, min(case when own.class_uid = found.class_uid and lists.uid <> query_uid then rank end) as r
    from lists join classes own on own.uid = query_uid left join classes found on found.uid = lists.uid group by model, query_uid)
  select model, query_uid, (case when r is null then 7 when r > 5 then 6 else r end)::int as best_rank from best""")
def closure_best_rank(spark, sf_dir):
    """Two lists for each document, its neighbours in length, judged by the closure of its duplicates."""
    own = docs(spark, sf_dir).select("uid", F.struct("question_view_count", "uid").alias("order"))
    placed = dataset.numbered(own, "order").select("uid", "position")
    step = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k")
    wide = placed.select(F.col("uid").alias("query_uid"), "position", step)
    sides = [wide.select("query_uid", F.lit(name).alias("model"), (F.col("k") - 1).alias("rank"), (F.col("position") + sign * F.col("k")).alias("position")) for name, sign in (("next", 1), ("previous", -1))]
    lists = sides[0].unionByName(sides[1]).join(placed, "position").select("model", "query_uid", "rank", "uid")
    return evaluate.closure_best_ranks(lists, evaluate.duplicate_closure(views.equal_texts(spark, sf_dir)), 5)


@query("""with q as (select doc_id as uid, 'http://q.example.com/' || doc_id as source_url, min(doc_id) over (partition by md5(text)) as first from documents where text is not null)
  select uid, first as original_uid from q where uid <> first""")
def duplicate_original_links(spark, sf_dir):
    address = lambda uid: F.concat(F.lit("http://q.example.com/"), uid)
    links = views.equal_texts(spark, sf_dir).select(F.col("a").alias("uid"), address(F.col("b")).alias("question_original_url"))
    rows = docs(spark, sf_dir).select("uid", address(F.col("uid")).alias("source_url")).join(links, "uid", "left")
    return evaluate.original_links(rows)


@query("""select coalesce(l.doc_id, d.doc_id) as doc_id, quality = 1 as label, n_chars > 1000 as predicted from labels l full join documents d on l.doc_id = d.doc_id""")
def label_prediction_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    predicted = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("predicted"))
    return evaluate.labelled_predictions(labels, predicted, "doc_id")


@query(f"""with {DOCS} select uid, question_title from docs where question_title <> '' order by cast(('0x' || substr(md5('8:' || uid), 1, 7)) as bigint), uid limit {TOP}""")
def question_suggestions(spark, sf_dir):
    return rank.suggestions(docs(spark, sf_dir), TOP)


@query("select page_id, substr(sha1(url), 1, 5) as request_id from pages")
def request_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.request_id(F.col("url")).alias("request_id"))


@query(r"""with l as (select page_id, url, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) as ls from pages),
  links as (select page_id, url, (generate_subscripts(ls, 1) - 1)::int as pos, unnest(ls) as link from l),
  b as (select *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as base, regexp_replace(link, '^/?(\.\.?/)+', '') as inner_link from links)
  select page_id, pos, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') or base = '' then link when starts_with(link, '//') then split_part(base, '//', 1) || link
    when regexp_matches(link, '^([?#]|$)') then base || link when starts_with(inner_link, '/') then base || inner_link else base || '/' || inner_link end as link from b""")
def absolute_links(spark, sf_dir):
    found = pages.link_table(table(spark, sf_dir, "pages"))
    return found.select("page_id", "pos", U.absolute(F.col("link"), F.col("url")).alias("link"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, date_trunc('second', o_orderdate)::timestamp as back from orders")
def date_literals_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", search.date_text(F.col("o_orderdate").cast("timestamp")).alias("iso"))
    return rows.withColumn("back", search.date_value(F.col("iso")).cast("timestamp_ntz"))
