import datetime as dt
import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions.stem import stem, stem_of
from quaestor.operators import dataset, evaluate, models, rank
from quaestor.operators.search import Search, and_, boosted, from_, from_to, match, or_, phrase, prefix, iso_date, to_
from quaestor.sources import readers, sinks, views
from quaestor.streaming import ingest

DOCS = [
    (1, "Printer café problem", "Printer café problem\nThe printer prints café menus, printer!", "ann", 10, "en"),
    (2, "Scanner", "Scanner\nscanner scans printer pages http://x.com/a?b=1 slowly\t12345", "bob", 20, "en"),
    (3, "Été pages", "Été pages\npages about été and Printer", "ann", 30, "fr"),
    (4, "", "", None, 0, "de"),
    (5, None, None, "cid", None, None),
    (6, "!!! ???", "!!! ???", "bob", 7, "en"),
]
SCHEMA = "uid long, question_title string, question_body string, author_name string, question_view_count long, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def words(text):
    plain = (text or "").lower().translate(str.maketrans("", "", X.PUNCTUATION))
    return [w for w in plain.replace("\t", " ").replace("\n", " ").split(" ") if w]


def test_tokens_and_cleaning(docs):
    got = {r.uid: r for r in docs.select("uid", X.tokens(F.col("question_body")).alias("t"), X.clean(F.col("question_body")).alias("c")).collect()}
    for uid, _, body, *_ in DOCS:
        assert got[uid].t == words(body)
    assert got[2].c == "Scanner\nscanner scans printer pages  slowly\t12345"


def test_postings_count_words_of_both_zones(docs):
    got = {(r.uid, r.zone, r.word): r.freq for r in rank.postings(docs).collect()}
    want = defaultdict(int)
    for uid, title, body, *_ in DOCS:
        for zone, text in (("title", title), ("body", body)):
            for w in words(text):
                if len(w) > 3 and not w.isdigit() and w not in X.STOPWORDS:
                    want[uid, zone, w] += 1
    assert got == dict(want)


def test_tfidf_by_hand(docs):
    question = "printer pages printer unknown"
    terms = X.query_terms(question)
    got = {r.uid: r.score for r in rank.tfidf(docs, question, 2.0, 1.0).collect()}
    want = {}
    for uid, title, body, *_ in DOCS:
        score = 0.0
        for text, boost in ((title, 2.0), (body, 1.0)):
            counts = {t: words(text).count(t) for t in terms if words(text).count(t)}
            if counts and body:
                score += boost * len(counts) / len(terms) * sum(n * (1 + math.log(len(DOCS) / 2)) / math.sqrt(2 * len(body)) for n in counts.values())
        if score:
            want[uid] = round(score, 6)
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("question", ["", "zzz unknownword", "the and"])
@pytest.mark.parametrize("scorer", [rank.tfidf, rank.bm25, rank.word_rank, rank.combined_rank])
def test_questions_without_hits(docs, question, scorer):
    assert scorer(docs, question).count() == 0


def test_word_rank_equals_the_iteration(spark):
    """Toy graph: the loop of fixed increments against the closed form."""
    rng = np.random.default_rng(0)
    names = [f"word{k}" for k in range(6)]
    rows = [(d, " ".join(rng.choice(names, 2)), " ".join(rng.choice(names, 4)), "a", 1, "en") for d in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    asked = names[:4]
    edges = [(w, d, z) for d, t, b, *_ in rows for z, text in (("t", t), ("b", b)) for w in set(text.split()) & set(asked)]
    den = {w: sum(1 for x, d, _ in edges if x == w and d == max(e for y, e, _ in edges if y == w)) for w in {e[0] for e in edges}}
    same = defaultdict(int)
    for v in den.values():
        same[v] += 1
    score = defaultdict(float)
    for _ in range(50):
        for w, d, _ in edges:
            step = (1.0 / same[den[w]]) / den[w]
            score["w", w] += step
            score["d", d] += step
    most = max(score.values())
    want = {d: round(s / most, 6) for (kind, d), s in score.items() if kind == "d"}
    assert {r.uid: r.score for r in rank.word_rank(docs, " ".join(asked)).collect()} == pytest.approx(want, abs=2e-6)


def test_search_builder(docs):
    s = Search(docs)
    uids = lambda q: sorted(r.uid for r in q.run().collect())
    assert uids(s.where(match("question_body", "printer menus"))) == [1, 2, 3]
    assert uids(s.where(prefix("question_body", "scan"))) == [2]
    assert uids(s.where(phrase("question_body", "printer pages"))) == [2]
    assert uids(s.where(and_(from_("uid", 2), or_(to_("question_view_count", 7), F.col("lang") == "fr")))) == [3, 4, 6]
    assert uids(s.where(from_to("uid", "*", "*"))) == [1, 2, 3, 4, 5, 6]
    scored = s.query(boosted(prefix("question_title", "print"), 3), boosted(match("question_body", "printer"), 1)).sort(F.desc("score"), F.desc("uid"))
    assert [(r.uid, r.score) for r in scored.run().collect()] == [(1, 4.0), (3, 1.0), (2, 1.0)]
    page = scored.page(1, 1).select("uid").response()
    assert [r.uid for r in page.page.collect()] == [3] and page.num_found == 3 and s.filters == ()
    assert [r.score for r in scored.boost_by("question_view_count").run().collect()] == [40.0, 30.0, 20.0]
    assert {r.lang: r.n for r in s.facet("lang", n=F.count(F.lit(1))).collect()}["en"] == 3
    assert iso_date(dt.datetime(2020, 1, 2, 3, 4, 5, tzinfo=dt.timezone(dt.timedelta(hours=1)))) == "2020-01-02T02:04:05Z"


@pytest.mark.parametrize("pair", "consign consign|consigned consign|consistency consist|knack knack|knackeries knackeri|knightly knight|caresses caress|ponies poni|cats cat|hopping hop|hoping hope|relational relat|generously generous|skies sky|dying die|happily happili|agreed agre|news news|communication communic|by by".split("|"))
def test_published_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_stems_leave_stop_words(spark, docs):
    rows = spark.createDataFrame([("the",), ("prints",), (None,), ("having",), ("prints",)], "w string").coalesce(1)
    assert [r.s for r in rows.select(stem_of(F.col("w")).alias("s")).collect()] == ["the", "print", None, "having", "print"]
    got = {(r.uid, r.zone, r.word): r.freq for r in rank.stemmed_postings(docs).collect()}
    want = defaultdict(int)
    for r in rank.postings(docs).collect():
        want[r.uid, r.zone, stem(r.word)] += r.freq
    assert got == dict(want)


def test_training_sets(docs):
    assert [r.position for r in dataset.numbered(docs).orderBy("uid").collect()] == list(range(6))
    drawn = dataset.distractors(docs)
    assert drawn.count() == 54 and sorted(map(tuple, drawn.collect())) == sorted(map(tuple, dataset.distractors(docs.repartition(3)).collect()))
    pairs = dataset.train_pairs(docs).collect()
    assert all((r.context_uid == r.utterance_uid) == bool(r.label) for r in pairs)
    assert {r.part for r in dataset.split_half(docs).collect()} == {"test", "valid"}
    vocab = dataset.vocabulary(docs, 3)
    ids = {r.word: r.id for r in vocab.collect()}
    got = {r.uid: r for r in dataset.sentence_ids(docs, vocab, 5).collect()}
    for uid, _, body, *_ in DOCS:
        first = [ids.get(w, 0) for w in words(body)[:5]]
        assert got[uid].ids == first + [0] * (5 - len(first)) and got[uid].n_words == len(first)


def test_encoder_masks_padding(spark):
    rng = np.random.default_rng(1)
    w = models.EncoderWeights(rng.normal(size=(9, 4)), rng.normal(size=(7, 12)), rng.normal(size=12), rng.normal(size=(3, 3)), rng.normal(size=(3, 3)))
    short = models.encode(w, np.array([[1, 2, 0, 0]]), np.array([2]))
    assert short == pytest.approx(models.encode(w, np.array([[1, 2]]), np.array([2])))
    rows = spark.createDataFrame([([1, 2, 0], 2, [3, 0, 0], 1), ([4, 4, 4], 3, [5, 6, 7], 3)], "context array<int>, context_len int, utterance array<int>, utterance_len int")
    got = [r.probability for r in models.pair_scores(rows, w).collect()]
    c, r = models.encode(w, np.array([[1, 2, 0]]), np.array([2]))[0], models.encode(w, np.array([[3, 0, 0]]), np.array([1]))[0]
    assert got[0] == pytest.approx(1 / (1 + math.exp(-c @ w.pairing @ r)))


def test_classifier_learns(spark):
    rows = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} w{i % 5}", i % 2) for i in range(60)], "uid long, text string, label int")
    out = models.classify(models.fit_text_classifier(rows), rows).collect()
    assert all(r.predicted == r.label for r in out)


def test_evaluation(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9), (6, 7), (7, 8), (8, 6)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r.uid: r.class_uid for r in evaluate.duplicate_closure(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 6: 6, 7: 6, 8: 6, **{i: 100 for i in range(100, 141)}}
    queries = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "y")], "query_uid string, uid string")
    lists = spark.createDataFrame([("m", "q", 0, "a"), ("m", "q", 1, "b"), ("m", "r", 7, "y"), ("m", "r", 0, "n")], "model string, query_uid string, rank int, uid string")
    found = evaluate.first_match(queries, lists, 5)
    assert {(r.query_uid, r.uid): r["rank"] for r in found.collect()} == {("q", "b"): 1, ("q", "z"): 7, ("r", "y"): 6}
    row = evaluate.rank_statistics(evaluate.best_ranks(found), 5).first()
    assert (row.n_queries, row.n_misses, row.miss_share, row.mean_rank, row.second_order) == (2, 1, 0.5, 1.0, 1.0)
    pr = {r.query_uid: (r.precision, r.recall) for r in evaluate.precision_recall(queries, lists, 9).collect()}
    assert pr == {"q": (0.5, 0.5), "r": (0.5, 1.0)}
    none = evaluate.rank_statistics(evaluate.best_ranks(found.where("uid = 'y'")), 5).first()
    assert (none.mean_rank, none.second_order) == (-1.0, None)


def test_files_round_trip(spark, tmp_path):
    item = {"uid": "u", "question": {"question_body": "b", "question_tags": ["x"]}, "answer": {"answer_number": 1, "answer_author": {"author_name": "n"}}}
    (tmp_path / "qa.json").write_text(json.dumps(item) + "\nnot json\n")
    rows = readers.qa_json(spark, str(tmp_path / "qa.json")).collect()
    assert rows[0].question.question_tags == ["x"] and rows[0].answer.answer_author.author_name == "n" and rows[1]._corrupt == "not json"
    (tmp_path / "freq.txt").write_text("the  10\nof\t7\nbroken\n")
    assert [tuple(r) for r in readers.word_frequencies(spark, str(tmp_path / "freq.txt")).collect()] == [("the", 10), ("of", 7), ("broken", None)]
    (tmp_path / "urls.csv").write_text("http://a,3\nhttp://b,Yes\nhttp://c,0\n")
    assert [tuple(r) for r in readers.labelled_urls(spark, str(tmp_path / "urls.csv")).collect()] == [("http://a", 3), ("http://c", 0)]
    (tmp_path / "names.txt").write_text("Word\nMac OS\t2001\n\n")
    assert [r.name for r in readers.product_names(spark, str(tmp_path / "names.txt")).collect()] == ["Word", "Mac OS"]
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/q1.csv").write_text("rank,uid\n0,a\n1,b\n")
    assert sorted(tuple(r) for r in readers.predictions(spark, str(tmp_path / "lists"), "m").collect()) == [("m", "q1", 0, "a"), ("m", "q1", 1, "b")]
    text = spark.createDataFrame([("['a', 'b ']",), ('["c"]',)], "t string")
    assert [r.x for r in text.select(readers.string_list(F.col("t")).alias("x")).collect()] == [["a", "b"], ["c"]]
    vocab = spark.createDataFrame([(2, "b", 5), (1, "a", 9)], "id int, word string, n long")
    sinks.vocabulary(vocab, str(tmp_path / "vocab"))
    assert [r.value for r in spark.read.text(str(tmp_path / "vocab")).collect()] == ["a", "b"]
    (tmp_path / "vec.txt").write_text("a 1.5 2\nz 0 0\n")
    assert [tuple(r) for r in readers.vectors(spark, str(tmp_path / "vec.txt"), vocab).collect()] == [("a", [1.5, 2.0])]
    assert readers.search_url("a b", 5).endswith("?q=a+b&num=5&start=0")
    sinks.predictions(spark.createDataFrame([("m", "q", 0, "a")], "model string, query_uid string, rank int, uid string"), str(tmp_path / "out"))
    assert (tmp_path / "out/model=m/query_uid=q").exists()


def test_incremental_ingest(spark, tmp_path):
    source, index = tmp_path / "in", tmp_path / "index"
    source.mkdir()
    line = lambda u, url: json.dumps({"uid": u, "source_url": url, "crawl_date": "2024-01-01T00:00:00Z", "question": {"question_title": f"title{u}", "question_body": f"printer body{u}"}})
    (source / "1.json").write_text(line("1", "http://a") + "\n" + line("2", "http://a") + "\n" + line("3", "http://b") + "\n")
    ingest.maintain_postings(ingest.crawled(spark, str(source)), str(index), str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text(line("4", "http://b") + "\n" + line("5", "http://c") + "\n")
    ingest.maintain_postings(ingest.crawled(spark, str(source)), str(index), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(index)).where("word = 'printer'").collect()
    assert len(rows) == 3 and "5" in {r.uid for r in rows} and "4" not in {r.uid for r in rows}


def test_views(spark):
    views.register(spark, "/root/testdata/sf0.001")
    assert spark.sql("select count(*) from docs join accepted using (uid)").first()[0] > 0
