"""The persisted index, rankings on it, the encoder's examples, numbering of wide rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.functions.stem import stem
from quaestor.operators import dataset, evaluate, index, models, rank, search
from quaestor.sources import shared
from tests.test_operators import DOCS, SCHEMA, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*DOCS, (7, "Printers", "Printers\nThe Printing of PRINTED ftp://x.org/printers pages", "ann", 5, "en")], SCHEMA)


@pytest.fixture(scope="module")
def built(spark, docs):
    return {a: index.write(docs, shared.new_path(spark, "test"), a) for a in index.ANALYSERS}


def test_numbering_of_wide_rows(spark):
    n = 300_000
    rows = spark.range(n).select((F.col("id") % 99_991).alias("uid"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("text")).repartition(16)
    got = dataset.numbered(rows).agg(F.count(F.lit(1)), F.count_distinct("position"), F.min("position"), F.max("position"), F.count_distinct("text")).first()
    assert tuple(got) == (n, n, 0, n - 1, n)
    order = [r.uid for r in dataset.numbered(rows.limit(5000)).orderBy("position").collect()]
    assert order == sorted(order)


def test_rankings_on_an_index_equal_those_on_texts(docs, built):
    question = "printer pages été unknown"
    for scorer in (rank.tfidf, rank.bm25, rank.word_rank, rank.combined_rank):
        assert sorted(map(tuple, scorer(built["plain"], question).collect())) == sorted(map(tuple, scorer(docs, question).collect()))
    assert sorted(map(tuple, rank.author_rank(built["plain"]).collect())) == sorted(map(tuple, rank.author_rank(docs).collect()))
    assert [r.uid for r in rank.answer(built["plain"], docs, "printer", 2).collect()] == [1, 3]


def test_index_reads_no_text(built):
    plan = rank.tfidf(built["plain"], "printer")._jdf.queryExecution().executedPlan().toString()
    assert "question_body" not in plan and "split" not in plan and "PartitionFilters: [isnotnull(bucket" in plan


def test_stems_find_other_forms(built):
    hits = lambda a, q: {r.uid for r in rank.tfidf(built[a], q).collect()}
    assert hits("plain", "printers") == {7} and hits("stem", "printers") == {1, 2, 3, 7}
    assert hits("stem", "prints") == {1, 7} and hits("plain", "") == hits("stem", "the") == set()


def test_literal_analyser(docs, built):
    """Formula by hand: repeated words count in the divisor, case and stop words as written, addresses of any scheme gone."""
    question = "printing the PRINTED printers 2019 pages?"
    terms = index.question_terms(question, "literal")
    assert terms == ["print", "print", "printer", "pages?"]
    got = {r.uid: r.score for r in rank.tfidf(built["literal"], question).collect()}
    counts = {(r.uid, r.zone, r.word): r.freq for r in built["literal"].postings.collect()}
    assert counts[7, "body", "print"] == 2 and counts[7, "body", "printer"] == 1
    want = {}
    for uid, _, body, *_ in docs.collect():
        for zone in index.ZONES:
            found = [counts[uid, zone, t] for t in set(terms) if (uid, zone, t) in counts]
            if found and body:
                want[uid] = want.get(uid, 0) + len(found) / 4 * sum(found) * (1 + math.log(len(DOCS) + 1) - math.log(2)) / math.sqrt(2 * len(body))
    assert got == pytest.approx({k: round(v, 6) for k, v in want.items()}, abs=2e-6)


def test_index_is_built_once(spark):
    from quaestor.sources.views import docs

    own = docs(spark, "/root/testdata/sf0.001")
    first = index.of(own)
    assert index.of(docs(spark, "/root/testdata/sf0.001")).postings.inputFiles() == first.postings.inputFiles()


def tiny(n):
    rng = np.random.default_rng(3)
    return models.EncoderWeights(rng.normal(size=(n, 3)), rng.normal(size=(5, 8)), rng.normal(size=8), rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))


def test_rerank_and_examples(docs, built):
    vocab = dataset.vocabulary(docs, 1)
    ids = {r.word: r.id for r in vocab.collect()}
    w = tiny(len(ids) + 1)

    def state(text, most):
        own = [ids.get(x, 0) for x in words(text)][:most]
        return models.encode(w, np.array([own + [0] * (160 - len(own))]), np.array([len(own)]))[0]

    score = lambda a, b: round(1 / (1 + math.exp(-state(a, 160) @ w.pairing @ state(b, 80))), 6)
    texts = {uid: body for uid, _, body, *_ in docs.collect()}
    got = {r.uid: r.score for r in rank.retrieve_rerank(built["plain"], docs, "printer pages", vocab, w, 3, 2).collect()}
    first = [r.uid for r in rank.top_k(rank.bm25(built["plain"], "printer pages"), 3).collect()]
    want = sorted(((score("printer pages", texts[u]), u) for u in first), reverse=True)[:2]
    assert got == pytest.approx({u: s for s, u in want}, abs=2e-6)
    features = dataset.text_features(docs, vocab)
    train = dataset.train_examples(dataset.train_pairs(docs), features)
    assert train.schema.names == dataset.example_schema("train").names and {r.label for r in train.collect()} <= {0, 1}
    drawn = dataset.distractors(docs)
    rows = dataset.eval_examples(drawn, features)
    assert rows.schema.names == dataset.example_schema("eval").names and rows.count() == docs.count()
    others = {}
    for r in drawn.collect():
        others.setdefault(r.uid, []).append(r.distractor_uid)
    expected = sorted(sum(score(t, texts[o]) > score(t, t) for o in others[u]) for u, t in texts.items())
    assert sorted(r["rank"] for r in models.example_ranks(rows, w).collect()) == expected


def test_batches_and_frequencies(spark):
    rows = spark.range(50).select(F.col("id").alias("uid"))
    got = dataset.batches(rows, 16, 2).collect()
    sizes = {}
    for r in got:
        sizes[r.epoch, r.batch] = sizes.get((r.epoch, r.batch), 0) + 1
    assert sizes == {(e, b): (16 if b < 3 else 2) for e in (0, 1) for b in range(4)}
    assert [r.uid for r in got if r.epoch == 0] != [r.uid for r in got if r.epoch == 1]
    list_ = spark.createDataFrame([(1, "printing", 9), (2, "prints", 20), (3, "the", 4)], "position int, word string, frequency int")
    assert {(r.word, r.frequency) for r in dataset.term_frequencies(list_).collect()} == {(stem("printing"), 9), ("the", 4)}


def test_products_and_duplicates(spark):
    rows = spark.createDataFrame([("a", "mail stops", "restart", "outlook"), ("b", None, "mailing lists", "Outlook"), ("c", "mail", "x", "word"), ("d", "x", "y", "outlook")], "uid string, question_title string, answer_body string, product string")
    uids = lambda s: sorted(r.uid for r in s.run().collect())
    assert uids(search.baseline(rows, "Outlook mail?", ["Word", "Outlook"])) == ["a"]
    assert uids(search.baseline(rows, "Outlook mail?", ["Word", "Outlook"], prefixes=True)) == ["a", "b"]
    assert uids(search.baseline(rows, "mail?", ["Word"])) == ["a", "c"]
    scored = {r.uid: r.score for r in search.baseline(rows, "outlook mail", ["outlook"], prefixes=True, boosts=(3, 1, 5)).run().collect()}
    assert scored == {"a": 8.0, "b": 6.0}
    links = spark.createDataFrame([(1, "u1", None), (2, "u2", "u1"), (3, "u3", "gone")], "uid int, source_url string, question_original_url string")
    assert {(r.uid, r.original_uid) for r in evaluate.original_links(links).collect()} == {(2, 1), (3, None)}
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "uid int, class_uid int")
    lists = spark.createDataFrame([("m", 1, 0, 1), ("m", 1, 4, 3), ("m", 1, 2, 9), ("m", 8, 7, 9), ("m", 9, 0, 5), ("m", 5, 0, 1)], "model string, query_uid int, rank int, uid int")
    assert {(r.query_uid, r.best_rank) for r in evaluate.closure_best_ranks(lists, classes, 5).collect()} == {(1, 4), (8, 6), (9, 7)}


def test_pair_scorer_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(x.tolist(), (x if k % 2 else -x).tolist(), k % 2) for k in range(80) for x in [rng.normal(size=4)]]
    frame = spark.createDataFrame(rows, "left array<double>, right array<double>, label int")
    out = models.fit_pair_scorer(frame).transform(models.pair_features(frame)).collect()
    assert all(r.prediction == r.label for r in out)


def test_shared_folder(spark):
    folder = shared.shared_dir(spark)
    assert folder.endswith(f"/quaestor-{spark.sparkContext.applicationId}") and folder == shared.shared_dir(spark)
    rows = shared.written(spark.range(5), "t")
    assert folder.rsplit("/", 1)[1] in rows.inputFiles()[0] and rows.count() == 5
