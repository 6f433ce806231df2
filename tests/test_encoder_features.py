"""Ids of a text's words, evaluation examples by digest, the classifier's sample."""

from pyspark.sql import functions as F

from quaestor.operators import dataset, models
from quaestor.plans import catalogue, encoder
from quaestor.sources.views import docs
from tests.test_operators import SCHEMA, words

SF = "/root/testdata/sf0.001"


def test_ids_of_odd_rows(spark):
    """Rows stand for themselves, null and repeated uids too: words of two rows of one uid were mixed up before."""
    texts = [(1, "the printer prints, the pages"), (2, ""), (3, None), (4, "the été printer " * 90), (4, "pages other"), (None, "pages pages"), (None, "the")]
    rows = spark.createDataFrame([(uid, None, text, None, 1, "en") for uid, text in texts], SCHEMA)
    vocab = spark.createDataFrame([(1, "the"), (2, "pages"), (3, "été"), (9, "printer")], "id int, word string")
    ids = {"the": 1, "pages": 2, "été": 3, "printer": 9}
    want = []
    for uid, text in texts:
        own = [ids.get(w, 0) for w in words(text or "")]
        want.append((uid, (own + [0] * 160)[:160], min(len(own), 160), len(own)))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, dataset.sentence_ids(rows, vocab).collect()), key=key) == sorted((x[:3] for x in want), key=key)
    assert sorted(map(tuple, dataset.text_features(rows, vocab).collect()), key=key) == sorted((x[:2] + x[3:] for x in want), key=key)
    assert dataset.text_features(rows.limit(0), vocab).count() == 0 and dataset.sentence_ids(rows, vocab.limit(0)).agg(F.max(F.array_max("ids"))).first()[0] == 0


def test_examples_by_digest_equal_digests_of_examples(spark):
    rows, _ = encoder._evaluated(spark, SF)
    names = ["context", "utterance", *[f"distractor_{k}" for k in range(dataset.DISTRACTORS)]]
    want = rows.select(*[c for n in names for c in (encoder._digest(n).alias(n), f"{n}_len")])
    got, _ = encoder._evaluated(spark, SF, encoder._digest)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_classifier_samples_ids_and_keeps_its_rows(spark, monkeypatch):
    """The sample was sorted with its texts and ended in one task; it is the same rows."""
    seen = []
    fit = models.fit_text_classifier
    monkeypatch.setattr(models, "fit_text_classifier", lambda rows: seen.append(rows) or fit(rows))
    assert catalogue.QUERIES["linear_text_classifier"](spark, SF, max_rows=40).count() == docs(spark, SF).count()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan
    own = docs(spark, SF).select("uid", "question_body").join(catalogue.views.accepted(spark, SF), "uid")
    want = dataset.shuffled(own, 5).limit(40).select("uid", "question_body", F.col("answer_accepted").cast("int"))
    assert sorted(map(tuple, seen[0].select("uid", "text", "label").collect())) == sorted(map(tuple, want.collect()))
