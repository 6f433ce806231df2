"""Indexes of one question's words, and postings that are counted where the texts are read."""

import pytest
from pyspark.sql import functions as F

from quaestor.functions.stem import _SPECIAL, _STEP2, _STEP3, _STEP4, may_stem_to, stem
from quaestor.functions.text import ANY_URL, PUNCTUATION, clean, tokens
from quaestor.operators import index, rank
from quaestor.plans import catalogue
from quaestor.sources import shared
from tests.test_operators import DOCS, SCHEMA, words

SF = "/root/testdata/sf0.001"
QUESTION = "printing the PRINTED printers été 2019 pages unknown"


@pytest.fixture(scope="module")
def docs(spark):
    more = [(7, "Printers", "Printers\nThe Printing of PRINTED ftp://x.org/printers pages", "ann", 5, "en"), (8, None, "the", None, 1, "en"), (7, "Printers", "printers print", "bob", 5, "en")]
    return spark.createDataFrame([*DOCS, *more], SCHEMA)


@pytest.mark.parametrize("analyser", index.ANALYSERS)
def test_index_of_a_question_equals_whole_index(spark, docs, analyser):
    whole = index.write(docs, shared.new_path(spark, "test"), analyser)
    terms = index.question_terms(QUESTION, analyser)
    part = index.write_about(docs, shared.new_path(spark, "test"), terms, analyser)
    rows = lambda t: sorted(map(repr, map(tuple, t.collect())))
    assert rows(part.postings) == rows(whole.asked(terms)) != []
    assert part.documents.columns == whole.documents.columns
    assert rows(part.documents) == rows(whole.documents) and rows(part.zones) == rows(whole.zones)
    for scorer in (rank.tfidf, rank.bm25, rank.combined_rank):
        assert rows(scorer(part, QUESTION)) == rows(scorer(whole, QUESTION)) != []
    with pytest.raises(ValueError):
        part.asked(["other"])
    none = index.write_about(docs, shared.new_path(spark, "test"), [], analyser)
    assert none.postings.isEmpty() and none.total == docs.count()


def test_queries_write_no_words_but_their_questions(spark):
    """Before, the first query of a session wrote an index of all words of all texts."""
    own = catalogue.indexed(spark, SF)
    assert own.words == set(catalogue.TERMS)
    assert {r.word for r in own.postings.select("word").distinct().collect()} <= own.words
    again = catalogue.indexed(spark, SF)
    assert again.postings.inputFiles() == own.postings.inputFiles()
    other = catalogue.indexed(spark, SF, "plain", "another question")
    assert other.postings.inputFiles() != own.postings.inputFiles()


def test_words_that_may_have_a_stem(spark):
    """The filter before Python loses no word of a stem."""
    ends = [*(s for s, _ in (*_STEP2, *_STEP3)), *_STEP4, *"s es ies ied sses ing ed edly ingly eed eedly y ys e ll".split()]
    listed = {a + b + c for a in ("", "a", "ab", "print", "hopp", "tr", "gener", "yeay", "agre") for b in ends for c in ("", "s", "ed", "ing", "ly", "ness", "ation")} | set(_SPECIAL)
    rows = spark.createDataFrame([(w, stem(w)) for w in sorted(listed)], "word string, stem string")
    for target in sorted({stem(w) for w in listed})[::40] + ["ski", "die", "earli"]:
        lost = rows.where((F.col("stem") == target) & ~may_stem_to(F.col("word"), target))
        assert lost.isEmpty(), target
    assert all(w.startswith(stem(w)[:-2]) for w in listed)


@pytest.mark.parametrize("analyser", ["plain", "stem"])
def test_postings_are_counted_without_a_shuffle(spark, docs, analyser):
    """Words never leave the task that reads them; rows of one uid, or of none, are added up all the same."""
    name = stem if analyser == "stem" else str
    single = docs.where("uid <> 7")
    assert "Exchange" not in index.postings(single, analyser)._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([(None, None, "wordy " * 900_000, None, 1, "en"), (None, "Wordy", "wordy other", None, 1, "en"), (99, "", "", None, 1, "en")], SCHEMA)
    both = docs.unionByName(long)
    want = {}
    for uid, title, body, *_ in both.collect():
        for zone, text in (("title", title), ("body", body)):
            for w in words(text or ""):
                if len(w) > 3 and not w.isdigit() and w not in index.STOPWORDS:
                    want[uid, zone, name(w)] = want.get((uid, zone, name(w)), 0) + 1
    got = index.postings(both, analyser).collect()
    assert len(got) == len(want) and {(r.uid, r.zone, r.word): r.freq for r in got} == want
    assert want[None, "body", name("wordy")] == 900_001


def test_words_between_any_blanks(spark):
    text = " \t\nOne,two\r\n\f three -- four'5 \x0bsix  \n"
    rows = spark.createDataFrame([(text,), ("",), (None,), ("  ",)], "t string")
    assert [r.w for r in rows.select(tokens(F.col("t")).alias("w")).collect()] == [["onetwo", "three", "four5", "\x0bsix "], [], [], []]


def test_cleaning_of_long_words(spark):
    """Each letter of a word was tried as the start of an address, so the time grew with the square of the word."""
    import re
    import time

    long = "a" * 400_000
    texts = ["see ab+c://x.y/z?q=1, é1://h-o.s/p//q end", "a://b.c.://d e_f://g:h://i", "no://", "x: //y", "_://_ ://a -b://c", long, f"{long} {long}://x/y z", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    began = time.perf_counter()
    got = [r.c for r in rows.select("k", clean(F.col("t"), any_scheme=True).alias("c")).orderBy("k").collect()]
    assert time.perf_counter() - began < 30
    address = re.compile(ANY_URL.replace(r"\p{L}\p{N}_", r"\w"))
    want = [address.sub("", t) if len(t) < 1000 else t for t in texts[:-1]]
    want[-1] = f"{long}  z"
    assert got == [w.translate(str.maketrans("", "", PUNCTUATION)) for w in want] + [None]
