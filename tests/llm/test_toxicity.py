import math
import re
import zlib

import numpy as np
import pytest

from quaestor.llm import toxicity as T

CLEAN = "the quiet river runs past a small mill and nobody minds the slow water today".split()
BAD = ["gronkish", "gronkly", "vexword"]


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(CLEAN, rng.integers(3, 9))) for _ in range(rng.integers(1, 8))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            k = rng.integers(len(sentences))
            sentences[k] += " " + str(rng.choice(BAD)) + " " + str(rng.choice(BAD))
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def view(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def brute_score(model, text):
    """Sentence by sentence, word by word."""
    keep = 1.0
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    for piece in re.split(rb"[.!?\n]+", low):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", piece)
        for k in range(0, len(words), T.MAX_SENTENCE):
            z = model.bias
            for w in words[k : k + T.MAX_SENTENCE]:
                slots = T.instances(*view_bytes(w))[0][0]
                z += float(model.weights[slots].sum(dtype=np.float64))
            keep *= 1 - 1 / (1 + math.exp(-z))
    return 1 - keep


def view_bytes(raw):
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64)


@pytest.fixture(scope="module")
def model():
    rows = corpus(600)
    return T.fit([r[1] for r in rows], [r[2] for r in rows])


def test_fit_is_repeatable_and_learns_stems(model):
    rows = corpus(600)
    again = T.fit([r[1] for r in rows], [r[2] for r in rows])
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
    test = corpus(200, seed=9)
    score = model.score(*view([r[1] for r in test]))[0]
    assert [int(s >= T.THRESHOLD) for s in score] == [r[2] for r in test]
    unseen, clean = model.score(*view(["the small gronkful mill.", "the small slow mill."]))[0]
    assert unseen > 10 * clean


def test_score_equals_brute_force_and_chunks_do_not_matter(model):
    texts = ["", "The quiet river. Gronkish VEXWORD!\nnobody minds", "...", "vexword " * 95, "é vexwordé. x", "a.b.c"]
    score, p, starts, ends, at = model.score(*view(texts))
    assert score == pytest.approx([brute_score(model, t) for t in texts], abs=1e-9)
    assert score[0] == score[2] == 0
    alone = [model.score(*view([t]))[0][0] for t in texts]
    assert score == pytest.approx(alone, abs=1e-9)


def test_spans_and_hard_rows(spark, model):
    text = "The quiet river. É gronkish vexword! Nobody minds"
    rows = [(1, text, 5, 1.0), (None, text, None, None), (2, None, 1, 1.0), (3, "", 1, 1.0), (1, text, 5, 1.0), (4, "mill " * 60000, 1, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long, n_offending double")
    got = T.score_documents(df, model, spans=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [text.encode()[x.first : x.last].decode() for x in by[1].offending] == ["É gronkish vexword"]
    assert by[None].score == by[1].score and by[2].score == by[3].score == 0
    assert T.score_documents(df.limit(0), model).count() == 0


def test_training_leaves_held_out_rows(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, None, None), (0, 1, rows[0][2])], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    flipped = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert np.array_equal(T.train(docs, flipped).weights, model.weights)
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert [int(s >= 0.3) for s in model.score(*view([r[1] for r in test]))[0]] == [r[2] for r in test]
    assert T.train(docs, labels.limit(0)).score(*view(["x"]))[0][0] < 0.01


def test_fit_takes_three_thousand_of_each_label(spark, monkeypatch):
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2][:6400]
    docs = spark.createDataFrame([(i, "a word") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    taken = []
    monkeypatch.setattr(T, "fit", lambda texts, labels, share: taken.append((labels.count(0), labels.count(1))))
    T.train(docs, labels)
    assert taken == [(3000, 3000)]


def test_sample_is_bounded_in_bytes_and_by_id(spark, monkeypatch):
    """Repeated ids are one document, over-long texts aren't learned from, and the bytes of all stay below the bound."""
    rows = corpus(120)
    docs = [(i, t) for i, t, _ in rows] + [(0, "zzz another text of the same id")] * 50 + [(500, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, toxic string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(500, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, labels, share: seen.append(texts))
    T.train(df, labels, max_text=10_000)
    usable = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(seen[0]) == sorted(t for _, t in usable)
    T.train(df, labels, max_bytes=2_000, max_text=10_000)
    assert 0 < sum(len(t.encode()) for t in seen[1]) <= 2_000 and set(seen[1]) < set(seen[0])


def test_weights_are_near_a_minimum(model):
    """Independent likelihood, sentence by sentence: no step of a single weight or the bias makes it clearly better."""
    rows = corpus(600)
    y = np.array([r[2] for r in rows])

    def loss(m):
        p = np.clip([m.score(*view([r[1]]))[0][0] for r in rows], 1e-9, 1 - 1e-9)
        return -np.mean(np.where(y == 1, np.log(p), np.log1p(-p)))

    base = loss(model)
    slots = [int(T.instances(*view([w]))[0][0, 0]) for w in (*BAD, *CLEAN[:4])]
    for slot in [None, *slots]:
        for step in (-0.5, 0.5):
            weights = model.weights.copy()
            if slot is not None:
                weights[slot] += step
            moved = T.NoisyOr(weights, model.bias + (step if slot is None else 0.0))
            assert loss(moved) > base - 0.01
