"""The pipeline against a brute-force version of each stage, on a small fixture."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from quaestor.llm import mixing, toxicity
from quaestor.llm.bpe import read_ranks
from quaestor.llm.lines import MAX_RATIO, MIN_PAGES
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_near import brute_classes, edited, random_text
from tests.llm.test_toxicity import brute_score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["gronkish", "gronkly", "vexword"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(160):
        text = random_text(rng, int(rng.integers(12, 50)))
        toxic = int(i % 4 == 1)
        if toxic:
            text = f"{text}. {rng.choice(BAD)} {rng.choice(BAD)} you."
        rows.append((i, text + ("\nshared footer line" if i % 3 else ""), "en", "abc"[i % 3]))
        labels.append((i, 1, toxic))
    rows += [(200 + k, edited(rng, rows[k][1], 1), "en", "b") for k in range(0, 30, 2)]
    rows += [(300 + k, rows[3][1], "fr", None) for k in range(5)]
    rows += [(400, None, None, "a"), (401, "", "en", "a"), (402, " \n\t", "en", "c"), (None, random_text(rng, 20), "en", "b"), (403, random_text(rng, 9000), "de", "c")]
    path = tmp_path_factory.mktemp("corpus")
    table = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"{path}"


def listed(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def as_set(rows):
    return sorted(map(str, rows))


def test_stages_equal_brute_force(spark, folder):
    stage = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = listed(docs)
    clean = stage["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    want = [r for r in rows if brute_score(model, r[1] or "") < toxicity.THRESHOLD]
    assert as_set(listed(clean)) == as_set(want) and len(want) < len(rows)
    assert not any(b in (r[1] or "") for r in want for b in BAD)

    lines = stage["line_dedup"](spark, clean, folder).cache()
    texts = brute_lines([(str(r[0]), r[1], r[2]) for r in want], MAX_RATIO, MIN_PAGES)
    assert sorted((str(i), str(t)) for i, t, _ in listed(lines)) == sorted((i, str(t)) for i, t in texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    near = stage["near_dedup"](spark, lines, folder).cache()
    before = [(i, t) for i, t, _ in listed(lines)]
    classes = brute_classes([r for r in before if len(r[1] or "") < 5000])
    big = [i for i, t in before if len(t or "") >= 5000]
    assert as_set(i for i, _, _ in listed(near)) == as_set([*{c for _, c, _ in classes}, *big])

    mixed = stage["mixing"](spark, near, folder).cache()
    plan = {r.doc_id: r for r in mixing.mix(near).collect()}
    words = defaultdict(int)
    for i, t, _ in listed(mixed):
        words[i] += len(t.split())
    assert dict(words) == {i: r.taken for i, r in plan.items() if r.taken}
    by_source, target = defaultdict(int), {}
    for r in plan.values():
        by_source[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= mixing.MAX_EPOCHS * r.size
    # A source of this fixture has a few hundred words, so a block is a part of it that counts.
    assert all(abs(by_source[s] - target[s]) <= 3 * mixing.BLOCK_WORDS for s in target)

    tokens = stage["byte_bpe"](spark, mixed, folder).collect()
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((str(i), ref.encode_ordinary(t)) for i, t, _ in listed(mixed))
    assert sorted((str(r.doc_id), r.ids) for r in tokens) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in tokens)


def test_run_is_its_stages_and_repeats(spark, folder):
    a, b = ([(r.doc_id, r.ids_sha256) for r in C.run(spark, folder).collect()] for _ in range(2))
    assert as_set(a) == as_set(b) and a


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).where(F.col("n_tokens") > 0).count() == 0
