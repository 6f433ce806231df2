"""Best pairs by blocks equal those of all pairs."""

import numpy as np
import pytest

from quaestor.operators import models, rank

K = 3


def both(rows):
    want = rank.ranked(models.bilinear_scores(rows.where("id % 5 = 0"), rows, ["label"]).where("query_id <> uid"), ["query_id"], K)
    got = rank.ranked(models.bilinear_top_k(rows.where("id % 5 = 0"), rows, ["label"], K), ["query_id"], K)
    return (sorted(map(tuple, x.select("query_id", "uid", "score", "rank").collect()), key=repr) for x in (got, want))


@pytest.mark.parametrize("scale", [0.0, 0.001, 1.0, 40.0])
@pytest.mark.parametrize("block", [4096, 7])
def test_best_pairs_equal_all_pairs(spark, monkeypatch, scale, block):
    """Ties by rounding, equal vectors, scores of 0 and 1, keys without queries or with null."""
    monkeypatch.setattr(models, "BLOCK_ROWS", block)
    vectors = np.random.default_rng(4).normal(size=(120, 6)).astype(np.float32) * scale
    vectors[60:80] = vectors[60]
    rows = [(k, v.tolist(), None if k % 17 == 0 else 9 if k in (1, 2) else k % 3) for k, v in enumerate(vectors)]
    got, want = both(spark.createDataFrame(rows, "id long, vector array<float>, label int"))
    assert got == want != []


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [3.0, 1.0], 1), (5, [], 1)]
    got, want = both(spark.createDataFrame(rows, "id long, vector array<float>, label int"))
    assert repr(got) == repr(want) != "[]"


def test_blocks_pass_on_few_pairs(spark):
    """Before, each pair was a row to sort."""
    rows = spark.range(2000).selectExpr("id", "array(sin(id), cos(id)) as vector", "1 as label")
    assert models.bilinear_top_k(rows.where("id % 25 = 0"), rows, ["label"], K).count() < 80 * 2000 / 10
