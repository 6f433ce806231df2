from collections import defaultdict

import numpy as np
import pytest

from quaestor.llm import hamming as H

M = (1 << 64) - 1


def brute(codes, queries, k):
    rows = sorted({(i, c) for i, c in codes if i is not None and c is not None})
    out = []
    for q, code in sorted({(i, c) for i, c in queries if i is not None and c is not None}):
        near = sorted((((code ^ c) & M).bit_count(), i) for i, c in rows if i != q)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def signed(x):
    x = int(x) & M
    return x - (1 << 64) if x >> 63 else x


def frame(spark, rows):
    return spark.createDataFrame([(i, c, "x") for i, c in rows], "id long, code long, distance string")


@pytest.mark.parametrize("n,block,chunk,k", [(700, H.BLOCK, H.CHUNK, 10), (700, 32, 7, 3), (3, H.BLOCK, H.CHUNK, 10)])
def test_equals_brute_force(spark, monkeypatch, n, block, chunk, k):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "CHUNK", chunk)
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 6)
    codes = [(i, signed(int(centres[i % 6]) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))) for i in range(n // 2)]
    codes += [(n + i, signed(int(rng.integers(0, 1 << 63)) * 2 + 1)) for i in range(n // 4)]
    codes += [(2 * n + i, 12345) for i in range(n // 4)]  # one hot code
    codes += [(None, 5), (9000, None), codes[0], codes[0]]
    queries = [c for c in codes if c[0] is None or c[0] % 11 == 0]
    got = H.exact_top_k(frame(spark, codes), frame(spark, queries), k).collect()
    assert sorted(tuple(r) for r in got) == brute(codes, queries, k)


def test_sign_codes(spark):
    vectors = [[1.0, -1.0, 0.0, 2.0], [], None, [1.0] * 64, [1.0] * 70, [-0.0, float("nan")]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<float>")
    got = {r.id: r.c for r in df.select("id", H.sign_code(H.F.col("v")).alias("c")).collect()}
    assert (got[0], got[1], got[2], got[3], got[4]) == (0b1001, 0, None, -1, -1)


def test_strict_sign_codes(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [0.0, float("nan")])], "id long, v array<float>")
    assert [r.c for r in df.select(H.sign_code(H.F.col("v"), strict=True).alias("c")).collect()] == [-1, None, 1]
    with pytest.raises(Exception, match="a code has 64 bits"):
        spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<float>").select(H.sign_code(H.F.col("v"), strict=True)).collect()


def test_segments_cover_the_code():
    for n in (1, 2, 500, 10_000, 10**6, 10**9):
        parts = H.segments_of(n)
        assert parts[0][0] == 0 and sum(w for _, w in parts) == H.BITS
        assert all(a + w == b for (a, w), (b, _) in zip(parts, parts[1:]))


def test_masks():
    count = defaultdict(set)
    for x in range(1 << 7):
        count[x.bit_count()].add(x)
    assert all(set(H.masks(7, w).tolist()) == count[w] for w in range(9))


def test_empty_tables(spark):
    some = frame(spark, [(1, 2), (3, 4)])
    assert H.exact_top_k(some.limit(0), some).count() == 0
    assert H.exact_top_k(some, some.limit(0)).count() == 0
