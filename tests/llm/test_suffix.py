import hashlib
from collections import Counter

import numpy as np
import pytest

from quaestor.llm import suffix as S


def brute(texts):
    """Every window of every text, counted."""
    raw = [(t or "").encode() for t in texts]
    n = S.LENGTH
    count = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(r), int(gone.sum()), len(S._runs_of(gone)[0]), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def texts(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 6))) for _ in range(k))
    passage, other, line = word(90), word(60), word(12)
    out = [None, "", "short", "x" * 199, "x" * 200, "z" * 201, "ab" * 400, "ab" * 333 + word(20), word(60)]
    out += [f"{word(15)} {passage} {word(9)}" for _ in range(12)]
    out += [f"{word(int(rng.integers(1, 30)))} {passage[k : k + 220]} {line} {other}" for k in range(0, 200, 17)]
    out += [f"{line}\n{word(50)}\n{line}" for _ in range(6)]
    out += [passage, passage, passage[:250], other + passage + other, word(400) + passage[100:320] + word(300)]
    base = word(150).split(" ")
    for k in range(10):
        copy = list(base)
        copy[int(rng.integers(len(copy)))] = "edited"
        out.append(" ".join(copy))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for n, letters in ((1, 2), (50, 1), (300, 2), (2000, 3)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw = text.tobytes()
        sa, parted = S.suffix_array(text, 16)
        # Zero padding sorts like an end that comes first, but for ties of the padding itself.
        keys = [raw[i : i + 16] for i in sa]
        assert keys == sorted(keys) and sorted(sa.tolist()) == list(range(n))
        shares = S.shared_prefixes(text, sa, parted, 16)
        for k in range(1, n):
            a, b = raw[sa[k - 1] :][:16], raw[sa[k] :][:16]
            assert shares[k] == (a == b and len(a) == 16)


def test_merged_runs():
    rng = np.random.default_rng(4)
    runs = [np.unique(rng.integers(0, 200, 40).astype("S17")) for _ in range(7)]
    count = Counter(x for r in runs for x in r.tolist())
    assert S.merged_runs(runs).tolist() == sorted(x for x, k in count.items() if k > 1)
    assert len(S.merged_runs(runs[:1])) == 0


@pytest.mark.parametrize("slice_size", [S.SLICE, 2])
def test_equals_brute_force(spark, slice_size):
    rows = texts()
    table = [(i, t, "s", 1) for i, t in enumerate(rows)]
    df = spark.createDataFrame(table, "doc_id long, text string, sha string, n_bytes long").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup_substrings(df, slice_size).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_repeated_rows_null_ids_and_long_text(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300_000))
    table = [(None, "q" * 10), (1, long), (2, "y" * 250 + "tail"), (2, "y" * 250 + "tail"), (3, long[1000:1300])]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = S.dedup_substrings(df).collect()
    want = brute([t for _, t in table])
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((i, *w) for (i, _), w in zip(table, want))))


def test_pieces_of_a_very_long_text(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    offsets = np.array([0, 4000, 4100, 9000], np.int64)
    whole = S.contexts_of(data, offsets)
    monkeypatch.setattr(S, "_PLACE_BITS", 11)
    pieces = S.contexts_of(data, offsets)
    windows = lambda c: {(t, s + k) for t, s, r in zip(c[1].tolist(), c[2].tolist(), c[3].tolist()) for k in range(r)}
    assert windows(whole) == windows(pieces) == {(t, k) for t, n in ((0, 4000), (2, 4900)) for k in range(n - S.LENGTH + 1)}


def test_contexts_are_cut():
    data = np.frombuffer(b"x" * 5000 + b"ab" * 2500 + bytes(97 + (i * i * 7 + i // 3) % 26 for i in range(3000)), np.uint8)
    offsets = np.array([0, 5000, 10_000, 13_000], np.int64)
    h, text, start, runs, anchors = S.contexts_of(data, offsets, longest=700)
    assert runs.max() == 700
    places = sorted((t, s + k) for t, s, r in zip(text.tolist(), start.tolist(), runs.tolist()) for k in range(r))
    assert places == [(t, k) for t, n in ((0, 5000), (1, 5000), (2, 3000)) for k in range(n - S.LENGTH + 1)]
    assert np.array_equal(np.sort(np.unique(h)), np.sort(np.unique(S.contexts_of(data, offsets)[0])))


@pytest.mark.parametrize("slice_size", [S.SLICE, 300])
def test_periodic_texts(spark, slice_size):
    """Runs of one character, of two, and of a hundred bytes, beyond a context's bound, in texts of their own and inside others."""
    rng = np.random.default_rng(6)
    period = "".join(rng.choice(list("abcdefgh"), 100))
    own = "".join(rng.choice(list("mnopqrst"), 400))
    rows = [" " * 200_000, "=-" * 80_000, period * 1500, own + " " * 70_000 + own[:150], "é" * 70_000, own[:199] + "=-" * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup_substrings(df, slice_size).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_empty_table(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
