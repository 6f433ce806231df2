import hashlib
from collections import defaultdict

import numpy as np
import pytest

from quaestor.llm import exact as E

SCHEMA = "doc_id long, text string, recipe string, kept int"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, done = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (t or "") not in done
        if kept:
            done.add(t or "")
        out.append((i, keep, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def table():
    rng = np.random.default_rng(1)
    long = ["".join(rng.choice(list("abcdefé "), 40_000)) for _ in range(2)]
    rows = [(i, f"text {i % 17} " * (i % 9)) for i in range(200)] + [(1000 + i, "hot copy") for i in range(90)]
    rows += [(300, None), (301, ""), (302, None), (None, "only null id"), (None, "text 3"), (303, "text 3"), (303, "text 3"), (303, "text 3")]
    rows += [(400, long[0]), (401, long[0] + "x"), (402, long[0]), (403, long[1]), (404, "a" * 50_000), (405, "a" * 50_000), (406, "a" * 50_001)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 3) for i, t in rows], SCHEMA)


def test_equals_brute_force(spark):
    rows = table()
    got = E.exact_groups(frame(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == brute(rows)


def test_colliding_chunk_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that knows only a chunk's length, identifiers stand for many contents."""
    rows = [(i, f"text {i % 7}") for i in range(30)] + [(50, "longer text"), (51, "longer text")]
    known = spark.createDataFrame([(i, bytearray(hashlib.sha256(t.encode()).digest()), [len(t)]) for i, t in rows], "doc_id long, sha binary, recipe array<bigint>")
    chunks = spark.createDataFrame([(len(t), bytearray(t.encode())) for t in sorted({t for _, t in rows})], "id bigint, content binary")
    monkeypatch.setattr(E, "recipes", lambda docs: known)
    monkeypatch.setattr(E, "contents_of", lambda texts: chunks)
    got = E.exact_groups(frame(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == brute(rows)


@pytest.mark.parametrize("split", [1, 3, 7])
def test_chunks_depend_on_their_text_alone(split):
    texts = [t or "" for _, t in table()]
    raw = [t.encode() for t in texts]

    def chunks(part):
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in part])]).astype(np.int64)
        data = np.frombuffer(b"".join(part), np.uint8)
        ends, first = E.cuts_of(data, offsets)
        return [(ends[a:b] - o).tolist() for a, b, o in zip(first[:-1], first[1:], offsets[:-1])]

    whole = chunks(raw)
    pieces = [c for k in range(0, len(raw), split) for c in chunks(raw[k : k + split])]
    assert whole == pieces
    for c, r in zip(whole, raw):
        assert (c[-1] if c else 0) == len(r) and all(b - a <= E.MAX_CHUNK for a, b in zip([0, *c], c))


def test_empty_table(spark):
    assert E.exact_groups(frame(spark, [])).count() == 0
