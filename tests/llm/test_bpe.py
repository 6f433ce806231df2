import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm.bpe import MergeReplay, encode_documents, read_ranks

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = MergeReplay(RANKS, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "",
    "Hello world, it's 2024!  \n\n\t x",
    "aaaaaaaaaaaaaaaaaaaaaaa bbbbbb abababababab",
    "Été déjà vu — naïve œuvre 東京 😀👩‍👩‍👧 \x00\x1c \x1d\x85  x",
    "<|endoftext|> isn't special",
    "the the the " * 5000,
    "".join(chr(c) for c in range(32, 3000)),
    "=" * 3000 + "-" * 777,
]


def test_equals_reference_encoder_and_round_trips():
    ids, at = OWN.encode(TEXTS)
    raw, places = OWN.decode(ids)
    for text, a, b in zip(TEXTS, at[:-1], at[1:]):
        assert ids[a:b].tolist() == REF.encode_ordinary(text)
        assert raw[places[a] : places[b]].tobytes() == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    ids, at = OWN.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [REF.encode_ordinary(t) for t in texts]


def test_ranks_that_are_no_merge_order():
    """Made ranks in which joining a pair can give a pair of a lower rank."""
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 50, b"abc": 10, b"bcd": 20, b"abab": 5, b"aa": 60, b"aaab": 1, b"cab": 3}
    own, ref = MergeReplay(ranks, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd"), rng.integers(1, 14))) for _ in range(3000)]
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ref.encode_ordinary(t) for t in texts]


def test_documents(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "abc", None, None), (1, TEXTS[1], "x", 1), (99, None, "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens long")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    got = encode_documents(df, ranks, P.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    for r, text in ((r, {**dict(enumerate(TEXTS)), None: "abc", 99: ""}[r.doc_id]) for r in got):
        ref = REF.encode_ordinary(text)
        assert r.ids == ref and r.n_tokens == len(ref)
        assert r.ids_sha256 == hashlib.sha256(np.array(ref, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_documents(df.limit(0), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [1, 5])
def test_cache_reset_does_not_matter(size, monkeypatch):
    monkeypatch.setattr("quaestor.llm.bpe.CACHE_WORDS", size)
    own = MergeReplay(RANKS, P.PATTERN)
    for text in TEXTS[:5]:
        assert own.encode([text])[0].tolist() == REF.encode_ordinary(text)


def test_one_word_by_steps():
    """The word-by-word path against the library, over words of every kind, and one far too long for quadratic work."""
    own = MergeReplay(RANKS, P.PATTERN)
    rng = np.random.default_rng(9)
    words = ["a", "the", "aaaaaaaaaaab", "éééé", "internationalization"] + ["".join(rng.choice(list("abcdeinrst"), int(rng.integers(2, 60)))) for _ in range(200)]
    words.append("".join(rng.choice(list("einrstao"), 200_000)))
    table = dict(zip(own.pair_keys.tolist(), own.pair_ranks.tolist()))
    for w in words[:-1]:
        assert own._merged(own.byte_id[np.frombuffer(w.encode(), np.uint8)].tolist(), table).tolist() == REF.encode_ordinary(w)
    long = own._merged(own.byte_id[np.frombuffer(words[-1].encode(), np.uint8)].tolist(), table)
    assert long.tolist() == own.replay([words[-1].encode()])[0].tolist()
