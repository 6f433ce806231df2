from collections import defaultdict

import numpy as np
import pytest

from quaestor.llm import near as N
from quaestor.llm.common import words_of
from quaestor.llm.components import connected_components


def view(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def shingles(text):
    _, _, _, words, first = words_of(*view([text]))
    return N.shingles_of(words, first)[0]


def plain_similarity(a, b):
    """Full longest common subsequence, row by row."""
    row = [0] * (len(b) + 1)
    for x in a.tolist():
        prev = row[:]
        for j, y in enumerate(b.tolist(), 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    m = row[-1]
    return m / (len(a) + len(b) - m) if len(a) + len(b) else 0.0


def random_text(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))


def edited(rng, text, k):
    words = text.split(" ")
    for _ in range(k):
        at = int(rng.integers(len(words)))
        kind = rng.integers(3)
        if kind == 0:
            words[at] = "edit" + str(rng.integers(1000))
        elif kind == 1:
            words.insert(at, "more")
        elif len(words) > 1:
            del words[at]
    return " ".join(words)


def test_sketches_of_more_shingles_than_a_place_counts(monkeypatch):
    """Seeded minima by sorting, over texts that pieces cut and texts that they don't."""
    rng = np.random.default_rng(5)
    sizes = [1, 3, 5000, 2, 64, 700, 1, 1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 1 << 63, at[-1]).astype(np.uint64)
    monkeypatch.setattr(N, "_PLACE_BITS", 13)
    whole = N.sketches(h, at, N.ORDER, 0)
    monkeypatch.setattr(N, "_PLACE_BITS", 6)
    assert np.array_equal(N.sketches(h, at, N.ORDER, 0), whole)
    seed = N.mixed(np.array([4], np.uint64))
    got = N._least_of_pieces(h, at, N.ORDER, seed)
    key = N.mixed(h ^ seed)
    for t, n in enumerate(sizes):
        want = sorted(range(at[t], at[t + 1]), key=lambda i: key[i])[: N.ORDER]
        assert got[t].tolist() == want + [len(h)] * (N.ORDER - len(want))


def test_alignment_is_exact_where_it_counts():
    rng = np.random.default_rng(1)
    linked = 0
    for _ in range(300):
        a = random_text(rng, int(rng.integers(1, 120)), "ab" if rng.random() < 0.3 else "abcdefgh")
        b = edited(rng, a, int(rng.integers(0, 6)))
        x, y = shingles(a), shingles(b)
        want, got = plain_similarity(x, y), N.alignment(x, y)
        if want >= N.SIMILARITY:
            linked += 1
            assert got == pytest.approx(want)
        else:
            assert got < N.SIMILARITY
    assert linked > 60


def test_sketches_find_pairs_of_the_threshold():
    rng = np.random.default_rng(2)
    missed = pairs = 0
    for n in (6, 8, 9, 12, 20, 24, 25, 40, 120, 400):
        for _ in range(60):
            a = random_text(rng, n)
            b = edited(rng, a, int(rng.integers(1, max(2, n // 40 + 1))))
            if N.alignment(shingles(a), shingles(b)) >= N.SIMILARITY:
                pairs += 1
                x, y = N.text_sketches(*view([a, b]))
                missed += not set(x.tolist()) & set(y.tolist())
    assert pairs > 150 and missed == 0


def test_sketches_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    texts = [random_text(rng, int(n)) for n in rng.integers(0, 60, 40)] + ["", "...", "a b a b a b a b a b a b a b"]
    together = N.text_sketches(*view(texts))
    for text, row in zip(texts, together):
        assert N.text_sketches(*view([text]))[0].tolist() == row.tolist()


def brute_classes(rows):
    """Components of all pairs of the threshold, and of equal texts."""
    texts = sorted({t or "" for _, t in rows})
    own = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(own[i]) and len(own[j]) and plain_similarity(own[i], own[j]) >= N.SIMILARITY:
                root[find(i)] = find(j)
    index = {t: k for k, t in enumerate(texts)}
    groups = defaultdict(list)
    for i, t in rows:
        groups[find(index[t or ""])].append(i)
    out = []
    for i, t in rows:
        g = groups[find(index[t or ""])]
        out.append((i, min((x for x in g if x is not None), default=None), len(g)))
    return out


def table():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(6):
        base = random_text(rng, int(rng.integers(30, 70)))
        rows.append(base)
        rows += [edited(rng, base, int(rng.integers(1, 3))) for _ in range(6)]
    chain = random_text(rng, 60)
    for _ in range(8):
        rows.append(chain)
        chain = edited(rng, chain, 1)
    rows += [random_text(rng, 40) for _ in range(15)] + ["the same five words only", "The same, five words ONLY!", "one two", "one two", "", "..."]
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, None), (3, rows[3]), (500, "lonely null id"), (600, "w " * 30000)]


def test_classes_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sha string, class_id int").repartition(4)
    small = [r for r in rows if len(r[1] or "") < 5000]
    got = [tuple(r) for r in N.near_duplicates(df).collect() if r.doc_id != 600]
    assert sorted(map(str, got)) == sorted(map(str, brute_classes(small)))
    kept = N.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, c, _ in brute_classes(small)} | {600})


def crowd():
    """One bucket of many texts that are no near copies of each other: a long common part, and edits all over."""
    rng = np.random.default_rng(11)
    base = random_text(rng, 90)
    rows = [base] + [edited(rng, base, int(rng.integers(1, 9))) for _ in range(70)]
    page = random_text(rng, 50)
    rows += [f"{page} {random_text(rng, int(rng.integers(8, 25)))}" for _ in range(40)]
    # Texts of the same parts in another order, some of them near each other.
    parts = [random_text(rng, 14) for _ in range(6)]
    for _ in range(12):
        text = " ".join(parts[k] for k in rng.permutation(6))
        rows += [text, edited(rng, text, 1)]
    return list(enumerate(rows))


@pytest.mark.parametrize("meet_bytes", [1 << 12, 3 << 12])
def test_groups_larger_than_a_block(spark, monkeypatch, meet_bytes):
    monkeypatch.setattr(N, "MEET_BYTES", meet_bytes)
    monkeypatch.setattr(N, "TEXT_BYTES", 256)
    rows = crowd()
    sizes, parted = [], N._parted
    monkeypatch.setattr(N, "_parted", lambda *x: sizes.append(1) or parted(*x))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in N.near_duplicates(df).collect()]
    assert sorted(got) == sorted(brute_classes(rows)) and sizes


def test_near_pairs_name_a_difference_in_common():
    """Every near pair of a group, of different classes, names a common shingle, whatever text leads."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    pairs = 0
    for trial in range(12):
        texts = [t for _, t in crowd()[: 71 + 40 * (trial % 2)]]
        texts = [texts[k] for k in rng.choice(len(texts), 40, replace=False)]
        words = []
        for t in texts:
            words.append(words_of(*view([t]))[3].astype("<u8").tobytes())
        seqs = [shingles(t) for t in texts]
        lead = int(rng.integers(len(texts)))
        far = [plain_similarity(s, seqs[lead]) < N.SIMILARITY for s in seqs]
        n = len(texts)
        columns = [pa.array([1] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([lead] * n, pa.int64()), pa.array(far), pa.array(words, pa.binary()), pa.array([words[lead]] * n, pa.binary())]
        batch = pa.RecordBatch.from_arrays(columns, names=list("guLfxy"))
        named = [set(x) for x in next(N._difference_rows(N.SIMILARITY)(iter([batch]))).column(2).to_pylist()]
        for i in range(n):
            for j in range(i):
                if (far[i] or far[j]) and plain_similarity(seqs[i], seqs[j]) >= N.SIMILARITY:
                    pairs += 1
                    assert named[i] & named[j]
    assert pairs > 20


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in list(root)}
    assert len(got) == len(root)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0 and N.without_near_duplicates(df).count() == 0
