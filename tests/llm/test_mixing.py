from collections import defaultdict

import pytest

from quaestor.llm.mixing import MAX_EPOCHS, mix, mixed_documents, sainte_lague, source_targets

SCHEMA = "doc_id long, text string, source string, size long, shard long, quota long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], SCHEMA)


def fill(sizes, weights, cap):
    """Water filling by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 7, None: 50}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 0}, {"a": 100, "b": 2, "c": 3, "d": 4, "e": 90}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes, (1, 2, 3), MAX_EPOCHS))


@pytest.mark.parametrize("votes,seats", [([53, 24, 23], 7), ([1, 1, 1, 1], 6), ([1000, 1, 1], 3), ([0, 5, 9], 4), ([340, 280, 160, 60, 15], 97)])
def test_highest_quotients(spark, votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "p long, votes long, seats long")
    got = {r.p: r.n_seats for r in sainte_lague(df, [], ["p"], "votes", "seats").collect()}
    assert [got[i] for i in range(len(votes))] == won


def test_mix_of_hard_rows(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), f"s{i % 4}") for i in range(1500)]
    rows += [(5000, None, None), (5001, "", "s1"), (5002, "\t \n", "s1"), (None, "a b c", "s2"), (7, "w " * 7, "s3"), (6000, "long " * 20000, None)]
    got = mix(rows_of(spark, rows)).collect()
    again = mix(rows_of(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= MAX_EPOCHS * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    assert {r.doc_id: r.size for r in got}[5002] == 0


def tiny(hot):
    """Sources of 1 to 60 words, some in several documents, with or without a large one."""
    rows = [(100 * n + k, " ".join(f"w{n}x{i}" for i in range(k, n, 3)), f"t{n:02}") for n in range(1, 61) for k in range(3)]
    return rows + [(10_000 + i, "hot " * 50, "zz") for i in range(400 if hot else 0)]


@pytest.mark.parametrize("hot", [True, False])
def test_tiny_sources_reach_their_targets(spark, hot):
    got = mix(rows_of(spark, tiny(hot))).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        assert 0 <= r.taken <= MAX_EPOCHS * r.size
        key = r.source_size
        taken[key] += r.taken
        target[key], size[key] = r.target, r.source_size
    assert len(target) == 60 + hot
    for s in target:
        assert abs(taken[s] - target[s]) <= (0.5 if s <= 60 else 0.01 * target[s])
    if hot:
        assert all(taken[n] == 3 * n for n in range(1, 61))


def test_tables_of_few_words(spark):
    for n in (1, 5, 15):
        docs = rows_of(spark, [(1, " ".join(f"w{i}" for i in range(n)), "a"), (2, None, "a"), (3, "", "b")])
        assert [r.text.split() for r in mixed_documents(docs).collect()] == [[f"w{i}" for i in range(n)]]


def test_tiny_documents_follow_the_plan(spark):
    docs = rows_of(spark, tiny(False))
    plan = {r.doc_id: r.taken for r in mix(docs).collect()}
    words = defaultdict(int)
    for r in mixed_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {k: v for k, v in plan.items() if v}


def test_documents_follow_the_plan(spark):
    rows = [(i, f"a{i}  b{i}\n" * (i % 40 + 1), "abc"[i % 3]) for i in range(200)]
    docs = rows_of(spark, rows)
    plan = {r.doc_id: r.taken for r in mix(docs).collect()}
    words = defaultdict(int)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {k: v for k, v in plan.items() if v}


def test_empty_table(spark):
    assert mix(rows_of(spark, [])).count() == 0


def test_documents_with_odd_columns_and_repeated_rows(spark):
    """Clashing and dotted names stay; rows repeated with one id are each mixed; what is taken is what the plan says."""
    rows = [(1, "a b c " * 300, "x", 1, 2, 3)] * 3 + [(2, "d e f " * 300, None, 1, 2, 3), (None, "g h " * 200, "x", 4, 5, 6), (3, None, "x", 7, 8, 9), (4, "", "x", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, `size.of` int, blocks int").repartition(3)
    got = mixed_documents(df)
    assert got.columns == df.columns
    taken = {}
    for r in got.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        assert (r["row"], r["size.of"], r["blocks"]) == ((4, 5, 6) if r.doc_id is None else (1, 2, 3))
    want = {}
    for r in mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v}
    assert mixed_documents(df.limit(0)).count() == 0
