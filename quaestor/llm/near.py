"""Near-duplicate texts by Order MinHash and banded alignment.

Texts are sequences of shingles of five words. For each seed, the ORDER shingles with the smallest
hashes (a repeated shingle counts by its occurrence, too) are put in text order; their sequence is
one sketch. Two texts share a sketch only if the same shingles stand in the same order, so sketches
follow edit similarity. Texts that share a sketch are candidates; a banded alignment of their shingles
(longest common subsequence within the band that the threshold allows) verifies them.

Classes are the connected components of verified pairs. A bucket is led by its most central text, the
one that shares most sketches. First each text is aligned with its most central leader, which joins
most of a group of copies with one comparison a text. The texts that a leader led to, and that aren't
in its class, then meet all its texts in a block: shingles in common are counted exactly, on bits for
the leader's shingles and by sorted search for others, and only pairs of different classes that share
enough are aligned. So every pair of a bucket is in one class, or aligned, or known to share too few
shingles; no pair is written but the verified ones.

A group too large for a block is refined first. Against its leader L each text x has a difference: the
shingles that only one of the two has. Two texts are as far apart as their differences are, so a text that
is far from L can only be near one whose difference shares a shingle with its own, and the further it is, the
more of them. Each text therefore names the first shingles of its difference, as many as make sure
that near pairs name one in common, and the texts that name one shingle are a group of their own. This is
repeated with the new groups' own leaders until groups fit a block; a group that no longer shrinks is
met in several blocks. A common part of many pages is in their leader, too, and so brings no two together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import U64, byte_view, mixed, spans_of, text_key, trimmed, words_of, written
from quaestor.llm.components import connected_components

#: Words of a shingle, and the similarity from which texts are near duplicates.
SHINGLE = 5
SIMILARITY = 0.8
#: Sketches of a text and shingles in each. At similarity 0.8 a pair shares none of them once in about 300,000.
SKETCHES = 24
ORDER = 4
#: Texts of so few shingles also get sketches of fewer.
SHORT, SHORT_ORDER = 20, 2
SEED = 99
BLOCK = 1 << 20
#: Bytes of word hashes of one side of a block in which a group's texts meet; a text counts as TEXT_BYTES at least.
MEET_BYTES = 8 << 20
TEXT_BYTES = 8 << 10
_PLACE_BITS = 24


def shingles_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a run of texts, and each text's first. A text of fewer words is one shingle; one without words has none."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    start = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    end = first[1:][text]
    padded = np.concatenate([words, np.zeros(SHINGLE, U64)])
    h = np.zeros(at[-1], U64)
    for k in range(SHINGLE):
        inside = start + k < end
        h = h * U64(0x9E3779B97F4A7C15) + np.where(inside, padded[np.minimum(start + k, len(words))] | U64(1), U64(0))
    return mixed(h), at


def labelled(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes that also tell the occurrence of a shingle in its text: first, second, ..."""
    if not len(h):
        return h
    text = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(U64)
    key = h ^ mixed(text + U64(1))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return h
    begun = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = np.zeros(len(h), U64)
    occurrence[order] = (np.arange(len(h)) - begun).astype(U64)
    return np.where(occurrence == 0, h, mixed(h + occurrence * U64(0xD6E8FEB86659FD93)))


def _least(h: np.ndarray, at: np.ndarray, order: int, seed: np.ndarray) -> np.ndarray:
    """Places of each text's shingles with the smallest seeded hashes, len(h) where there are no more; equal hashes go by place.

    Places stand in the low bits of the keys, so h has 2**_PLACE_BITS shingles at most.
    """
    n, texts = len(h), len(at) - 1
    mask = U64((1 << _PLACE_BITS) - 1)
    full = ~U64(0)
    key = (mixed(h ^ seed) & ~mask) | np.arange(n, dtype=U64)
    chosen = np.full((texts, order), n, np.int64)
    for r in range(order):
        least = np.minimum.reduceat(key, at[:-1])
        there = least != full
        place = (least & mask).astype(np.int64)
        chosen[there, r] = place[there]
        key[place[there]] = full
    return chosen


def _least_of_pieces(h: np.ndarray, at: np.ndarray, order: int, seed: np.ndarray) -> np.ndarray:
    """As _least() for any number of shingles: the smallest of each piece are merged."""
    n, step = len(h), 1 << _PLACE_BITS
    if n <= step:
        return _least(h, at, order, seed)
    texts, places = [], []
    for p in range(0, n, step):
        q = min(p + step, n)
        i, j = int(np.searchsorted(at, p, "right")) - 1, int(np.searchsorted(at, q, "left"))
        chosen = _least(h[p:q], np.clip(at[i : j + 1], p, q) - p, order, seed)
        text, r = np.nonzero(chosen < q - p)
        texts.append(text + i)
        places.append(chosen[text, r] + p)
    text, place = np.concatenate(texts), np.concatenate(places)
    by = np.lexsort((place, mixed(h[place] ^ seed) & ~U64(step - 1), text))
    text, place = text[by], place[by]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    first = rank < order
    out = np.full((len(at) - 1, order), n, np.int64)
    out[text[first], rank[first]] = place[first]
    return out


def sketches(h: np.ndarray, at: np.ndarray, order: int, salt: int) -> np.ndarray:
    """Order MinHash: a row of SKETCHES values for each text; texts must have a shingle each."""
    n, texts = len(h), len(at) - 1
    out = np.zeros((texts, SKETCHES), U64)
    padded = np.concatenate([h, np.zeros(1, U64)])
    for k in range(SKETCHES):
        chosen = _least_of_pieces(h, at, order, mixed(np.array([salt * 1000 + k + SEED], U64)))
        chosen.sort(axis=1)
        value = np.full(texts, U64(k + 1 + 100 * salt))
        for r in range(order):
            value = mixed(value * U64(0x9E3779B97F4A7C15) + padded[chosen[:, r]] + (chosen[:, r] < n))
        out[:, k] = value
    return out


def text_sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sketch values of each text of a run."""
    _, _, _, words, first = words_of(data, offsets)
    h, at = shingles_of(words, first)
    h = labelled(h, at)
    count = np.diff(at)
    out = [np.zeros(0, np.int64)] * len(count)
    has = np.flatnonzero(count > 0)
    if len(has):
        long = sketches(h, np.append(at[has], len(h)), ORDER, 0).view(np.int64)
        for t, row in zip(has.tolist(), long):
            out[t] = row
        small = np.flatnonzero((count > 0) & (count <= SHORT))
        if len(small):
            own = np.concatenate([h[at[t] : at[t + 1]] for t in small])
            short = sketches(own, np.concatenate([[0], np.cumsum(count[small])]), SHORT_ORDER, 1).view(np.int64)
            for t, row in zip(small.tolist(), short):
                out[t] = np.concatenate([out[t], row])
    return out


def _shingle_ids(words: np.ndarray) -> np.ndarray:
    return shingles_of(words.astype(U64), np.array([0, len(words)]))[0]


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences: aligned shingles / (all shingles - aligned).

    The alignment is a longest common subsequence within the band |i - j| that a similarity of
    threshold leaves room for. Below the threshold the value is a bound, itself below it.
    """
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = threshold / (1 + threshold) * n
    if min(len(a), len(b)) < need - 1e-9:
        return min(len(a), len(b)) / max(len(a), len(b))
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    aligned = head + tail
    if len(a) and len(b):
        # Shingles in common, order aside, bound what can be aligned.
        (x, many), (y, more) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        place = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int(np.minimum(many, more[place])[y[place] == x].sum())
        if aligned + common < need - 1e-9:
            return (aligned + common) / (n - aligned - common)
        band = int(n - 2 * need + 1e-9) + 1
        where: dict[int, list[int]] = {}
        for j, v in enumerate(b.tolist()):
            where.setdefault(v, []).append(j)
        ends: list[int] = []
        for i, v in enumerate(a.tolist()):
            for j in reversed(where.get(v, ())):
                if abs(i - j) <= band:
                    k = bisect_left(ends, j)
                    ends[k : k + 1] = [j]
        aligned += len(ends)
    return aligned / (n - aligned)


# Arrow functions of the stages.


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (sha, sketch); a task does each text once."""
    seen: set[bytes] = set()
    for batch in batches:
        data, offsets = byte_view(batch.column(0))
        shas, rows = [], []
        for i, j in spans_of(offsets, BLOCK):
            own = offsets[i : j + 1]
            names = [hashlib.sha256(data[a:b]).digest() for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
            for name, row in zip(names, text_sketches(data, own)):
                if name not in seen:
                    seen.add(name)
                    shas.append(name)
                    rows.append(row)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], names=["sha", "sketch"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (sha, words as 64-bit hashes); a task sends each text once."""
    seen: set[bytes] = set()
    for batch in batches:
        data, offsets = byte_view(batch.column(0))
        for i, j in spans_of(offsets, BLOCK):
            own = offsets[i : j + 1]
            _, _, _, words, first = words_of(data, own)
            shas, rows = [], []
            for k, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist())):
                name = hashlib.sha256(data[a:b]).digest()
                if name not in seen:
                    seen.add(name)
                    shas.append(name)
                    rows.append(words[first[k] : first[k + 1]].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(rows, pa.binary())], names=["sha", "words"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, words of a, words of b) to the pairs that reach the threshold."""
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            known, name = None, None
            for k in range(batch.num_rows):
                x, y = np.frombuffer(left[k].as_buffer(), "<u8"), np.frombuffer(right[k].as_buffer(), "<u8")
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - SHINGLE:
                    good.append(False)
                    continue
                if name != batch.column(0)[k].as_py():
                    known, name = _shingle_ids(x), batch.column(0)[k].as_py()
                good.append(alignment(known, _shingle_ids(y), threshold) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _meet(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Verified pairs of one block: texts outside the leader's class (side 1) with any of the leader's texts (side 2)."""
        roles = frame["side"].to_numpy()
        words = [np.frombuffer(w, "<u8") for w in frame["words"]]
        seqs = [_shingle_ids(w) for w in words]
        sets = [np.sort(labelled(s, np.array([0, len(s)]))) for s in seqs]
        uid, root = frame["uid"].to_numpy(), frame["root"].to_numpy()
        lead = sets[int(np.flatnonzero(roles == 0)[0])]
        left, right = np.flatnonzero(roles == 1), np.flatnonzero(roles == 2)
        bits = np.zeros((len(frame), -(-max(len(lead), 1) // 64) * 8), np.uint8)
        other: list[np.ndarray] = []
        for k, own in enumerate(sets):
            place = np.minimum(np.searchsorted(lead, own), max(len(lead) - 1, 0))
            held = lead[place] == own if len(lead) else np.zeros(len(own), bool)
            flags = np.zeros(bits.shape[1] * 8, bool)
            flags[place[held]] = True
            bits[k] = np.packbits(flags)
            other.append(own[~held])
        lanes = bits.view(np.uint64)
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(right)), [len(other[k]) for k in right])
        pool = np.concatenate([np.zeros(0, U64), *[other[k] for k in right]])
        order = np.argsort(pool, kind="stable")
        pool, owner = pool[order], owner[order]
        joined: dict[int, int] = {}

        def find(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        found = []
        for k in left.tolist():
            common = np.bitwise_count(lanes[k] & lanes[right]).sum(axis=1, dtype=np.int64)
            a, b = np.searchsorted(pool, other[k], "left"), np.searchsorted(pool, other[k], "right")
            for x, y in zip(a[b > a].tolist(), b[b > a].tolist()):
                common += np.bincount(owner[x:y], minlength=len(right))
            enough = common >= threshold / (1 + threshold) * (size[k] + size[right]) - 1e-9
            for m in right[enough & (root[right] != root[k])].tolist():
                x, y = find(int(root[k])), find(int(root[m]))
                if x != y and alignment(seqs[k], seqs[m], threshold) >= threshold - 1e-12:
                    joined[max(x, y)] = min(x, y)
                    found.append((min(uid[k], uid[m]), max(uid[k], uid[m])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _difference_rows(threshold: float):
    """(group, uid, leader, far, words, words of the leader) to (group, uid, tokens): what each text names of its difference to the leader.

    With K = (1 - t) / (1 + t) texts x and y are near as sets if they differ in K (|x| + |y|) shingles at most. If x differs from
    the leader L in d > K (|x| + |L|), the differences of x and of a near y share a shingle, and at least d - K (|x| + |y|), where
    |y| is |x| / t at most. If y itself is near L, they share more than (d_y + K (|L| - |y|)) / 2. So the first d - (what is
    shared at least) + 1 shingles of a difference, in one order for all, hold one that both name. A text of another
    class that is near L as a set, only in another order, names all, and the token 0 besides, as all texts do that are near L.
    """
    narrow = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, name = np.zeros(0, U64), None
        for batch in batches:
            leader, far = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for k in range(batch.num_rows):
                if name != leader[k]:
                    lead, name = _shingle_set(batch.column(5)[k]), leader[k]
                own = _shingle_set(batch.column(4)[k])
                # Shingles of its own first: those that it lacks are more often others' lack, too.
                more, less = np.setdiff1d(own, lead, True), np.setdiff1d(lead, own, True)
                tokens = np.concatenate([more, mixed(less ^ U64(0x9E3779B97F4A7C15))])
                d = len(tokens)
                if d > narrow * (len(own) + len(lead)) + 1e-9:
                    shared, near = int(np.ceil(d - narrow * (1 + 1 / threshold) * len(own) - 1e-9)), False
                elif far[k]:
                    shared, near = 1, True
                else:
                    shared, near = int(np.floor((d + narrow * (len(lead) - len(own))) / 2 - 1e-9)) + 1, True
                tokens = tokens[: max(d - max(shared, 1) + 1, 0)]
                rows.append(np.append(tokens, U64(0)) if near else tokens)
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))], names=["group", "uid", "tokens"])

    return run


def _shingle_set(words) -> np.ndarray:
    """Sorted shingles of a text's words, repeated ones by occurrence."""
    ids = _shingle_ids(np.frombuffer(words.as_buffer(), "<u8"))
    return np.sort(labelled(ids, np.array([0, len(ids)])))


def near_links(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Distinct texts in candidate buckets (uid, sha), and the components of verified pairs (node, root)."""
    sketched = docs.select("text").mapInArrow(trimmed(_sketch_rows), "sha binary, sketch array<bigint>")
    sketched = sketched.groupBy("sha").agg(F.first("sketch").alias("sketch"))
    sketched = written(sketched.withColumn("uid", F.monotonically_increasing_id()), "sketches")
    entries = sketched.select("uid", F.explode(F.array_distinct("sketch")).alias("v"))
    shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(entries.join(shared, "v"), "buckets")
    central = buckets.groupBy("uid").agg(F.sum("n").alias("central"))
    live = written(sketched.select("uid", "sha").join(central, "uid"), "candidates")
    words = docs.select("text").mapInArrow(trimmed(_word_rows), "sha binary, words binary")
    words = words.join(live.select("sha", "uid").hint("shuffle_hash"), "sha").groupBy("uid").agg(F.max("words").alias("words"))
    words = written(words, "candidate_words")
    ranked = buckets.select("v", "uid").join(live.select("uid", "central"), "uid")
    leaders = ranked.groupBy("v").agg(F.max(F.struct("central", (-F.col("uid")).alias("minus"))).alias("top"))
    led = buckets.select("v", "uid").join(leaders, "v").groupBy("uid", "top").agg(F.count(F.lit(1)).alias("n"))
    led = written(led.select("uid", (-F.col("top.minus")).alias("leader"), F.col("top.central").alias("central")), "led")

    # Each text with its most central leader.
    best = led.groupBy("uid").agg(F.max(F.struct("central", (-F.col("leader")).alias("minus"))).alias("top"))
    pairs = best.select((-F.col("top.minus")).alias("a"), F.col("uid").alias("b")).where("a <> b")
    sides = pairs.join(words.select(F.col("uid").alias("a"), F.col("words").alias("x")), "a")
    sides = sides.join(words.select(F.col("uid").alias("b"), F.col("words").alias("y")), "b")
    links = written(sides.select("a", "b", "x", "y").mapInArrow(trimmed(_verified(threshold)), "a bigint, b bigint"), "verified")
    roots = connected_components(links)

    # Then a leader's texts outside its class with all its texts.
    known = live.select("uid", "central").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "central", F.coalesce("root", "uid").alias("root"))
    weight = F.greatest(F.octet_length("words").cast("long"), F.lit(TEXT_BYTES))
    known = written(known.join(words.select("uid", weight.alias("weight")), "uid"), "known")
    groups = led.select(F.col("leader").alias("group"), "leader", "uid").join(known, "uid")
    met = _all_met(groups, known, words, threshold)
    if not met.isEmpty():
        roots = connected_components(links.unionByName(met))
    return live, roots


def _all_met(groups: DataFrame, known: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (a, b) of different classes among the texts of each group.

    groups: group, leader, uid, central, root, weight. Of pairs that would join the same two classes in a block one is enough.
    """
    pairs, size = None, None
    while True:
        own = known.select(F.col("uid").alias("leader"), F.col("root").alias("leader_root"))
        placed = written(groups.join(own, "leader"), "placed")
        outside = F.col("root") != F.col("leader_root")
        sums = placed.groupBy("group", "leader").agg(F.sum(F.when(outside, F.col("weight"))).alias("out"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("n"))
        sums = sums.where(F.col("out").isNotNull()).select("group", "leader", "n", *[F.ceil(F.col(c) / MEET_BYTES).cast("int").alias(f"n_{c}") for c in ("out", "all")])
        # A group that its parent's leader didn't part is met as it is.
        large = F.col("n_all") > 1 if size is None else (F.col("n_all") > 1) & (F.col("n") * 2 <= F.col("parent"))
        sums = written(sums if size is None else sums.join(size, "group"), "group_sizes")
        found = written(_meetings(placed, sums.where(~large), words, threshold), "met")
        pairs = found if pairs is None else pairs.unionByName(found)
        large = sums.where(large)
        if large.isEmpty():
            return pairs
        groups, size = _parted(placed.join(large.select("group", "n"), "group"), words, threshold)


def _meetings(placed: DataFrame, sums: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Texts outside the leader's class (side 1) and all texts (side 2) of each group, in blocks of both."""
    open_ = placed.join(sums.drop("leader"), "group")
    outside = F.col("root") != F.col("leader_root")
    own = F.pmod(F.xxhash64("uid"), F.col("n_out")).cast("int"), F.pmod(F.xxhash64("uid"), F.col("n_all")).cast("int")
    rest = F.sequence(F.lit(0), F.col("n_all") - 1), F.sequence(F.lit(0), F.col("n_out") - 1)
    first = open_.where(outside).select("group", "uid", "root", F.lit(1).alias("side"), own[0].alias("i"), F.explode(rest[0]).alias("j"))
    second = open_.select("group", "uid", "root", F.lit(2).alias("side"), F.explode(rest[1]).alias("i"), own[1].alias("j"))
    heads = sums.select("group", F.col("leader").alias("uid"), F.lit(-1).cast("long").alias("root"), F.lit(0).alias("side"), F.explode(rest[1]).alias("i"), "n_all")
    heads = heads.select("group", "uid", "root", "side", "i", F.explode(rest[0]).alias("j"))
    blocks = first.unionByName(second).unionByName(heads).join(words, "uid")
    return blocks.groupBy("group", "i", "j").applyInPandas(_meet(threshold), "a bigint, b bigint")


def _parted(placed: DataFrame, words: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Groups of the texts that name a shingle in common, and of each the size of the group that it comes from (group, parent).

    Groups of one class, or of the same texts as another of their parent, are left out. The leader is the most central text.
    """
    sides = placed.join(words.select("uid", F.col("words").alias("x")), "uid").join(words.select(F.col("uid").alias("leader"), F.col("words").alias("y")), "leader")
    far = F.col("root") != F.col("leader_root")
    named = sides.select("group", "uid", "leader", far.alias("far"), "x", "y").mapInArrow(trimmed(_difference_rows(threshold)), "group bigint, uid bigint, tokens array<bigint>")
    named = named.select("group", "uid", F.explode("tokens").alias("token"))
    members = written(named.join(placed.select("group", "uid", "central", "root", "weight", "n"), ["group", "uid"]), "named")
    same = F.sum(F.xxhash64("uid").cast("decimal(38,0)"))
    buckets = members.groupBy("group", "token").agg(
        F.count(F.lit(1)).alias("many"), F.min("root").alias("low"), F.max("root").alias("high"), same.alias("same"), F.max(F.struct("central", (-F.col("uid")).alias("minus"))).alias("top"), F.first("n").alias("parent")
    )
    buckets = buckets.where("many > 1 and low <> high")
    buckets = buckets.groupBy("group", "many", "same").agg(F.min_by(F.struct("token", "top", "parent"), "token").alias("x"))
    buckets = buckets.select("group", "x.token", (-F.col("x.top.minus")).alias("leader"), "x.parent", F.xxhash64("group", "x.token").alias("next"))
    buckets = written(buckets, "parted")
    groups = members.drop("n").join(buckets.drop("parent"), ["group", "token"]).select(F.col("next").alias("group"), "leader", "uid", "central", "root", "weight")
    return groups, buckets.select(F.col("next").alias("group"), "parent")


def near_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Class of each distinct text that has a near duplicate: sha, class_sha (one of the class)."""
    live, roots = near_links(docs, threshold)
    named = roots.join(live.withColumnRenamed("uid", "node"), "node")
    return written(named.join(live.select(F.col("uid").alias("root"), F.col("sha").alias("class_sha")), "root").select("sha", "class_sha"), "classes")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Near-duplicate classes of texts.

    docs has doc_id and text; null counts as empty. Returns one row per input row: doc_id, class_id
    (the class's smallest doc_id), class_size (rows). Equal texts are always one class; texts
    without words are near no other text. Repeated rows count each; ids may be null (a class
    of null ids has a null class_id). An empty table gives an empty result.
    """
    classes = near_classes(docs, threshold)
    rows = docs.select("doc_id", text_key().alias("sha"))
    wide = rows.join(classes, "sha", "left").select("doc_id", F.coalesce("class_sha", "sha").alias("class_sha"))
    groups = wide.groupBy("class_sha").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # Written, so that the join has an exchange of its own, whose hot classes AQE splits.
    groups = written(groups, "class_sizes")
    return wide.join(groups, "class_sha").select("doc_id", "class_id", "class_size")


def without_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class stays: the one with the smallest doc_id (null last). The columns are those of docs.

    Null texts count as empty and equal texts as one class, so one row stays of all that are empty and one of rows that repeat.
    An empty table gives an empty result.
    """
    classes = near_classes(docs, threshold)
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), text_key().alias("sha"))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("sha"))
    narrow = docs.select(F.col("doc_id").alias("id"), text_key().alias("sha")).join(classes, "sha", "left")
    best = narrow.groupBy(F.coalesce("class_sha", "sha").alias("c")).agg(F.min(rank).alias("best"))
    best = best.select(F.col("best.sha").alias("sha"), F.col("best.id").alias("best_id"))
    kept = keyed.join(best, "sha").where(F.col("id").eqNullSafe(F.col("best_id")))
    twin = F.row_number().over(Window.partitionBy("sha").orderBy(F.lit(0)))
    return kept.withColumn("twin", twin).where("twin = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
