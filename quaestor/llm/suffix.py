"""Suffix-array dedup: removes bytes covered by long strings that start in two places.

1. Anchors. Each window (a string of length L at one place) has one anchor: the run of K bytes with
   the smallest hash in it, the leftmost of equals. Equal windows have equal anchors at the same
   offset, so only windows whose anchor hash occurs twice can repeat. Neighbouring windows of the
   same anchor hash form a context: its windows' bytes.
2. Shards. Contexts go to shards by anchor hash. A shard builds one suffix array over its contexts
   (Larsson-Sadakane refinement: 8-byte keys, then doubling on the unresolved groups only) and
   common prefixes by Kasai's rule (a neighbour pair that both moved on by one loses one). A window
   repeats if it shares L bytes with a neighbour in the suffix array.
3. Merging. An anchor with very many contexts is cut into slices. A context itself is cut where it gets very long
   (a run of one character is all one context), so that a slice is bounded in bytes, too. A slice hands on the sorted
   digests of its distinct windows; slices are merged by binary search of one sorted run in the
   other, and windows of two slices repeat.

Equal texts are one text here, which counts how often it stands; with two copies all of it repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import U64, bucketed, byte_view, spans_of, text_key, trimmed, written
from quaestor.llm.exact import window_hashes

#: Length of a repeated string, in bytes.
LENGTH = 200
#: Bytes of an anchor; a power of two below LENGTH.
ANCHOR = 64
#: Windows of a context at most: longer ones (a run of blanks, a ruler) are cut, and count by UNIT windows.
CONTEXT = 1 << 16
UNIT = 256
#: Contexts of one anchor in a slice, about.
SLICE = 4_096
#: Bytes of contexts in one suffix array, about.
PACK_BYTES = 1 << 20
#: Text bytes of a bucket of the table of distinct texts.
BUCKET_BYTES = 24 << 20
#: Text bytes handled at once.
BLOCK = 1 << 20
_PLACE_BITS = 22
_SEPARATOR = 255  # no byte of UTF-8
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, width: int = ANCHOR, longest: int = CONTEXT):
    """Contexts of a run of texts: anchor hash, text number, first window (in the text), number of windows, number of anchors.

    A run of texts above 2**22 bytes (one very long text) is done in overlapping pieces. A context has at most longest
    windows; where it is cut, the number of anchors may count one twice.
    """
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    last = len(raw) - length
    if last < 0:
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4
    step = (1 << _PLACE_BITS) - 2 * length
    pieces = [_anchors(raw[i : i + step + length - 1], i, length, width) for i in range(0, last + 1, step)]
    place, h = (np.concatenate(x) for x in zip(*pieces))
    inside = np.zeros(len(raw) + 1, np.int32)
    long = np.diff(at) >= length
    inside[at[:-1][long]] += 1
    inside[at[1:][long] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[: last + 1]) > 0)
    own = h[windows]
    if not len(windows):
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4
    text = np.searchsorted(at, windows, "right") - 1
    new = np.ones(len(windows), bool)
    new[1:] = (own[1:] != own[:-1]) | (np.diff(windows) != 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(windows)))
    if runs.max() > longest:
        new[np.concatenate([np.arange(a, a + n, longest) for a, n in zip(first.tolist(), runs.tolist()) if n > longest])] = True
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(windows)))
    moved = np.ones(len(windows), np.int64)
    moved[1:] = new[1:] | (place[windows[1:]] != place[windows[:-1]])
    return own[first], text[first], windows[first] - at[text[first]], runs, np.add.reduceat(moved, first)


def _anchors(raw: np.ndarray, base: int, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of each window start in raw."""
    h = window_hashes(raw, width)
    mask = U64((1 << _PLACE_BITS) - 1)
    best = (h & ~mask) | np.arange(len(h), dtype=U64)
    span, step = length - width + 1, 1
    while step * 2 <= span:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if span > step:
        best = np.minimum(best[: len(best) - (span - step)], best[span - step :])
    place = (best & mask).astype(np.int64)
    return place + base, h[place]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next bytes, and how many bytes each shares with the one before at least.

    Larsson-Sadakane: positions start in groups of equal 8-byte keys; then groups of several are
    refined by the group of the position h further on, with h doubling, until depth is reached. The
    second array holds the h at which two neighbours were parted (they share h bytes, not 2 h), or
    the last h if they weren't.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = (key << U64(8)) | padded[k : n + k]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n + 1, bool)
    new[1:-1] = ordered[1:] != ordered[:-1]
    parted = np.full(n, -1, np.int32)
    parted[new[:-1]] = 0
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
    rank[n] = -1
    open_ = slots[~(new[:-1] & new[1:])]
    h = 8
    while len(open_) and h < depth:
        where = sa[open_]
        pair = (rank[where].astype(U64) << U64(32)) | (rank[np.minimum(where + h, n)] + 1).astype(U64)
        order = np.argsort(pair, kind="stable")
        where, pair = where[order], pair[order]
        sa[open_] = where
        split = np.ones(len(open_) + 1, bool)
        split[1:-1] = pair[1:] != pair[:-1]
        fresh = split[:-1] & (parted[open_] < 0)
        parted[open_[fresh]] = h
        rank[where] = np.maximum.accumulate(np.where(split[:-1], open_, 0))
        open_ = open_[~(split[:-1] & split[1:])]
        h *= 2
    parted[parted < 0] = h
    return sa, parted


def shared_prefixes(text: np.ndarray, sa: np.ndarray, parted: np.ndarray, length: int) -> np.ndarray:
    """For each suffix-array slot, whether it shares length bytes with the slot before.

    Neighbours parted early can't; of the others Kasai's rule leaves the heads of runs to compare:
    if position i and its neighbour are both one further than i - 1 and its neighbour, they share one less.
    """
    n = len(sa)
    out = np.zeros(n, bool)
    # Parted at h: they share less than 2 h bytes, and h at least.
    maybe = np.flatnonzero((parted * 2 > length) & (np.arange(n) > 0))
    if not len(maybe):
        return out
    before = np.full(n, -(1 << 40), np.int64)
    before[sa[maybe]] = sa[maybe - 1]
    places = np.sort(sa[maybe])
    head = np.ones(len(places), bool)
    head[1:] = (np.diff(places) != 1) | (before[places[1:]] != before[places[:-1]] + 1)
    heads = np.flatnonzero(head)
    behind = np.diff(np.append(heads, len(places)))
    p, q = places[heads], before[places[heads]]
    room = np.minimum(n - np.maximum(p, q), length + behind)
    shared = np.zeros(len(heads), np.int64)
    live = np.arange(len(heads))
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    while len(live):
        d = shared[live]
        same = padded[(p[live] + d)[:, None] + np.arange(16)] == padded[(q[live] + d)[:, None] + np.arange(16)]
        run = np.where(same.all(axis=1), 16, np.argmin(same, axis=1))
        shared[live] += run
        live = live[(run == 16) & (shared[live] < room[live])]
    shared = np.minimum(shared, room)
    each = np.repeat(shared, behind) - (np.arange(len(places)) - np.repeat(heads, behind))
    enough = np.zeros(n, bool)
    enough[places] = each >= length
    out[maybe] = enough[sa[maybe]]
    return out


def repeated(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For contexts laid one after another with a separator behind each: which positions start a window that repeats, and where each context starts."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(bytes([_SEPARATOR]).join(contexts) + bytes([_SEPARATOR]), np.uint8)
    sa, parted = suffix_array(text, length)
    shares = shared_prefixes(text, sa, parted, length)
    hit = shares.copy()
    hit[:-1] |= shares[1:]
    flags = np.zeros(len(text), bool)
    flags[sa[hit]] = True
    # Strings across a separator are no windows.
    inside = np.zeros(len(text) + 1, np.int32)
    long = sizes > length
    inside[at[:-1][long]] += 1
    inside[at[1:][long] - length] -= 1
    return flags & (np.cumsum(inside[:-1]) > 0), at


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Digests that stand in two or more of the sorted runs, found by binary search, run by run pairwise."""
    found = [np.zeros(0, runs[0].dtype)]
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2]):
            if len(a) < len(b):
                a, b = b, a
            place = np.searchsorted(a, b)
            hit = np.zeros(len(b), bool)
            inside = place < len(a)
            hit[inside] = a[place[inside]] == b[inside]
            found.append(b[hit])
            merged.append(np.insert(a, place[~hit], b[~hit]))
        runs = merged + (runs[-1:] if len(runs) % 2 else [])
    return np.unique(np.concatenate(found))


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Arrow and pandas functions of the stages.


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (sha, text, copies): a task sends each text once, later copies without it."""
    seen: set[bytes] = set()
    for batch in batches:
        column = batch.column(0)
        data, offsets = byte_view(column)
        shas = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        new = []
        for s in shas:
            new.append(s not in seen)
            seen.add(s)
        text = column.fill_null("") if column.null_count else column
        text = pa.compute.if_else(pa.array(new), text, pa.scalar(None, text.type))
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), text, pa.array([1] * len(shas), pa.int64())], names=["sha", "text", "copies"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, text, copies) to (sha, contexts as arrays of hash, start, windows and anchors)."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        parts = []
        for i, j in spans_of(offsets, BLOCK):
            h, text, start, runs, anchors = contexts_of(data, offsets[i : j + 1])
            at = np.searchsorted(text, np.arange(j - i + 1))
            parts.append([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in ((h.view(np.int64), pa.int64()), (start, pa.int32()), (runs, pa.int32()), (anchors, pa.int32()))])
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.concat_arrays(x) for x in zip(*parts)]], names=["sha", "h", "start", "windows", "anchors"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, uid, live: list of (h, start, windows, n)) to a row with its bytes for each live context."""
    for batch in batches:
        data, offsets = byte_view(batch.column(0))
        uid = batch.column(1).to_numpy()
        lists = batch.column(2)
        at = lists.offsets.to_numpy()
        h, start, windows, n = (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten())
        text = np.repeat(np.arange(len(uid)), np.diff(at))
        lo, hi = at[0], at[-1]
        h, start, windows, n = h[lo:hi], start[lo:hi], windows[lo:hi], n[lo:hi]
        begin = offsets[text] + start
        sizes = (windows + LENGTH - 1).astype(np.int64)
        for i, j in spans_of(np.concatenate([[0], np.cumsum(sizes)]), 8 << 20):
            contents = [data[a : a + k].tobytes() for a, k in zip(begin[i:j].tolist(), sizes[i:j].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[i:j], pa.int64()), pa.array(uid[text[i:j]], pa.int64()), pa.array(start[i:j], pa.int32()), pa.array(n[i:j], pa.int64()), pa.array(contents, pa.binary())],
                names=["h", "uid", "start", "n", "context"],
            )


_FOUND = "uid bigint, first int, last int, h bigint, part int, slice int, digests binary, uids binary, starts binary, done binary"


def _shard_rows(slice_size: int):
    """(h, n, slice, uid, start, context), sorted by h and slice, to byte ranges that repeat.

    For slices of an anchor also rows (h, part, slice) with the sorted digests of their windows, to be merged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in batches:
            # A pack ends where the (h, slice) changes.
            key = frame["h"].to_numpy(), frame["slice"].to_numpy()
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            if held and (held[-1]["h"].iloc[-1], held[-1]["slice"].iloc[-1]) != (key[0][0], key[1][0]):
                change = np.concatenate([[0], change])
            sizes = np.concatenate([[0], np.cumsum(frame["context"].str.len().to_numpy())])
            begin = 0
            for cut in change.tolist():
                if size + sizes[cut] - sizes[begin] >= PACK_BYTES:
                    held.append(frame.iloc[begin:cut])
                    yield _pack(pd.concat(held), slice_size)
                    held, size, begin = [], 0, cut
            held.append(frame.iloc[begin:])
            size += int(sizes[-1] - sizes[begin])
        if held:
            yield _pack(pd.concat(held), slice_size)

    return run


def _pack(frame: pd.DataFrame, slice_size: int) -> pd.DataFrame:
    contexts = frame["context"].tolist()
    columns = [c.split(" ")[0] for c in _FOUND.split(", ")]
    flags, at = repeated(contexts)
    uids, starts = frame["uid"].to_numpy(), frame["start"].to_numpy()
    first, last = _runs_of(flags)
    row = np.searchsorted(at, first, "right") - 1
    base = starts[row] - at[row]
    out = pd.DataFrame({"uid": uids[row], "first": first + base, "last": last + base + LENGTH - 1}).reindex(columns=columns)
    out = out.astype({c: object for c in columns[3:]}).where(out.notna(), None)
    hs, ns, slices = frame["h"].to_numpy(), frame["n"].to_numpy(), frame["slice"].to_numpy()
    more = []
    sliced = np.flatnonzero(ns > slice_size)
    for h, k in sorted(set(zip(hs[sliced].tolist(), slices[sliced].tolist()))):
        own = [c for c in sliced.tolist() if hs[c] == h and slices[c] == k]
        more += [(None, None, None, h, part, k, *blobs) for part, blobs in _digest_parts(contexts, own, at, flags, uids, starts, int(ns[own[0]]))]
    return pd.concat([out, pd.DataFrame(more, columns=columns, dtype=object)]) if more else out


def _digest_parts(contexts, own, at, flags, uids, starts, n):
    """Digests of a slice's windows, sorted, by part; of windows that repeat in the slice one each. With each its place."""
    digest, uid, start, done = [], [], [], []
    for c in own:
        windows = len(contexts[c]) - LENGTH + 1
        digest += [hashlib.md5(contexts[c][i : i + LENGTH]).digest() + b"\x01" for i in range(windows)]
        uid.append(np.full(windows, uids[c], "<i8"))
        start.append((starts[c] + np.arange(windows)).astype("<i4"))
        done.append(flags[at[c] : at[c] + windows])
    digest, uid, start, done = np.array(digest, "S17"), np.concatenate(uid), np.concatenate(start), np.concatenate(done)
    order = np.argsort(digest, kind="stable")
    digest, uid, start, done = digest[order], uid[order], start[order], done[order]
    once = np.ones(len(digest), bool)
    once[1:] = digest[1:] != digest[:-1]
    digest, uid, start, done = digest[once], uid[once], start[once], done[once]
    parts = max(1, n // 2048)
    lead = np.frombuffer(digest.tobytes(), np.uint8).reshape(-1, 17)[:, :4].astype(np.int64)
    part = (lead @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) * parts >> 32
    cut = np.searchsorted(part, np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if b > a:
            yield p, tuple(x[a:b].tobytes() for x in (digest, uid, start, done))


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """One part of a sliced anchor, a row for each slice: places whose windows stand in two slices."""
    runs = [np.frombuffer(x, "S17") for x in frame["digests"]]
    twice = merged_runs(runs)
    uid, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for run, uids, starts, done in zip(runs, frame["uids"], frame["starts"], frame["done"]):
        place = np.searchsorted(twice, run)
        hit = np.zeros(len(run), bool)
        inside = place < len(twice)
        hit[inside] = twice[place[inside]] == run[inside]
        hit &= ~np.frombuffer(done, bool)
        uid.append(np.frombuffer(uids, "<i8")[hit])
        start.append(np.frombuffer(starts, "<i4")[hit].astype(np.int64))
    uid, start = np.concatenate(uid), np.concatenate(start)
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    new = np.ones(len(uid), bool)
    new[1:] = (np.diff(uid) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(uid))[: len(first)] - 1
    return pd.DataFrame({"uid": uid[first], "first": start[first], "last": start[last] + LENGTH})


def _removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, text, ranges) to (sha, n_removed, n_spans, kept_sha256, kept)."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        lists = batch.column(2)
        at = lists.offsets.to_numpy()
        first, last = (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten())
        removed, spans, shas, kept = [], [], [], []
        for k in range(batch.num_rows):
            raw = data[offsets[k] : offsets[k + 1]]
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, first[at[k] : at[k + 1]], 1)
            np.add.at(cover, last[at[k] : at[k + 1]], -1)
            gone = np.cumsum(cover[:-1]) > 0
            rest = raw[~gone].tobytes()
            removed.append(int(gone.sum()))
            spans.append(len(_runs_of(gone)[0]))
            shas.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["sha", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (sha, text, copies, in buckets of sha) and their byte ranges that repeat elsewhere (sha, ranges).

    Ranges of a text with several copies aren't listed: all of it repeats if it has LENGTH bytes.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(8, -(-total // BUCKET_BYTES)), 100_000))
    once = docs.select("text").mapInArrow(trimmed(_once), "sha binary, text string, copies bigint")
    texts = bucketed(once.repartition(buckets, "sha").groupBy("sha").agg(F.max("text").alias("text"), F.sum("copies").alias("copies")), "texts", buckets, "sha")
    anchors = texts.select("sha", "text").mapInArrow(trimmed(_anchor_rows), "sha binary, h array<bigint>, start array<int>, windows array<int>, anchors array<int>")
    anchors = written(anchors.where(F.size("h") > 0).withColumn("uid", F.monotonically_increasing_id()), "anchors")
    units = F.ceil(F.col("windows") / UNIT).cast("long")
    counted = anchors.select(F.inline(F.arrays_zip("h", "windows", "anchors"))).groupBy("h").agg(F.sum("anchors").alias("places"), F.sum(units).alias("n"))
    live = counted.where("places > 1").select("h", "n")
    places = anchors.select("uid", F.inline(F.arrays_zip("h", "start", "windows")))
    listed = places.join(live, "h").groupBy("uid").agg(F.collect_list(F.struct("h", "start", "windows", "n")).alias("live"))
    listed = written(anchors.select("uid", "sha").join(listed, "uid"), "live_contexts")
    volume = listed.agg(F.sum(F.aggregate("live", F.lit(0).cast("long"), lambda acc, x: acc + x["windows"] + LENGTH))).first()[0] or 0
    contexts = texts.select("sha", "text").join(listed, "sha").select("text", "uid", "live").mapInArrow(trimmed(_context_rows), "h bigint, uid bigint, start int, n bigint, context binary")
    slices = F.ceil(F.col("n") / slice_size)
    contexts = contexts.withColumn("slice", F.when(F.col("n") <= slice_size, F.lit(0)).otherwise(F.pmod(F.xxhash64("uid", "start"), slices)).cast("int"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // (8 << 20))
    dealt = contexts.repartition(shards, "h", "slice").sortWithinPartitions("h", "slice")
    found = written(dealt.select("h", "n", "slice", "uid", "start", "context").mapInPandas(trimmed(_shard_rows(slice_size)), _FOUND), "found")
    across = found.where(F.col("digests").isNotNull()).groupBy("h", "part").applyInPandas(_merge, "uid bigint, first int, last int")
    ranges = found.where(F.col("digests").isNull()).select("uid", "first", "last").unionByName(across)
    by_text = ranges.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return texts, listed.select("uid", "sha").join(by_text, "uid").select("sha", "ranges")


def dedup_substrings(docs: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """Bytes of each text covered by LENGTH-byte strings that also start elsewhere.

    docs has doc_id and text; null counts as empty. Returns one row per input row: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes). Repeated rows
    are copies of each other; a null doc_id stays null; an empty table gives an empty result.
    """
    texts, ranges = repeated_ranges(docs, slice_size)
    single = texts.where(F.col("copies") == 1).select("sha", "text").join(ranges, "sha").mapInArrow(trimmed(_removed_rows), "sha binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    size = F.octet_length("text").cast("long")
    copied = texts.where((F.col("copies") > 1) & (size >= LENGTH)).select("sha", size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(_EMPTY_SHA).alias("kept_sha256"))
    done = single.unionByName(copied).withColumnRenamed("sha", "key")
    rows = docs.select("doc_id", text_key().alias("sha"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    wide = rows.join(done, rows["sha"] == done["key"], "left")
    return wide.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


#: DuckDB SQL for dedup_substrings(): all windows of all texts, counted.
SUBSTRING_SQL = """
    with d as (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as raw from documents),
    w as (select rid, i, md5(raw[i + 1:i + 200]) as h from (select rid, raw, unnest(range(0, octet_length(raw) - 199)) as i from d)),
    twice as (select h from w group by h having count(*) > 1),
    hit as (select rid, i from w semi join twice using (h)),
    step as (select *, case when i <= lag(i) over (partition by rid order by i) + 200 then 0 else 1 end as new from hit),
    run as (select *, sum(new) over (partition by rid order by i) as k from step),
    span as (select rid, k, min(i) as s, max(i) + 200 as e from run group by rid, k),
    gap as (select rid, s, e, coalesce(lag(e) over (partition by rid order by s), 0) as before, lead(s) over (partition by rid order by s) as after from span),
    part as (select rid, s, before as a, s as b, e - s as gone, 1 as n from gap
             union all select rid, e, e, octet_length(raw), 0, 0 from gap join d using (rid) where after is null),
    kept as (select rid, sum(gone) as n_removed, sum(n) as n_spans, string_agg(hex(raw[a + 1:b]), '' order by part.s, n) as rest from part join d using (rid) group by rid)
    select doc_id, cast(octet_length(raw) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
           sha256(case when rest is null then raw else unhex(rest) end) as kept_sha256
    from d left join kept using (rid)
"""
