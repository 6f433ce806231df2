"""Byte-level BPE by corpus-level merge replay.

The distinct words of a batch (matches of the splitting pattern) are laid out symbol by symbol in
one linked list. An inverted index maps each token pair that a merge can join to the positions
where it stands. Merges are applied in rank order, each at all its positions at once; only the
pairs of touched neighbours are looked up again and join the index.

A pair is known by the rank of its joined bytes, as in rank files. If a merge makes a pair of a
lower rank than its own, that word goes on with the lower rank first, as a word-by-word encoder would.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import byte_view, spans_of, trimmed

#: Bytes of text whose distinct words are merged together.
BATCH_BYTES = 8 << 20
#: Bytes of text whose tokens are laid out at once.
OUTPUT_BYTES = 1 << 20
#: Distinct words whose tokens a Python worker keeps between batches.
CACHE_WORDS = 100_000
_NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 and number."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class MergeReplay:
    """Encoder and decoder for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # White space as Unicode defines it; this module's own also takes some control characters.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        tokens = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[t] for t in tokens], np.int64)
        lengths = np.zeros(self.size, np.int64)
        lengths[ids] = [len(t) for t in tokens]
        self.token_at = np.concatenate([[0], np.cumsum(lengths)])
        by_id = dict(zip(ids.tolist(), tokens))
        self.token_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(self.size)), np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Every way to join two tokens into one; sorted, to be found by binary search.
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.pair_keys = np.array([p for p, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.cache: dict[str, int] = {}
        self.cached_ids = np.zeros(0, np.int32)
        self.cached_at = np.zeros(1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and each word's first."""
        # A word that is a token itself stands as one symbol from the start.
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        lengths = np.array([len(w) if r < 0 else 1 for w, r in zip(words, whole.tolist())], np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        n = int(at[-1])
        single = np.zeros(n, bool)
        single[at[:-1][whole >= 0]] = True
        token = np.empty(n, np.int32)
        token[single] = whole[whole >= 0]
        token[~single] = self.byte_id[np.frombuffer(b"".join(w for w, r in zip(words, whole.tolist()) if r < 0), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[at[1:][lengths > 0] - 1] = -1
        before[at[:-1][lengths > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._rank(token[inner], token[after[inner]])

        index: dict[int, list[np.ndarray]] = {}
        agenda: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Adds positions to the inverted index under their pair's rank."""
            own = rank[places]
            places, own = places[own < _NONE], own[own < _NONE]
            if not len(places):
                return
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cut = np.flatnonzero(np.diff(own)) + 1
            heads = own[np.concatenate([[0], cut])].tolist()
            for r, part in zip(heads, np.split(places, cut) if len(cut) else [places]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(agenda, r)

        enter(inner)
        waiting: list[np.ndarray] = []
        while agenda:
            r = heapq.heappop(agenda)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[alive[p] & (rank[p] == r)]
            if not len(p):
                continue
            if len(parts) == 1:
                p = np.sort(p)
            # Of overlapping places (a run of one symbol) every other one merges, from the left.
            if len(p) > 1:
                follows = np.zeros(len(p), bool)
                follows[1:] = after[p[:-1]] == p[1:]
                if follows.any():
                    head = np.flatnonzero(~follows)
                    run = np.arange(len(p)) - head[np.cumsum(~follows) - 1]
                    p = p[run % 2 == 0]
            # One merge may make a lower pair; a word then takes its merges one at a time.
            gone = after[p]
            token[p] = r
            alive[gone] = False
            nxt = after[gone]
            after[p] = nxt
            has = nxt >= 0
            before[nxt[has]] = p[has]
            rank[p] = _NONE
            rank[p[has]] = self._rank(token[p[has]], token[nxt[has]])
            prev = before[p]
            prev = prev[prev >= 0]
            rank[prev] = self._rank(token[prev], token[after[prev]])
            touched = np.concatenate([p[has], prev])
            if len(touched) and rank[touched].min() <= r:
                waiting.append(word[touched[rank[touched] <= r]])
            enter(np.unique(touched))
        ids = token[alive].astype(np.int32)
        firsts = np.searchsorted(word[alive], np.arange(len(words) + 1))
        if waiting:
            redo = np.unique(np.concatenate(waiting))
            ids, firsts = self._stepwise(words, redo, ids, firsts)
        return ids, firsts

    def _stepwise(self, words, redo, ids, firsts):
        """Encodes anew the words in which a merge made a pair of no higher rank: always the lowest pair, leftmost first."""
        pieces = [ids[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
        table = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        for w in redo.tolist():
            pieces[w] = self._merged(self.byte_id[np.frombuffer(words[w], np.uint8)].tolist(), table)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])

    def _merged(self, parts: list[int], table: dict[int, int]) -> np.ndarray:
        """Merges of one word: pairs wait in a heap by rank and place, and the word is a list linked both ways."""
        n = len(parts)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i in range(n - 1) if (r := table.get(parts[i] * self.size + parts[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = ahead[i]
            # The place may have been merged away, or have another pair by now.
            if parts[i] < 0 or j >= n or table.get(parts[i] * self.size + parts[j]) != r:
                continue
            parts[i], parts[j] = int(r), -1
            ahead[i] = ahead[j]
            if ahead[j] < n:
                behind[ahead[j]] = i
            for k in (behind[i], i):
                if k >= 0 and ahead[k] < n and (new := table.get(parts[k] * self.size + parts[ahead[k]])) is not None:
                    heapq.heappush(waiting, (new, k))
        return np.array([p for p in parts if p >= 0], np.int32)

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text; words that are new to this encoder are merged, all at once."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.cached_ids, self.cached_at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        cache, old = self.cache, len(self.cache)
        numbers = [np.array([cache.setdefault(w, len(cache)) for w in self.split.findall(text)], np.int32) for text in texts]
        fresh = [w.encode() for w in list(cache)[old:]]
        if fresh:
            ids, firsts = self.replay(fresh)
            self.cached_at = np.concatenate([self.cached_at, self.cached_at[-1] + firsts[1:]])
            self.cached_ids = np.concatenate([self.cached_ids, ids])
        return numbers

    def tokens(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts given by their words' numbers, and each text's first."""
        ids, at = gather(self.cached_ids, self.cached_at, np.concatenate([np.zeros(0, np.int32), *numbers]))
        return ids, at[np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and each text's first."""
        return self.tokens(self.words(texts))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a row of token ids, and each token's first."""
        return gather(self.token_bytes, self.token_at, ids)


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the ranges values[at[w]:at[w + 1]] for w in which; also their starts."""
    lengths = (at[1:] - at[:-1])[which]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(starts[-1], dtype=np.int64)
    place += np.repeat(at[:-1][which] - starts[:-1], lengths)
    return values[place], starts


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every whole text and decodes it again.

    docs has doc_id and text; ranks is the content of a rank file (of fixed size, sent to the
    workers). Returns one row per input row: doc_id, the columns keep, n_tokens, ids_sha256 (of the
    ids as little-endian 32-bit numbers), decoded_sha256 (of the decoded bytes) and, with ids, the
    token ids. Null counts as empty: no token and the digest of nothing. Repeated rows give
    repeated results; a null doc_id stays null.
    """
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]
    frame = docs.select(*columns, F.col("text").alias("__text"))
    fields = [f for f in frame.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if ids else ""
    names = [f.name for f in fields] + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_codec(content, pattern)
        for batch in batches:
            data, offsets = byte_view(batch.column(batch.num_columns - 1))
            for i, j in spans_of(offsets, BATCH_BYTES):
                texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                numbers = own.words(texts)
                del texts
                # Ids and bytes are laid out for a few texts at a time.
                for p, q in spans_of(offsets[i : j + 1], OUTPUT_BYTES):
                    tokens, at = own.tokens(numbers[p:q])
                    wide = tokens.astype("<u4")
                    raw, places = own.decode(tokens)
                    ends = list(zip(at[:-1].tolist(), at[1:].tolist()))
                    arrays = [batch.column(k).slice(i + p, q - p) for k in range(batch.num_columns - 1)]
                    arrays.append(pa.array(np.diff(at), pa.int64()))
                    arrays.append(pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in ends], pa.string()))
                    arrays.append(pa.array([hashlib.sha256(raw[places[a] : places[b]]).hexdigest() for a, b in ends], pa.string()))
                    if ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return frame.mapInArrow(trimmed(run), schema)


_CODECS: dict[tuple[str, str], MergeReplay] = {}


def shared_codec(content, pattern: str) -> MergeReplay:
    """The encoder of broadcast ranks, made once in a Python worker."""
    key = (hashlib.sha256(content.value).hexdigest(), pattern)
    if key not in _CODECS:
        lines = (line.split() for line in content.value.splitlines() if line)
        _CODECS[key] = MergeReplay({base64.b64decode(a): int(b) for a, b in lines}, pattern)
    return _CODECS[key]
