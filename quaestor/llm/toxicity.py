"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets p = sigmoid(bias + sum of weights of its words
and of their first bytes, which inflected forms share); the document gets the noisy-or 1 - prod(1 - p). Only documents are labelled: the weights are fitted to
their labels through the noisy-or, and the sentences' own scores then show where the offence is.

The fit runs on the driver over a bounded, seeded sample of labelled documents (max_docs of each
label); scoring runs over Arrow batches with the fitted weights, an array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import byte_view, give_back, range_hashes, range_sums, spans_of, trimmed, words_of, written

#: Weights are indexed by the low bits of a word's hash.
BITS = 18
#: Beginnings of words, in bytes, that have weights of their own.
PREFIXES = (4, 5, 6, 7)
#: A sentence of more words is cut into pieces of so many.
MAX_SENTENCE = 40
#: Labelled documents of each label that the fit takes at most.
MAX_DOCS = 3_000
#: Bytes of text that the fit takes at most, and those of one document; longer ones aren't learned from.
MAX_BYTES = 48 << 20
MAX_TEXT = 1 << 20
#: Words in fewer of the sampled documents get no weight.
MIN_DOCS = 4
THRESHOLD = 0.3
SEED = 7
#: Bytes of text scored at once.
CHUNK = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


@dataclass(frozen=True)
class NoisyOr:
    """Fitted weights."""

    weights: np.ndarray
    bias: float

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits, byte starts, byte ends (from offsets[0]) of the sentences, and each text's first sentence."""
        slots, first, starts, ends, at = instances(data, offsets)
        if not len(first):
            return np.zeros(0), starts, ends, at
        each = self.weights[slots].sum(axis=1, dtype=np.float64)
        return self.bias + np.add.reduceat(each, first), starts, ends, at

    def score(self, data: np.ndarray, offsets: np.ndarray):
        """Document scores in [0, 1], with the sentences' probabilities and places."""
        z, starts, ends, at = self.sentences(data, offsets)
        total = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
        return -np.expm1(-(total[at[1:]] - total[at[:-1]])), 1 / (1 + np.exp(-z)), starts, ends, at


def instances(data: np.ndarray, offsets: np.ndarray):
    """Feature slots of each word (a row of 1 + len(PREFIXES)), each sentence's first word, byte start and end, and each text's first sentence.

    A word no longer than a prefix has the slot 0 for it, which never gets a weight.
    """
    low, starts, ends, hashes, first_word = words_of(data, offsets)
    slots = np.zeros((len(starts), 1 + len(PREFIXES)), np.int64)
    mask = np.uint64((1 << BITS) - 1)
    slots[:, 0] = hashes & mask
    prefix = range_sums(low)
    for k, n in enumerate(PREFIXES, 1):
        longer = ends - starts > n
        slots[longer, k] = (range_hashes(low, starts[longer], starts[longer] + n, prefix) >> np.uint64(20)) & mask
    if not len(slots):
        none = np.zeros(0, np.int64)
        return slots, none, none, none, np.zeros(len(offsets), np.int64)
    sentence = np.cumsum(_BREAK[low])[starts]
    new = np.ones(len(slots), bool)
    new[1:] = sentence[1:] != sentence[:-1]
    inner = first_word[:-1][first_word[:-1] < len(slots)]
    new[inner] = True
    begun = np.flatnonzero(new)
    place = np.arange(len(slots)) - begun[np.cumsum(new) - 1]
    first = np.flatnonzero(place % MAX_SENTENCE == 0)
    last = np.append(first[1:], len(slots)) - 1
    return slots, first, starts[first], ends[last], np.searchsorted(first, first_word)


def fit(texts: list[str], labels: list[int], share: float | None = None, rounds: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> NoisyOr:
    """Full-batch Adam on the noisy-or likelihood; the same input gives the same weights.

    share is the part of toxic documents among all, where the sample has another: its documents
    are weighted by it, so that scores stay probabilities.
    """
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    y = np.asarray(labels, np.float64)
    size = 1 << BITS
    bias = -7.0
    if not len(y) or y.min() == y.max():
        level = -7.0 if not len(y) or y.max() == 0 else 2.0
        return NoisyOr(np.zeros(size, np.float32), level)
    in_docs = np.zeros(size, np.int64)
    # One part for each block of texts: feature slots, their sentences, the sentences' documents.
    parts, n_sentences = [], 0
    for i, j in spans_of(offsets, CHUNK):
        slots, first, _, _, at = instances(data, offsets[i : j + 1])
        own = np.searchsorted(at, np.arange(len(first)), "right") - 1
        sentence = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(slots))))
        in_docs += np.bincount(np.unique(own[sentence][:, None] * size + slots) % size, minlength=size)
        parts.append((slots.ravel().astype(np.int32), np.repeat(sentence, slots.shape[1]), own + i, n_sentences))
        n_sentences += len(first)
    # Features too rare for a weight leave the instances; what remains is indexed densely.
    in_docs[0] = 0
    known = np.flatnonzero(in_docs >= MIN_DOCS)
    dense = np.full(size, -1, np.int32)
    dense[known] = np.arange(len(known))
    for k, (column, row, docs, base) in enumerate(parts):
        column = dense[column]
        parts[k] = (column[column >= 0], row[column >= 0], docs, base)
    doc_of_sentence = np.concatenate([docs for _, _, docs, _ in parts])
    n_docs = len(y)
    part = y.mean()
    share = part if share is None else min(max(share, 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, share / part, (1 - share) / (1 - part)) / n_docs
    w = np.zeros(len(known))
    state = [np.zeros(len(known) + 1), np.zeros(len(known) + 1)]
    z = np.empty(n_sentences)
    for step in range(1, rounds + 1):
        for column, row, docs, base in parts:
            z[base : base + len(docs)] = bias + np.bincount(row, w[column], len(docs))
        risk = np.bincount(doc_of_sentence, np.logaddexp(0, z), n_docs)
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(risk, 50)), 1e-9), 1.0) * weight
        dz = slope[doc_of_sentence] / (1 + np.exp(-z))
        grad = np.append(ridge * np.sign(w), dz.sum())
        for column, row, docs, base in parts:
            grad[:-1] += np.bincount(column, dz[base : base + len(docs)][row], len(known))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        if step > rounds * 2 // 3:
            move *= 0.3
        moved = w - move[:-1]
        w = np.where(np.abs(moved) < 0.02, 0.0, moved)
        bias -= move[-1]
    weights = np.zeros(size, np.float32)
    weights[known] = w
    return NoisyOr(weights, float(bias))


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, seed: int = SEED, max_bytes: int = MAX_BYTES, max_text: int = MAX_TEXT) -> NoisyOr:
    """Fits on max_docs labelled documents of each label at most, those first by a seeded hash, and max_bytes of text in all.

    Held-out rows, null labels and null ids are never used, nor texts of more than max_text bytes. An id that repeats is one
    document, with the first of its texts. Without labels of both kinds every score is the same.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    # Ids are chosen before the texts are touched, so only the sample's texts move.
    chosen = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(max_docs) for y in (0, 1)]
    sample = written(chosen[0].unionByName(chosen[1]), "labelled")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= max_text).join(F.broadcast(sample), "doc_id")  # 2 * max_docs ids
    own = written(own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled_texts")
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy(F.lit(0)).orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = own.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= max_bytes)  # of the sample's ids only
    rows = own.join(F.broadcast(within.select("doc_id")), "doc_id").select("doc_id", "text", "toxic").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), share)
    del rows
    give_back()  # the driver goes on with other stages
    return model


def score_documents(docs: DataFrame, model: NoisyOr, spans: bool = False, keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Scores every whole text.

    docs has doc_id and text. Returns one row per input row: doc_id, the columns keep, score (0 to
    1), n_offending (sentences whose own score reaches the threshold) and, with spans,
    offending: their byte ranges and scores. A null or empty text has no sentence and scores 0; the
    doc_id may be null; repeated rows are scored alike.
    """
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]
    frame = docs.select(*columns, F.col("text").alias("__text"))
    fields = [f for f in frame.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, n_offending bigint"
    if spans:
        schema += ", offending array<struct<first:bigint,last:bigint,score:double>>"
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = NoisyOr(weights, bias)
        for batch in batches:
            data, offsets = byte_view(batch.column(batch.num_columns - 1))
            scores, counts, found = [], [], []
            for i, j in spans_of(offsets, CHUNK):
                s, p, starts, ends, at = scorer.score(data, offsets[i : j + 1])
                scores.append(s)
                bad = p >= threshold
                before = np.concatenate([[0], np.cumsum(bad)])
                counts.append(before[at[1:]] - before[at[:-1]])
                if spans:
                    base = offsets[i : j + 1] - offsets[i]
                    for d in range(j - i):
                        at_bad = at[d] + np.flatnonzero(bad[at[d] : at[d + 1]])
                        found.append([{"first": int(starts[k] - base[d]), "last": int(ends[k] - base[d]), "score": float(p[k])} for k in at_bad])
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            arrays.append(pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64()))
            arrays.append(pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64()))
            names = [f.name for f in fields] + ["score", "n_offending"]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return frame.mapInArrow(trimmed(run), schema)


def clean_documents(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score stays below the threshold.

    Null and empty texts score 0 and stay; rows that repeat, and rows without an id, are judged each. An empty table gives an empty result.
    """
    text = docs.columns.index("text")
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = NoisyOr(weights, bias)
        for batch in batches:
            data, offsets = byte_view(batch.column(text))
            scores = [scorer.score(data, offsets[i : j + 1])[0] for i, j in spans_of(offsets, CHUNK)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold if scores else np.zeros(0, bool)))

    return docs.mapInArrow(trimmed(run), docs.schema)
