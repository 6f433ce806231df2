"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, and becomes its recipe: the ordered
list of its chunks' identifiers. Recipes are compared, not texts. Only documents that share their
whole recipe with another send their chunks, once, to be verified: an identifier that stands for
one content is kept, one that stands for several gives way to the text's SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import BASE, U64, WRAP, byte_view, mixed, range_hashes, spans_of, text_key, trimmed, written

#: Bytes of the rolling window.
WINDOW = 32
#: A cut falls where this many bits of the rolling hash are 0: chunks of 1 KiB on average.
CUT_BITS = 10
#: A longer chunk is cut at every so many bytes.
MAX_CHUNK = 8_192
#: Bytes hashed at once.
BLOCK = 1 << 20


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width bytes (a power of two), by doubling."""
    h, base, step = data.astype(U64) + U64(1), BASE, 1
    while step < width:
        h = h[:-step] * U64(base) + h[step:]
        base, step = base * base % WRAP, step * 2
    return mixed(h)


def cuts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of a run of texts, from offsets[0], and each text's first chunk. An empty text has no chunk."""
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) >= WINDOW:
        ends = np.flatnonzero(window_hashes(raw, WINDOW) >> U64(64 - CUT_BITS) == 0) + WINDOW
        # A window must lie in one text.
        ends = ends[at[np.searchsorted(at, ends, "left") - 1] <= ends - WINDOW]
        cut[ends] = True
    cut[at] = True
    cut[0] = False
    ends = np.flatnonzero(cut)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    more = (ends - starts - 1) // MAX_CHUNK
    if more.any():
        rows = np.flatnonzero(more > 0)
        extra = np.concatenate([starts[k] + MAX_CHUNK * np.arange(1, more[k] + 1) for k in rows])
        ends = np.sort(np.concatenate([ends, extra]))
    return ends, np.searchsorted(ends, at, "right")


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, text_sha256, recipe)."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        shas, lists = [], []
        for i, j in spans_of(offsets, BLOCK):
            own = offsets[i : j + 1]
            ends, first = cuts_of(data, own)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            ids = range_hashes(data[own[0] : own[-1]], starts, ends).view(np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int64())))
            shas += [hashlib.sha256(data[a:b]).digest() for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
        recipe = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), recipe], names=["doc_id", "sha", "recipe"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to its chunks (id, content), each once for a block of texts."""
    for batch in batches:
        data, offsets = byte_view(batch.column(0))
        for i, j in spans_of(offsets, BLOCK):
            own = offsets[i : j + 1]
            ends, _ = cuts_of(data, own)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            raw = data[own[0] : own[-1]]
            ids = range_hashes(raw, starts, ends).view(np.int64)
            once = {(n, raw[a:b].tobytes()): None for n, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist())}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in once], pa.int64()), pa.array([c for _, c in once], pa.binary())], names=["id", "content"])


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, sha (binary SHA-256 of the text), recipe (chunk hashes in order) of every row."""
    return docs.select("doc_id", "text").mapInArrow(trimmed(_recipes), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sha binary, recipe array<bigint>")


def contents_of(texts: DataFrame) -> DataFrame:
    """id and content of the chunks of texts, some more than once."""
    return texts.mapInArrow(trimmed(_chunks), "id bigint, content binary")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts.

    docs has doc_id and text; null counts as empty. Returns one row per input row: doc_id, keep_id
    (the group's largest doc_id, null only if it has no other), group_size, kept (true for one row
    of each group), text_sha256. Rows that repeat id and text count each, and one of them is kept.
    An empty table gives an empty result.
    """
    known = written(recipes(docs), "recipes")
    # A hot recipe is summed up by text before its texts are listed, of which there is one but for hash collisions.
    by_text = known.groupBy("recipe", "sha").agg(F.count(F.lit(1)).alias("n"))
    shared = by_text.groupBy("recipe").agg(F.sum("n").alias("n"), F.collect_set("sha").alias("shas")).where(F.col("n") > 1)
    suspects = shared.select(F.explode("shas").alias("sha"))
    texts = docs.select("text", text_key().alias("sha")).join(suspects.hint("shuffle_hash"), "sha", "left_semi").select("text")
    contents = contents_of(texts).distinct()
    mistaken = written(contents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id"), "mistaken")
    if mistaken.isEmpty():
        named = known.withColumn("more", F.lit(None).cast("binary"))
    else:
        ambiguous = known.select("sha", F.explode("recipe").alias("id")).join(mistaken, "id", "left_semi").select("sha").distinct().withColumn("more", F.col("sha"))
        named = known.join(ambiguous, "sha", "left")
    return grouped(named)


def grouped(named: DataFrame) -> DataFrame:
    """Groups rows of verified identifiers: doc_id, sha, recipe, and more where the recipe isn't enough."""
    name = F.struct("recipe", "more")
    named = named.withColumn("name", name)
    groups = named.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
    # A hot group is a hot key on the left only; AQE splits it.
    wide = named.select("doc_id", "sha", "name").join(groups.withColumnRenamed("name", "g"), F.col("name").eqNullSafe(F.col("g")), "left")
    twin = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy(F.lit(0)))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return wide.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (twin == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


EXACT_SQL = """
    with d as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id is not distinct from max(doc_id) over g and row_number() over (partition by text, doc_id) = 1 as kept,
           sha256(text) as text_sha256
    from d window g as (partition by text)
"""
