"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut in m segments of about log2(number of codes) bits. In round r every open query looks up,
segment by segment, the codes whose segment is at distance r. After round r all codes within distance
m (r + 1) - 1 have been seen; a query is done when its k-th verified neighbour lies within that.

Equal codes are one entry with their smallest ids; equal query codes are searched once. A segment's
entries are dealt to blocks by the segment's first bits, and a query goes only to blocks whose bits
are near enough; a full block is cut by a hash of the code, and many queries of one block come in chunks, so a
task holds a bounded number of either. Of the index a round reads the blocks that queries go to, once for each
chunk of such a block and not for each chunk of all queries.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import written

BITS = 64
#: Entries of a block, and query codes of a chunk of one block, about.
BLOCK = 16_384
CHUNK = 65_536
#: Neighbours that the registered query asks for.
TOP = 10
_SALTS = 16


def sign_code(vector: Column, strict: bool = False) -> Column:
    """Code of a vector: bit i tells whether component i is above 0 (NaN is, as SQL orders it); null gives null.

    A code has 64 bits. Components beyond don't count, or are an error if strict.
    """
    if strict:
        vector = F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a code has {BITS} bits: the vector is longer"))).otherwise(vector)
    return F.aggregate(F.slice(vector, 1, BITS), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


@lru_cache(maxsize=256)
def masks(width: int, weight: int) -> np.ndarray:
    """All numbers of width bits with weight ones."""
    if weight > width:
        return np.zeros(0, np.int64)
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), weight)], np.int64)


def segments_of(n: int) -> list[tuple[int, int]]:
    """Shift and width of each segment for n codes."""
    m = ceil(BITS / min(16, max(4, ceil(log2(max(n, 2))))))
    edges = [round(k * BITS / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _searcher(segments: list[tuple[int, int]], lead: int, top: int):
    def run(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        """Neighbours of the probes in one block of one segment, whose segment is at the probe's distance exactly."""
        out: list[tuple[np.ndarray, ...]] = []
        if len(probes) and len(index):
            shift, width = segments[int(index["seg"].iloc[0])]
            low_bits = width - lead
            codes, ids, weights = index["code"].to_numpy().view(np.uint64), index["least"].to_numpy(), index["n"].to_numpy()
            low = ((codes >> np.uint64(shift)) & np.uint64((1 << low_bits) - 1)).astype(np.int64)
            order = np.argsort(low, kind="stable")
            codes, ids, weights, low = codes[order], ids[order], weights[order], low[order]
            at = np.searchsorted(low, np.arange((1 << low_bits) + 1))
            for q, radius, bound in zip(probes["q"].tolist(), probes["radius"].tolist(), probes["bound"].tolist()):
                code = np.uint64(q & (2**BITS - 1))
                own = int((code >> np.uint64(shift)) & np.uint64((1 << low_bits) - 1))
                if radius > low_bits:
                    continue
                near = masks(low_bits, radius)
                if len(near) < len(low):
                    values = near ^ own
                    size = at[values + 1] - at[values]
                    held = size > 0
                    begin, size = at[values[held]], size[held]
                    total = np.cumsum(size)
                    found = np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)
                else:
                    found = np.flatnonzero(np.bitwise_count(low ^ own) == radius)
                distance = np.bitwise_count(codes[found] ^ code).astype(np.int32)
                good = distance <= bound
                found, distance = found[good], distance[good]
                if len(found) > top:
                    best = np.lexsort((ids[found], distance))[:top]
                    found, distance = found[best], distance[best]
                if len(found):
                    out.append((np.full(len(found), q), codes[found].view(np.int64), distance, ids[found], weights[found]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(("q", "code", "distance", "least", "n"), columns)))

    return run


def exact_top_k(codes: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k nearest other rows of each query row, by Hamming distance, then id.

    codes and queries have id and code (64 bits as bigint). Returns query_id, rank (from 1), id and
    distance; fewer than k rows where there are no more. Rows with a null id or code are neither
    found nor searched for; a row isn't its own neighbour, but others of the same code are. Rows that
    repeat id and code are one row. Empty tables give an empty result.
    """
    spark = codes.sparkSession
    rows = codes.select("id", "code").dropna().distinct()
    wanted = written(queries.select("id", "code").dropna().distinct(), "queries")
    # The k + 1 smallest ids of each code, salted first: a hot code never meets in one task.
    salted = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("code", salted).orderBy("id"))).where(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = written(some.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    n = entries.count()
    state = written(wanted.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "open_queries")
    if not n or state.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank bigint, id bigint, distance bigint")
    segments = segments_of(n)
    lead = min(max(0, ceil(log2(n / BLOCK))), min(w for _, w in segments) - 1) if n > BLOCK else 0

    def prefix(code: Column, seg: int) -> Column:
        shift, width = segments[seg]
        return F.shiftrightunsigned(code, shift + width - lead).bitwiseAND(F.lit((1 << lead) - 1)).cast("int")

    by_segment = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), prefix(F.col("code"), s).alias("block")) for s in range(len(segments))]))
    placed = entries.select("code", F.element_at("ids", 1).alias("least"), F.size("ids").alias("n"), by_segment.alias("x")).select("code", "least", "n", "x.seg", "x.block")
    blocks = placed.groupBy("seg", "block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("salts"))
    blocks = written(blocks, "blocks")
    index = placed.join(blocks, ["seg", "block"]).withColumn("salt", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int")).drop("salts")
    index = written(index, "index")
    search = _searcher(segments, lead, k + 1)
    best = None
    found_schema = "q bigint, code bigint, distance int, least bigint, n int"
    for r in range(max(w for _, w in segments) + 1):
        near = [(int(x), w) for w in range(min(r, lead) + 1) for x in masks(lead, w)]
        hops = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(r - w).alias("radius")) for x, w in near])
        own = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), prefix(F.col("q"), s).alias("block")) for s in range(len(segments))]))
        probes = state.select("q", "bound", own.alias("o")).select("q", "bound", "o.seg", "o.block", F.explode(hops).alias("hop"))
        probes = probes.select("q", "bound", "seg", F.col("block").bitwiseXOR(F.col("hop.x")).alias("block"), F.col("hop.radius").alias("radius"))
        probes = probes.join(blocks, ["seg", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        probes = written(probes, "probes")
        part = ["seg", "block", "salt"]
        asked = probes.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        probes = probes.join(asked, part).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int")).drop("chunks")
        own = index.join(asked, part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        key = [*part, "chunk"]
        found = probes.groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(search, found_schema)
        found = found.dropDuplicates(["q", "code"]) if best is None else found.unionByName(best).dropDuplicates(["q", "code"])
        order = Window.partitionBy("q").orderBy("distance", "least")
        best = written(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "best")
        covered = len(segments) * (r + 1) - 1
        sums = best.withColumn("so_far", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        kth = sums.where(F.col("so_far") >= k + 1).groupBy("q").agg(F.min("distance").alias("kth"))
        state = state.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > covered))
        state = written(state.select("q", F.coalesce("kth", F.lit(BITS)).alias("bound")), "open_queries")
        if state.isEmpty():
            break
    listed = best.join(entries, "code").select("q", "distance", F.explode("ids").alias("id"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("r") <= k + 1)
    listed = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    joined = wanted.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(listed, "q").select("query_id", F.posexplode(others).alias("pos", "x"))
    return joined.select("query_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.id").alias("id"), F.col("x.distance").cast("long").alias("distance"))


TOP_K_SQL = f"""
    with e as (select vec_id, [x > 0 for x in embedding[1:{BITS}]] as bits from embeddings where embedding is not null),
    p as (select q.vec_id as query_id, e.vec_id as id, len([1 for i in range(1, len(e.bits) + 1) if e.bits[i] <> q.bits[i]]) as distance
          from e q, e where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id),
    r as (select *, row_number() over (partition by query_id order by distance, id) as rank from p)
    select query_id, rank, id, distance from r where rank <= {TOP}
"""
