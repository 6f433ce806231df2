"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Each source's target: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; the
   targets share all words, stop at max_epochs times the source's words, and the excess is
   shared again by weight (water filling, in closed form).
2. The mix is cut in blocks of about block_words words. Sainte-Lague gives each source its blocks,
   then each shard of a source its blocks: always to the highest quotient votes / (2 seats + 1).
3. In a shard, documents stand in seeded order; the shard's words are cut in equal blocks. Quotas
   beyond the number of blocks are whole repeats; the rest goes to seeded blocks.
4. A source of fewer than SMALL_BLOCKS blocks stands outside this apportionment, as a block is too
   much of it: its seats are single words, its rounded target in all, and what is taken beyond whole
   repeats is one run of words (from the last word on to the first) at a seeded place.

Only (source, shard) totals are gathered; a document's share is arithmetic on its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import written

#: Words: runs without white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Parameters of the registered query.
BLOCK_WORDS = 32
MAX_EPOCHS = 3
#: Blocks from which a source is mixed in blocks; a smaller one is mixed by words.
SMALL_BLOCKS = 32
WEIGHTS = (1, 2, 3)
#: Documents of a source in one shard, about; the number of shards follows the input.
SHARD_ROWS = 5_000
SEED = 20_240_229
#: Multiplier of the block permutation: a prime above any number of blocks in a shard.
_PRIME = 2_147_483_647


def count_words(text: Column) -> Column:
    """Number of words: a mark replaces each, and the marks are counted."""
    safe = F.coalesce(text, F.lit(""))
    spaced = F.trim(F.regexp_replace(safe, r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Target words of each source. sizes: one row (source, source_size) for each source.

    The level t solves sum(min(max_epochs * size, weight * t)) = sum(size): sources are taken by
    cap / weight, and the first whose cap isn't reached fixes the level.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
    first_open = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return df.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(first_open, F.lit(float("inf"))))).select("source", "source_size", "target")


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds n_seats: each group's seats go one by one to the party with the highest votes / (2 n + 1).

    Seats certain to be won are given at once: with K parties and S seats, a party gets
    round(votes * (S - K / 2) / all votes), together S at most. The others, K at most, go
    by their quotients; ties go to the first party in order.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    keys = [c for c in parties.columns]
    df = parties.withColumn("_all", F.sum(votes).over(g).cast("double")).withColumn("_k", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(g))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    sure = F.floor(share * F.greatest(F.col(seats) - F.col("_k") / 2.0, F.lit(0.0)) + 0.5).cast("long")
    df = df.withColumn("_sure", sure)
    df = df.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    # A party's further seats: its share of K seats, and two for rounding.
    most = F.ceil(share * (F.col("_k") + 1)).cast("long") + 2
    tries = F.when(F.col(votes) > 0, F.sequence(F.lit(0).cast("long"), F.least(most, F.greatest(F.col("_left"), F.lit(0).cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_try", F.explode_outer(tries))
    df = df.withColumn("_q", F.col(votes) / (2.0 * (F.col("_sure") + F.col("_try")) + 1.0))
    rank = F.row_number().over(g.orderBy(F.col("_q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order], F.col("_try")))
    df = df.withColumn("_won", (F.col("_q").isNotNull() & (rank <= F.col("_left"))).cast("long"))
    return df.groupBy(*keys).agg((F.first("_sure") + F.sum("_won")).alias("n_seats"))


def _seeded(seed: int, *parts: Column) -> Column:
    """32 seeded bits as a number, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
    size: str | None = None,
) -> DataFrame:
    """What the mix takes of each document.

    docs has doc_id, text, source; with size, a column of words that are counted already stands for the text. Returns one row per input row: doc_id, size, source_size,
    target (of its source), taken (words, repeats counted), epochs (whole copies), blocks (the
    further blocks, as structs of first and last word in the document, the last not included) and
    the columns keep, prefixed with keep_. A null text has size 0 and nothing is taken of it; null
    is a source of its own, last in order. Repeated rows count each; a null doc_id stays null. An
    empty table gives an empty result; a document takes max_epochs times its size at most.
    """
    words = count_words(F.col("text")) if size is None else F.col(f"`{size}`")
    df = docs.select("doc_id", "source", words.alias("size"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    if size is None:
        # Words are counted once.
        df = written(df, "sizes")
    df = df.withColumn("h", _seeded(seed, F.col("doc_id")))
    totals = df.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("n_shards"))
    targets = source_targets(totals, weights, max_epochs)
    small = F.col("source_size") < block_words * SMALL_BLOCKS
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    quotas = sainte_lague(targets.where(~small).withColumn("seats", blocks), [], ["source"], "target", "seats").drop("seats").withColumnRenamed("n_seats", "quota")
    quotas = quotas.unionByName(targets.where(small).withColumn("quota", F.round("target").cast("long")))

    # A shard of a source holds about shard_rows documents; equal ids share a shard.
    sharded = _with_source(df, totals.select("source", "n_shards")).withColumn("shard", F.pmod(_seeded(seed + 1, F.col("doc_id")), F.col("n_shards"))).drop("n_shards")
    shards = sharded.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = _with_source(shards, quotas)
    shards = sainte_lague(shards, ["source"], ["shard"], "words", "quota")
    shards = shards.withColumn("n_blocks", F.greatest(F.when(small, F.col("words")).otherwise(F.round(F.col("words") / block_words)), F.lit(1)).cast("long"))
    won = F.least("n_seats", F.col("n_blocks") * max_epochs)
    shards = shards.select(
        F.col("source").alias("s_source"),
        F.col("shard").alias("s_shard"),
        "source_size",
        "target",
        "words",
        "n_blocks",
        F.floor(won / F.col("n_blocks")).cast("long").alias("epochs"),
        F.pmod(won, "n_blocks").alias("more"),
        F.when(small, F.lit(1)).otherwise(F.pmod(F.lit(_PRIME), F.col("n_blocks"))).alias("stride"),
        F.pmod(_seeded(seed + 2, F.col("source"), F.col("shard")), F.col("n_blocks")).alias("shift"),
    )
    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sharded.withColumn("start", F.sum("size").over(order) - F.col("size"))
    wide = placed.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))

    def bound(b: Column) -> Column:
        return F.floor(b * F.col("words") / F.col("n_blocks")).cast("long")

    def block_of(word: Column) -> Column:
        return F.floor(((word + 1) * F.col("n_blocks") - 1) / F.col("words")).cast("long")

    own = F.when((F.col("size") > 0) & (F.col("more") > 0), F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.filter(own, lambda b: F.pmod(b * F.col("stride") + F.col("shift"), F.col("n_blocks")) < F.col("more"))
    spans = F.transform(
        chosen,
        lambda b: F.struct(
            F.greatest(bound(b) - F.col("start"), F.lit(0).cast("long")).alias("first"),
            F.least(bound(b + 1) - F.col("start"), F.col("size")).alias("last"),
        ),
    )
    wide = wide.withColumn("blocks", spans)
    part = F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    return wide.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "epochs", "blocks", *[f"keep_{c}" for c in keep])


def _with_source(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds the columns of a per-source table; the null source matches itself.

    Left to the planner: a small table is broadcast by its measured size, beyond that AQE
    splits the rows of a hot source.
    """
    right = by_source.withColumnRenamed("source", "_source")
    return df.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy, and one whose text is
    the further blocks of the document. Documents of which nothing is taken go: null and empty texts always do.

    Rows that repeat, with the same id or without one, count each. An empty table gives an empty result. Columns of any name
    stay as they are. The plan is made on sizes alone; each text moves once, to meet what is taken of it.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("doc")
    sized = written(docs.select(F.monotonically_increasing_id().alias("row"), row, count_words(F.col("text")).alias("size")), "sized")
    plan = mix(sized.select("doc.doc_id", "doc.source", "size", "row"), keep=("row",), size="size", **options)
    plan = plan.where(F.col("taken") > 0).select(F.col("keep_row").alias("row"), "epochs", "blocks")
    plan = sized.select("row", "doc").join(plan, "row")
    text = F.col("doc.text")
    tokens = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # The words are the argument of an outer transform, so that they are made once and not for each block.
    chosen = F.transform(F.array(tokens), lambda t: F.flatten(F.transform("blocks", lambda x: F.slice(t, (x["first"] + 1).cast("int"), (x["last"] - x["first"]).cast("int")))))
    part = F.when(F.size("blocks") > 0, F.array(F.array_join(chosen[0], ""))).otherwise(F.array().cast("array<string>"))
    # Whole copies are told by a null, so that only one text stands beside the list.
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("epochs")), lambda _: F.lit(None).cast("string"))
    copies = F.concat(F.when(F.col("epochs") > 0, whole).otherwise(F.array().cast("array<string>")), part)
    rows = plan.select("doc", F.explode(copies).alias("copy"))
    return rows.select(*[(F.coalesce("copy", text) if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in columns])


def mix_sql(
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> str:
    """DuckDB SQL for mix() without its lists."""

    def seeded(number: int, *parts: str) -> str:
        key = " || ':' || ".join([f"'{number}'", *[f"coalesce(cast({p} as varchar), 'null')" for p in parts]])
        return f"cast(('0x' || substr(md5({key}), 1, 8)) as bigint)"

    cycle = ", ".join(f"{float(w)}" for w in weights)
    return rf"""
    with d as (
      select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
             {seeded(seed, "doc_id")} as h from documents),
    t as (select source, cast(sum(size) as bigint) as source_size, cast(ceil(count(*) / {shard_rows}.0) as bigint) as n_shards from d group by source),
    w as (select *, ([{cycle}])[(row_number() over (order by encode(source) nulls last) - 1) % {len(weights)} + 1] as weight from t),
    v as (select *, {float(max_epochs)} * source_size as cap from w),
    o as (select *, coalesce(sum(cap) over b, 0) as capped, sum(weight) over () - coalesce(sum(weight) over b, 0) as open,
             sum(source_size) over () as everything from v
          window b as (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
    level as (select min_by((everything - capped) / open, cap / weight) as level from o where cap / weight >= (everything - capped) / open),
    targets as (select source, source_size, n_shards, least(cap, weight * level) as target from o, level),
    s0 as (select *, cast(round(sum(target) over () / {block_words}) as bigint) as seats, sum(target) over () as total,
             count(*) filter (where target > 0) over () as k from targets),
    s1 as (select *, cast(floor(case when total > 0 then target / total else 0 end * greatest(seats - k / 2.0, 0) + 0.5) as bigint) as sure from s0),
    s2 as (select *, seats - sum(sure) over () as spare from s1),
    s3 as (select *, unnest(case when target > 0 then range(0, cast(greatest(spare, 0) as bigint) + 1) else [] end) as try from s2),
    s4 as (select source, row_number() over (order by target / (2.0 * (sure + try) + 1) desc, encode(source) nulls last, try) as r, spare from s3),
    quotas as (select s2.source, any_value(source_size) as source_size, any_value(n_shards) as n_shards, any_value(target) as target,
             any_value(sure) + coalesce(any_value(e.n), 0) as quota
          from s2 left join (select source, count(*) as n from s4 where r <= spare group by source) e on s2.source is not distinct from e.source
          group by s2.source),
    p as (select d.*, q.source_size, q.target, q.quota, {seeded(seed + 1, "doc_id")} % q.n_shards as shard
          from d join quotas q on d.source is not distinct from q.source),
    h0 as (select source, shard, cast(sum(size) as bigint) as words, any_value(quota) as seats from p group by source, shard),
    h1 as (select *, sum(words) over g as total, count(*) filter (where words > 0) over g as k from h0 window g as (partition by source)),
    h2 as (select *, cast(floor(case when total > 0 then words / cast(total as double) else 0 end * greatest(seats - k / 2.0, 0) + 0.5) as bigint) as sure from h1),
    h3 as (select *, seats - sum(sure) over (partition by source) as spare from h2),
    h4 as (select *, unnest(case when words > 0 then range(0, cast(greatest(spare, 0) as bigint) + 1) else [] end) as try from h3),
    h5 as (select source, shard, spare, row_number() over (partition by source order by words / (2.0 * (sure + try) + 1) desc, shard, try) as r from h4),
    h6 as (select h3.source, h3.shard, any_value(words) as words, greatest(cast(round(any_value(words) / {block_words}.0) as bigint), 1) as n_blocks,
             cast(any_value(sure) + coalesce(any_value(e.n), 0) as bigint) as won
          from h3 left join (select source, shard, count(*) as n from h5 where r <= spare group by source, shard) e
            on h3.source is not distinct from e.source and h3.shard = e.shard group by h3.source, h3.shard),
    h7 as (select source, shard, words, n_blocks, least(won, n_blocks * {max_epochs}) // n_blocks as epochs, least(won, n_blocks * {max_epochs}) % n_blocks as more,
             {_PRIME} % n_blocks as stride, {seeded(seed + 2, "source", "shard")} % n_blocks as shift from h6),
    a as (select p.doc_id, p.source, p.shard, p.size, p.source_size, p.target,
             cast(sum(size) over (partition by source, shard order by h, doc_id, size rows unbounded preceding) - size as bigint) as start from p),
    b as (select a.*, h7.words, h7.n_blocks, h7.epochs, h7.more, h7.stride, h7.shift
          from a join h7 on a.source is not distinct from h7.source and a.shard = h7.shard)
    select doc_id, size, source_size, target,
      cast(epochs * size + coalesce(list_sum([
        least(((x + 1) * words) // n_blocks - start, size) - greatest((x * words) // n_blocks - start, 0)
        for x in range(((start + 1) * n_blocks - 1) // words, ((start + size) * n_blocks - 1) // words + 1)
        if (x * stride + shift) % n_blocks < more]), 0) as bigint) as taken
    from b
    """
