"""License scan with DataFrame functions only.

Signature rules (license_rules) run on texts read as numbered words. A text is scanned only if
it holds a rule's keyword, and each rule only where its keyword stands. Overlapping detections
are resolved by rank and containment: a detection inside another of the same or a stronger rank
falls away. Every step is one projection; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.license_rules import rules

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Confidence of a detection by rank.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.5}
RANKS = tuple(sorted(CONFIDENCE))
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _plain(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, parted by single spaces.

    lower() also lowers letters beyond ASCII, which parts no words. Two such letters would
    become ASCII ones; they are replaced first.
    """
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138"))
    return F.trim(F.regexp_replace(F.lower(safe), _SEPARATORS, " "))


def _starts(numbered: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand consecutively."""
    first, *rest = phrase.split(" ")
    pattern = rf" {first}:(\d+)" + "".join(rf" {w}:\d+" for w in rest) + "(?= |$)"
    return F.transform(F.regexp_extract_all(numbered, F.lit(pattern), F.lit(1)), lambda x: x.cast("long"))


def _detections(numbered: Column, found: Column) -> Column:
    """Detections of all rules whose keyword is among found, ordered for the containment sweep."""
    table = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(a).alias("label"), F.lit(r).alias("rank"), F.lit(k).alias("kw"), F.lit(p).alias("p")) for o, a, r, k, p in rules()])

    def of_rule(rule: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(numbered, rule["p"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, r"^ [^ :]+:(\d+)", 1).cast("long").alias("first"),
                (-F.regexp_extract(m, r":(\d+)$", 1).cast("long")).alias("minus_last"),
                rule["rank"].alias("rank"),
                rule["o"].alias("o"),
                rule["label"].alias("label"),
            ),
        )

    tried = F.filter(table, lambda rule: F.array_contains(found, rule["kw"]))
    return F.array_sort(F.flatten(F.transform(tried, of_rule)))


_ACC = "struct<" + ",".join(f"e{r}:bigint" for r in RANKS) + ",labels:array<string>,best:int,n:bigint>"


def _resolved(dets: Column) -> Column:
    """Sweep by start: a detection is dropped if one of its rank or stronger that began no later ends no earlier."""
    empty = F.struct(
        *[F.lit(-1).cast("long").alias(f"e{r}") for r in RANKS],
        F.array().cast("array<string>").alias("labels"),
        F.lit(99).alias("best"),
        F.lit(0).cast("long").alias("n"),
    ).cast(_ACC)

    def step(acc: Column, d: Column) -> Column:
        last = -d["minus_last"]
        covered = F.greatest(*[F.when(F.lit(r) <= d["rank"], acc[f"e{r}"]).otherwise(F.lit(-1).cast("long")) for r in RANKS]) >= last
        kept = F.struct(
            *[F.when(d["rank"] == r, F.greatest(acc[f"e{r}"], last)).otherwise(acc[f"e{r}"]).alias(f"e{r}") for r in RANKS],
            F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
            F.least(acc["best"], d["rank"]).alias("best"),
            (acc["n"] + 1).alias("n"),
        ).cast(_ACC)
        return F.when(covered, acc).otherwise(kept)

    return F.aggregate(dets, empty, step)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licenses named in each text.

    Returns one row per input row: the id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_detections. A null text counts as empty: 0 words, empty labels, null places,
    score 0. Repeated rows give repeated results; a null id stays null; other columns are ignored.
    """
    words = sorted({k for _, _, _, k, _ in rules()} | {p.split(" ")[0] for p, _ in BASE} | {"general"})
    gate = r"(?:^| )(?:" + "|".join(map(re.escape, words)) + r")(?= |$)"
    df = docs.select(F.col(id_column).alias("doc_id"), _plain(F.col(text_column)).alias("plain"))
    df = df.withColumn("n_words", F.when(F.col("plain") == "", F.lit(0)).otherwise(F.length("plain") - F.length(F.replace(F.col("plain"), F.lit(" "), F.lit(""))) + 1).cast("long"))
    df = df.withColumn("found", F.transform(F.array_distinct(F.regexp_extract_all("plain", F.lit(gate), F.lit(0))), lambda w: F.trim(w)))
    numbered = F.array_join(F.transform(F.split("plain", " "), lambda w, i: F.concat(F.lit(" "), w, F.lit(":"), i.cast("string"))), "")
    df = df.select("doc_id", "n_words", "found", F.when(F.size("found") > 0, numbered).otherwise(F.lit("")).alias("numbered"))
    places = [_starts(F.col("numbered"), phrase) for phrase, _ in BASE]
    hits = F.when(F.col("numbered") != "", _resolved(_detections(F.col("numbered"), F.col("found"))))
    df = df.select("doc_id", "n_words", *[p.alias(f"p{i}") for i, p in enumerate(places)], hits.alias("hits"))
    everywhere = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), F.isnotnull)
    method = F.coalesce(F.col("hits.labels"), F.array().cast("array<string>"))
    sure = F.create_map(*[F.lit(x) for r in RANKS for x in (r, CONFIDENCE[r])])
    return df.select(
        "doc_id",
        "n_words",
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).alias("first_word"),
        F.array_max(everywhere).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"),
        F.greatest(F.coalesce(F.try_element_at(sure, F.col("hits.best")), F.lit(0.0)), F.when(F.size(everywhere) > 0, F.lit(CONFIDENCE[4])).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce(F.col("hits.n"), F.lit(0).cast("long")).alias("n_detections"),
    )


def license_sql() -> str:
    """DuckDB SQL for license_scan(). The patterns are the same, without the look-ahead at their end, which greedy digits make idle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({o}, {quoted(a)}, {r}, {quoted(k)}, {quoted(p.removesuffix('(?= |$)'))})" for o, a, r, k, p in rules())
    places = []
    for phrase, _ in BASE:
        words = phrase.split(" ")
        fits = " and ".join(f"words[i + {k}] = {quoted(w)}" for k, w in enumerate(words, 1))
        places.append(f"[i for i in range(0, len(words) - {len(words) - 1}) if {fits}]")
    named = ", ".join(f"case when len(p{k}) > 0 then {quoted(a)} end" for k, (_, a) in enumerate(BASE))
    sure = " ".join(f"when {r} then {c}" for r, c in CONFIDENCE.items())
    return rf"""
    with t as (select row_number() over () as rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_SEPARATORS}', ' ', 'g')) as plain from documents),
    w as (select rid, doc_id, case when plain = '' then [] else string_split(plain, ' ') end as words from t),
    n as (select *, array_to_string(list_transform(words, lambda x, i: ' ' || x || ':' || (i - 1)), '') as numbered,
          {", ".join(f"{p} as p{k}" for k, p in enumerate(places))} from w),
    rules(o, label, rank, kw, pattern) as (values {values}),
    hits as (select distinct rid, o from (select rid, unnest(words) as x from w) join rules on kw = x),
    found as (select rid, o, label, rank, unnest(regexp_extract_all(numbered, pattern)) as m from hits join rules using (o) join n using (rid)),
    dets as (select rid, o, label, rank, cast(regexp_extract(m, '^ [^ :]+:(\d+)', 1) as bigint) as first, cast(regexp_extract(m, ':(\d+)$', 1) as bigint) as last from found),
    kept as (select * from dets a where not exists (select 1 from dets b where b.rid = a.rid and b.first <= a.first and b.last >= a.last and b.rank <= a.rank
             and (b.first < a.first or b.last > a.last or b.rank < a.rank or (b.rank = a.rank and b.o < a.o)))),
    sums as (select rid, list(distinct label) as labels, min(rank) as best, count(*) as n_detections from kept group by rid),
    b as (select n.*, list_concat({", ".join(f"p{k}" for k in range(len(BASE)))}) as places, [x for x in [{named}] if x is not null] as base from n)
    select doc_id, cast(len(words) as bigint) as n_words, cast(len(places) as bigint) as n_base, list_min(places) as first_word, list_max(places) as last_word,
      array_to_string(list_sort(base), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') as labels,
      cast(greatest(coalesce(case best {sure} end, 0.0), case when len(places) > 0 then {CONFIDENCE[4]} else 0.0 end) as double) as score, coalesce(n_detections, 0) as n_detections
    from b left join sums using (rid)
    """
