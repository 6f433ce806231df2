"""URL filter: rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

The trees are grown from labelled URLs level by level: each level is one aggregation of gradients
by (node, feature, bin), of which only the sums, a table of fixed size, come to the driver. The
finished ensemble is one column expression over the features, so scoring is a projection.

Labelled URLs are a bounded sample (max_rows, by seeded hash). In the registered query they are the
URLs that a rule decides, which the trees carry over to the URLs that no rule fits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import written

#: (rule, verdict): host and path of a rule in one string.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Labelled URLs that the trees are fitted to, at most.
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 12, 3, 0.3, 16
#: Pseudo-counts of the suffix statistics, and of a leaf.
PRIOR, LEAF = 20.0, 1.0
#: Parts of the labelled URLs; a URL's own part doesn't count in its suffixes' statistics when trees are fitted.
FOLDS = 5
#: Suffixes of a URL and the features that their statistics give.
SUFFIXES = {"s_last": "f_last_suffix", "s_two": "f_two_suffix", "s_ext": "f_extension"}
SEED = 11
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_hyphens",
    "f_entropy", "f_params", "f_query_length", "f_fragment", "f_secure", "f_last_suffix", "f_two_suffix", "f_extension",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of rules of one length the last by code points counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut = text.index("/") if "/" in text else len(text)
        own, start = text[:cut], text[cut:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def lexical_features(df: DataFrame) -> DataFrame:
    """Adds the features that a URL has by itself, and its suffixes. df has url, host, path."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, ""))
    counts = F.transform(letters, lambda c: F.when(c == "", F.lit(0)).otherwise(size - F.length(F.replace(url, c, F.lit("")))))
    spread = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0)))
    parts = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    return df.withColumns(
        {
            "f_length": size.cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_path_length": F.length("path").cast("double"),
            "f_depth": _count(F.col("path"), "/"),
            "f_labels": _count(F.col("host"), "."),
            "f_digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(size, F.lit(1)),
            "f_hyphens": _count(F.col("host"), "-"),
            "f_entropy": F.when(size > 0, F.log2(size.cast("double")) - spread / size).otherwise(F.lit(0.0)),
            "f_params": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&") + 1),
            "f_query_length": F.length(query).cast("double"),
            "f_fragment": F.when(F.instr(url, "#") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
            "f_secure": F.when(F.startswith(F.lower(url), F.lit("https:")), F.lit(1.0)).otherwise(F.lit(0.0)),
            "s_last": F.element_at(parts, -1),
            "s_two": F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.least(F.size(parts), F.lit(2))), "."),
            "s_ext": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,5})/?$", 1),
        }
    )


@dataclass
class UrlTrees:
    """Fitted trees: nested (feature, threshold, low, high) with numbers as leaves, and the suffix statistics."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None
    share: float = 0.5

    def with_suffix_statistics(self, df: DataFrame) -> DataFrame:
        """Adds the part of blocked URLs of each suffix; unknown suffixes have that of all."""
        for column, name in SUFFIXES.items():
            if self.suffixes is None:
                df = df.withColumn(name, F.lit(self.share))
                continue
            # At most one row for each labelled URL of the bounded sample.
            own = self.suffixes.where(F.col("kind") == column).withColumnRenamed("suffix", column).withColumnRenamed("part", name).drop("kind")
            # Of rows with a fold the other folds' part counts.
            df = df.join(F.broadcast(own), [c for c in own.columns if c != name], "left").fillna({name: self.share})
        return df

    def margin(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + F.expr(_tree_sql(tree))
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D" if "e" not in repr(tree) else f"CAST({tree!r} AS DOUBLE)"
    feature, threshold, low, high = tree
    return f"CASE WHEN {feature} <= {threshold!r}D THEN {_tree_sql(low)} ELSE {_tree_sql(high)} END"


def _node_sql(tree, number: int = 1) -> str:
    """The number of the open leaf (None) that a row reaches, or 0; children of n are 2 n and 2 n + 1."""
    if tree is None:
        return str(number)
    if not isinstance(tree, tuple):
        return "0"
    feature, threshold, low, high = tree
    return f"CASE WHEN {feature} <= {threshold!r}D THEN {_node_sql(low, 2 * number)} ELSE {_node_sql(high, 2 * number + 1)} END"


def _closed(tree, choices: dict, number: int = 1):
    """Replaces open leaves by what was chosen for them."""
    if tree is None:
        return choices.get(number, 0.0)
    if not isinstance(tree, tuple):
        return tree
    return (*tree[:2], _closed(tree[2], choices, 2 * number), _closed(tree[3], choices, 2 * number + 1))


def fit_trees(labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlTrees:
    """Fits to labelled URLs: url, host, path, blocked (0 or 1). Rows with a null label are left out.

    Of more than max_rows the ones first by seeded hash are taken. Without rows, or with one label
    only, every URL gets the same probability.
    """
    order = F.xxhash64(F.lit(seed), "url", "blocked")
    sample = labelled.where(F.col("blocked").isNotNull()).select("url", "host", "path", F.col("blocked").cast("double").alias("y")).orderBy(order, "url").limit(max_rows)
    sample = lexical_features(sample).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "url"), F.lit(FOLDS)).cast("int"))
    sample = written(sample, "labelled_urls")
    n, positive = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = (positive + 1) / (n + 2) if n else 0.5
    model = UrlTrees(base=math.log(share / (1 - share)), share=share)
    if not n or positive in (0, n):
        return model
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("suffix")) for c in SUFFIXES]))
    part = lambda y, n: (y + PRIOR * share) / (n + PRIOR)
    folds = sample.select(kinds.alias("x"), "y", "fold").groupBy("x.kind", "x.suffix", "fold").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    folds = written(folds, "url_folds")
    sums = folds.groupBy("kind", "suffix").agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    model.suffixes = written(sums.select("kind", "suffix", part(F.col("all_y"), F.col("all_n")).alias("part")), "url_suffixes")
    # A labelled URL's own fold doesn't count in its suffixes' parts, else they would tell its label.
    others = folds.join(sums, ["kind", "suffix"]).select("kind", "suffix", "fold", part(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n")).alias("part"))
    rows = replace(model, suffixes=written(others, "url_suffixes")).with_suffix_statistics(sample).select("y", *FEATURES)
    points = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    bins = F.array(*[_bin(f, cuts[f]) for f in FEATURES])
    rows = written(rows.withColumn("bins", bins), "url_bins")
    for _ in range(trees):
        tree = None
        margin = model.margin()
        for level in range(depth + 1):
            p = 1 / (1 + F.exp(-margin))
            state = rows.select(F.expr(_node_sql(tree)).alias("node"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), "bins")
            sums = state.where("node > 0").select("node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            tree = _closed(tree, _choices(sums, cuts, final=level == depth))
            if not _is_open(tree):
                break
        model.trees.append(tree)
    return model


def _bin(feature: str, cuts: list[float]) -> Column:
    """The number of cuts below the feature."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(feature) > c))


def _is_open(tree) -> bool:
    return tree is None or isinstance(tree, tuple) and (_is_open(tree[2]) or _is_open(tree[3]))


def _choices(sums: list, cuts: dict, final: bool) -> dict:
    """For each open leaf the split with the largest gain, or its value if there is none."""
    nodes: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in sums:
        nodes.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (round(r.g, 9), round(r.h, 9))
    out = {}
    for node, features in nodes.items():
        g = sum(x for x, _ in features[0].values())
        h = sum(x for _, x in features[0].values())
        best = (1e-6, None)
        for f, name in enumerate(FEATURES):
            left_g = left_h = 0.0
            for b, cut in enumerate(cuts[name]):
                add = features[f].get(b, (0.0, 0.0))
                left_g, left_h = left_g + add[0], left_h + add[1]
                right_h = h - left_h
                if left_h < 0.5 or right_h < 0.5:
                    continue
                gain = left_g**2 / (left_h + LEAF) + (g - left_g) ** 2 / (right_h + LEAF) - g**2 / (h + LEAF)
                if gain > best[0] + 1e-9:
                    best = (gain, (name, float(cut)))
        if final or best[1] is None:
            out[node] = round(-RATE * g / (h + LEAF), 9)
        else:
            out[node] = (*best[1], None, None)
    return out


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_rows: int = MAX_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdict on every URL.

    pages has page_id and url; labelled, if given, has url and blocked (0 or 1), else the URLs that
    a rule decides are the labelled ones. Returns one row per input row: page_id, the columns keep,
    host, path, rule (the longest that fits, else null), verdict (the rule's, else block where the
    trees give 0.5 or more), score (their probability). A null URL has an empty host and path and no
    rule. Repeated rows give repeated results; an empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", *keep, "url").withColumns({"host": host, "path": path})
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "says": says})
    if labelled is None:
        known = df.where(F.col("says").isNotNull()).withColumn("blocked", (F.col("says") == "block").cast("int"))
    else:
        known = labelled.select("url", "blocked").withColumns({"host": host, "path": path})
    model = fit_trees(known.select("url", "host", "path", "blocked"), max_rows)
    scored = model.with_suffix_statistics(lexical_features(df)).withColumn("score", model.probability())
    verdict = F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", *keep, "host", "path", "rule", verdict.alias("verdict"), "score")
