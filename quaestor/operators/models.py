"""Scoring models: a bilinear pair scorer, an LSTM encoder's forward pass, a linear text classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that linear_text_classifier fits to at most.
MAX_ROWS = 20_000


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def bilinear_scores(queries: DataFrame, candidates: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """sigmoid(q . c) for pairs that agree on some columns. Both sides have id, vector and these columns.

    Candidates of a key are dealt over salts groups, and each query goes to all of them, so that a common key is many tasks'.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    left = queries.select(*on, F.col("id").alias("query_id"), F.col("vector").alias("q"), salt)
    right = candidates.select(*on, F.col("id").alias("uid"), F.col("vector").alias("c"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"))
    return left.join(right, [*on, "_salt"]).select("query_id", "uid", _sigmoid(dot(F.col("q"), F.col("c"))).alias("score"))


def _sigmoid(product: Column) -> Column:
    return F.round(1 / (1 + F.exp(-product)), 6)


#: Queries, and candidates, of a key that are scored at once in a block.
BLOCK_ROWS = 4096


def bilinear_top_k(queries: DataFrame, candidates: DataFrame, on: list[str], k: int, salts: int = 16) -> DataFrame:
    """The rows of bilinear_scores() among which are each query's k best with another id, later uid first among equals: query_id, uid, score.

    All pairs are scored, in blocks of a key's queries and candidates, and a block passes on what may be among the k best. Products are summed
    in the order of dot(), so they are the same numbers. Vectors that aren't all of one length and finite are scored pair by pair.
    """
    both = queries.select("vector").unionByName(candidates.select("vector"))
    odd = F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    shape = both.agg(F.count_if(odd).alias("odd"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if shape.odd or shape.least != shape.most:
        return bilinear_scores(queries, candidates, on, salts).where("query_id <> uid")
    known = lambda rows: reduce(DataFrame.where, [F.col(c).isNotNull() for c in on], rows)
    most = lambda rows: known(rows).groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rows, columns = -(-most(queries) // BLOCK_ROWS) or 1, max(salts, -(-most(candidates) // BLOCK_ROWS))
    dealt = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # Columns are renamed, as both sides may be of one table.
    names = [f"_key_{i}" for i in range(len(on))]
    left = known(queries).select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.col("id").alias("query_id"), F.col("vector").alias("q"), dealt(rows, "_row"), each(columns, "_column"))
    right = known(candidates).select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.col("id").alias("uid"), F.col("vector").alias("c"), each(rows, "_row"), dealt(columns, "_column"))
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("uid", candidates.schema["id"].dataType), T.StructField("product", T.DoubleType())])

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values("uid", ascending=False, kind="stable")
        q, c = (np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, 0)) for x in (own["q"], others["c"]))
        uids, found = others["uid"].to_numpy(), []
        if len(c):
            for one, uid in zip(q, own["query_id"].to_numpy()):
                product = np.zeros(len(c))
                for j in range(c.shape[1]):
                    product += one[j] * c[:, j]
                found.append((uid, *_likely(product, uids != uid, k)))
        sizes = [len(x[1]) for x in found]
        at = np.concatenate([x[1] for x in found]) if found else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"query_id": np.repeat(own["query_id"].to_numpy()[: len(sizes)], sizes), "uid": uids[at], "product": np.concatenate([x[2] for x in found]) if found else np.zeros(0)})

    keys = [*names, "_row", "_column"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    return pairs.select("query_id", "uid", _sigmoid(F.col("product")).alias("score"))


def _likely(products: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of what may be among the k best by rounded score, the first place among equals.

    Those are the k best of the scores whose rounding is beyond doubt, and all that are in doubt (within a thousandth of the rounding's step).
    """
    with np.errstate(over="ignore"):
        scaled = 1e6 / (1 + np.exp(-products))
    unsure = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    sure = np.flatnonzero(wanted & ~unsure)
    rounded = np.floor(scaled[sure] + 0.5)
    if len(sure) > k:
        cut = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        sure, rounded = sure[rounded >= cut], rounded[rounded >= cut]
        sure = sure[np.argsort(-rounded, kind="stable")[:k]]
        unsure &= scaled >= cut - 1
    at = np.concatenate([sure, np.flatnonzero(wanted & unsure)])
    return at, products[at]


# The settings that the encoder was published with.
@dataclass(frozen=True)
class EncoderSettings:
    """Sizes of the encoder and how it was trained."""

    vocabulary: int = 91_620
    embedding: int = 100
    units: int = 256
    context: int = 160
    utterance: int = 80
    learning_rate: float = 0.001
    clip: float = 10.0
    batch: int = 128
    evaluation_batch: int = 16
    optimizer: str = "Adam"


@dataclass(frozen=True)
class EncoderWeights:
    """A shared LSTM with peepholes and the bilinear form between its two last states."""

    embedding: np.ndarray  # words x width
    kernel: np.ndarray  # (width + units) x 4 units: input, new value, forget, output
    bias: np.ndarray
    peepholes: np.ndarray  # 3 x units: input, forget, output
    pairing: np.ndarray  # units x units
    forget_bias: float = 2.0


def encode(weights: EncoderWeights, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Last state of each padded id sequence (rows of ids)."""
    units = weights.peepholes.shape[1]
    c, h = np.zeros((len(ids), units)), np.zeros((len(ids), units))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t in range(ids.shape[1]):
        live = (t < lengths)[:, None]
        z = np.concatenate([weights.embedding[ids[:, t]], h], axis=1) @ weights.kernel + weights.bias
        i, j, f, o = np.split(z, 4, axis=1)
        new_c = sigmoid(f + weights.forget_bias + weights.peepholes[1] * c) * c + sigmoid(i + weights.peepholes[0] * c) * np.tanh(j)
        new_h = sigmoid(o + weights.peepholes[2] * new_c) * np.tanh(new_c)
        c, h = np.where(live, new_c, c), np.where(live, new_h, h)
    return h


def pair_scores(rows: DataFrame, weights: EncoderWeights) -> DataFrame:
    """Adds probability to rows with context, context_len, utterance, utterance_len (padded ids)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("probability", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sides = [encode(weights, np.stack(frame[s].to_numpy()), frame[f"{s}_len"].to_numpy()) for s in ("context", "utterance")]
                frame = frame.assign(probability=1 / (1 + np.exp(-np.einsum("ni,ij,nj->n", sides[0], weights.pairing, sides[1]))))
            else:
                frame = frame.assign(probability=pd.Series(dtype=float))
            yield frame

    return rows.mapInPandas(run, schema)


def example_ranks(examples: DataFrame, weights: EncoderWeights, context: int = 160, utterance: int = 80) -> DataFrame:
    """The true utterance's rank among it and the distractors of each example: probability (of the true one), rank (from 0).

    Rows of dataset.eval_examples(). Equal probabilities count in the truth's favour. Each context is encoded once.
    """
    sides = ["utterance", *[c.removesuffix("_len") for c in examples.columns if c.startswith("distractor_") and c.endswith("_len")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            stacked = lambda side, most: encode(weights, np.stack(frame[side].to_numpy()), np.minimum(frame[f"{side}_len"].to_numpy(), most))
            left = stacked("context", context) @ weights.pairing
            logits = np.stack([np.einsum("nj,nj->n", left, stacked(s, utterance)) for s in sides], axis=1)
            p = np.round(1 / (1 + np.exp(-logits)), 6)
            yield pd.DataFrame({"probability": p[:, 0], "rank": (p[:, 1:] > p[:, :1]).sum(axis=1).astype(np.int32)})

    return examples.mapInPandas(run, "probability double, rank int")


def initial_embeddings(vocab: DataFrame, vectors: DataFrame, width: int, seed: int = 6) -> DataFrame:
    """A vector for each word of a vocabulary (id, word): that of vectors (word, vector), else uniform in [-0.25, 0.25) by hash.

    Returns id, vector (width values; longer known vectors are an error of the caller's).
    """
    from quaestor.operators.dataset import hashed

    drawn = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: hashed(seed, F.col("word"), k) / F.lit(float(1 << 29)) - 0.25)
    known = vectors.select("word", F.transform("vector", lambda x: x.cast("double")).alias("known"))
    return vocab.join(known, "word", "left").select("id", F.coalesce("known", drawn).alias("vector"))


def fit_pair_scorer(pairs: DataFrame, rounds: int = 20) -> PipelineModel:
    """A bilinear scorer with a diagonal form, fitted to pairs with left, right (arrays) and label (0 or 1).

    It stands in for the training of the recurrent encoder.
    """
    return Pipeline(stages=[LogisticRegression(maxIter=rounds, regParam=0.01)]).fit(pair_features(pairs).select("features", F.col("label").cast("double").alias("label")))


def pair_features(pairs: DataFrame) -> DataFrame:
    product = F.zip_with("left", "right", lambda x, y: x.cast("double") * y.cast("double"))
    return pairs.withColumn("features", array_to_vector(product))


def fit_text_classifier(rows: DataFrame, features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """Bag-of-words logistic regression on rows with text and label (0 or 1)."""
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"), HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(maxIter=rounds, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows.select("text", F.col("label").cast("double").alias("label")))


def classify(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds predicted (0 or 1)."""
    return model.transform(rows).withColumn("predicted", F.col("prediction").cast("int")).drop("words", "features", "rawPrediction", "probability", "prediction")
