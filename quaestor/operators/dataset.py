"""Training and evaluation sets for text-pair scorers. Every choice is by hash, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.stem import stem_of
from quaestor.functions.text import tokens
from quaestor.sources.shared import written

#: Words of a text that an encoder is given, and those of a context and of an utterance that it reads.
MAX_WORDS = 160
MAX_CONTEXT, MAX_UTTERANCE = 160, 80
#: Wrong answers beside the right one in an evaluation example.
DISTRACTORS = 9


def hashed(seed: int, *parts: Column) -> Column:
    """28 bits of an MD5 of the seed and the parts: the same number in any SQL engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def pairs(docs: DataFrame) -> DataFrame:
    """Context (title) and utterance (body): uid, context, utterance."""
    return docs.select("uid", F.col("question_title").alias("context"), F.col("question_body").alias("utterance"))


def numbered(rows: DataFrame, key: str = "uid") -> DataFrame:
    """Adds a dense 0-based position by key; rows of one key come in any order. Positions are made from counts of ranges, not in one task.

    The sorted ranges are written once, and both the counts and the rows are read from there: two
    plans of the same ranges may draw their bounds differently.
    """
    ranges = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id())
    ranges = written(ranges, "numbered")
    part = F.shiftright("_id", 33)
    counts = ranges.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranges.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return placed.withColumn("position", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_id", "_part", "_before")


def distractors(rows: DataFrame, n: int = DISTRACTORS, seed: int = 1) -> DataFrame:
    """n random utterances for each context, with replacement: uid, pos, distractor_uid."""
    placed = numbered(rows.select("uid"))
    total = placed.count()
    drawn = placed.select("uid", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pos")).withColumn("position", F.pmod(hashed(seed, F.col("uid"), F.col("pos")), F.lit(max(total, 1))))
    return drawn.join(placed.select("position", F.col("uid").alias("distractor_uid")), "position").select("uid", "pos", "distractor_uid")


def split_half(rows: DataFrame) -> DataFrame:
    """Adds part: the first half by uid is 'test', the rest 'valid'."""
    total = rows.count()
    return numbered(rows).withColumn("part", F.when(F.col("position") < F.lit(total // 2), "test").otherwise("valid")).drop("position")


def train_pairs(rows: DataFrame, seed: int = 2) -> DataFrame:
    """True pairs (label 1) and as many with another row's utterance (label 0): context_uid, utterance_uid, label."""
    true = rows.select(F.col("uid").alias("context_uid"), F.col("uid").alias("utterance_uid"), F.lit(1).alias("label"))
    false = distractors(rows, 1, seed).select(F.col("uid").alias("context_uid"), F.col("distractor_uid").alias("utterance_uid"), F.lit(0).alias("label"))
    return true.unionByName(false.where("context_uid <> utterance_uid"))


def shuffled(rows: DataFrame, seed: int = 3, key: str = "uid") -> DataFrame:
    return rows.orderBy(hashed(seed, F.col(key)), key)


def vocabulary(docs: DataFrame, min_frequency: int = 10) -> DataFrame:
    """Words of at least min_frequency occurrences with ids from 1, most frequent first: id, word, n. Id 0 is for all others.

    Words are numbered by ranges, so a vocabulary of any size is no task's alone.
    """
    each = docs.select(F.explode(tokens(F.concat_ws(" ", "question_title", "question_body"))).alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_frequency)
    placed = numbered(counts.withColumn("_order", F.struct((-F.col("n")).alias("n"), "word")), "_order")
    return placed.select((F.col("position") + 1).cast("int").alias("id"), "word", "n")


def sentence_ids(docs: DataFrame, vocab: DataFrame, length: int = MAX_WORDS) -> DataFrame:
    """Ids of the first length words of each body, padded with 0: uid, ids, n_words (length at most)."""
    return _looked_up(docs, vocab, length).select("uid", "ids", "n_words")


def _looked_up(docs: DataFrame, vocab: DataFrame, length: int) -> DataFrame:
    """As sentence_ids(), with all_words, the number of all words of the body. Each text is split once, and each row stands for itself."""
    parts = F.transform(F.array(tokens(F.col("question_body"))), lambda ws: F.struct(F.slice(ws, 1, length).alias("words"), F.size(ws).alias("n")))[0]
    words = docs.select("uid", parts.alias("p")).select("uid", "p.words", F.col("p.n").alias("all_words"))
    own = words.withColumn("_row", F.monotonically_increasing_id())
    each = own.select("_row", "uid", "all_words", F.posexplode_outer("words").alias("pos", "word")).join(vocab.select("word", "id"), "word", "left")
    pairs = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(0)).cast("int").alias("id"))))
    listed = each.groupBy("_row", "uid", "all_words").agg(F.array_sort(pairs).alias("x"))
    ids = F.transform("x", lambda x: x["id"])
    padded = F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size("x")))
    return listed.select("uid", padded.alias("ids"), F.size("x").alias("n_words"), "all_words")


def example_schema(mode: str) -> T.StructType:
    """Columns of an encoder's examples: mode 'train' has a label, 'eval' has distractors, 'infer' neither."""
    if mode not in ("train", "eval", "infer"):
        raise ValueError(f"no such mode: {mode}")
    sides = ["context", "utterance"] + [f"distractor_{k}" for k in range(DISTRACTORS)] * (mode == "eval")
    fields = [f for side in sides for f in (T.StructField(side, T.ArrayType(T.IntegerType())), T.StructField(f"{side}_len", T.IntegerType()))]
    return T.StructType(fields + [T.StructField("label", T.IntegerType())] * (mode == "train"))


def text_features(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """What an encoder reads of each text: uid, ids (padded), n_words (all words of the text). Written, as examples read it once for each side."""
    return written(_looked_up(docs, vocab, MAX_WORDS).select("uid", "ids", F.col("all_words").alias("n_words")), "features")


def clamped(length: Column, most: int) -> Column:
    """Words that the encoder reads: those there are, most at most."""
    return F.least(length, F.lit(most))


def train_examples(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Examples of example_schema('train'). pairs: context_uid, utterance_uid, label; features: text_features()."""
    return _sides(pairs.select("*", F.col("label").try_cast("double").cast("int").alias("_label")).drop("label").withColumnRenamed("_label", "label"), features, {"context": "context_uid", "utterance": "utterance_uid"}, "train")


def eval_examples(drawn: DataFrame, features: DataFrame) -> DataFrame:
    """Examples of example_schema('eval'): each text as context and utterance, and its distractors by position.

    drawn: uid, pos (from 1), distractor_uid, as distractors() gives them. All sides are looked up in one join, and a row is
    put together from them in one grouping.
    """
    sides = ["context", "utterance", *[f"distractor_{k}" for k in range(DISTRACTORS)]]
    own = features.select("uid", F.explode(F.array(F.lit(-1), F.lit(0))).alias("pos"), F.col("uid").alias("of"))
    wanted = drawn.where(F.col("pos") <= DISTRACTORS).select("uid", "pos", F.col("distractor_uid").alias("of")).unionByName(own)
    found = wanted.join(features.select(F.col("uid").alias("of"), F.struct("ids", "n_words").alias("f")), "of")
    wide = found.groupBy("uid").agg(*[F.max(F.when(F.col("pos") == k - 1, F.col("f"))).alias(side) for k, side in enumerate(sides)])
    return wide.select(*[c for side in sides for c in (F.col(f"{side}.ids").alias(side), F.col(f"{side}.n_words").alias(f"{side}_len"))])


def _sides(rows: DataFrame, features: DataFrame, sides: dict[str, str], mode: str) -> DataFrame:
    for side, key in sides.items():
        own = features.select(F.col("uid").alias(key), F.col("ids").alias(side), F.col("n_words").alias(f"{side}_len"))
        rows = rows.join(own, key)
    return rows.select(*example_schema(mode).names)


def batches(rows: DataFrame, size: int, epochs: int = 1, seed: int = 4, key: str = "uid") -> DataFrame:
    """Rows once for each epoch, newly shuffled in each: the columns of rows, epoch (from 0), batch (from 0 in each epoch).

    Batches of an epoch have size rows, its last one what is left.
    """
    total = rows.count()
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else rows.limit(0).withColumn("epoch", F.lit(0))
    placed = numbered(each.withColumn("_order", F.struct("epoch", hashed(seed, F.col("epoch"), F.col(key)).alias("h"), F.col(key).alias("k"))), "_order")
    own = F.col("position") - F.col("epoch") * F.lit(total)
    return placed.withColumn("batch", F.floor(own / F.lit(max(size, 1))).cast("int")).drop("_order", "position")


def term_frequencies(words: DataFrame) -> DataFrame:
    """Frequencies by stem: of the words of a stem the first of the list counts (word, frequency).

    words: position, word, frequency.
    """
    stems = words.withColumn("stem", stem_of(F.col("word")))
    return stems.groupBy("stem").agg(F.min_by("frequency", "position").alias("frequency")).select(F.col("stem").alias("word"), "frequency")


def fasttext_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines of a supervised text file: label, text without line breaks."""
    text = F.regexp_replace("question_body", "[\r\n]+", " ")
    return docs.join(labels, "uid").select(F.when(F.col("answer_accepted"), "__label__accepted").otherwise("__label__other").alias("label"), text.alias("text"))
