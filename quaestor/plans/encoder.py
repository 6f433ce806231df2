"""Queries over the text-pair encoder: its examples, its scores with small fixed weights, its evaluation.

The weights have one unit, so that SQL can follow the recurrence step by step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quaestor.operators import dataset, evaluate, models, rank
from quaestor.plans.catalogue import _DRAWN, ASKED, AUTHOR_RANK, BM25, COMBINED, NUMBERED, POSTINGS, QUESTION, TOP, VOCAB, WITH, WORD_RANK, indexed, query
from quaestor.functions import text as X
from quaestor.sources.views import docs, table

#: Documents that the encoder orders anew.
DEPTH = 30


def weights_for(vocab) -> models.EncoderWeights:
    """One unit; the embedding of word id is ((37 id) mod 11 - 5) / 10."""
    n = (vocab.agg(F.max("id")).first()[0] or 0) + 1
    embedding = ((np.arange(n) * 37 % 11 - 5) / 10.0)[:, None]
    return models.EncoderWeights(
        embedding, np.array([[0.5, -0.4, 0.3, 0.2], [0.1, 0.6, -0.2, 0.3]]), np.array([0.05, -0.1, 0.0, 0.1]), np.array([[0.1], [-0.2], [0.15]]), np.array([[3.0]])
    )


_S = "(1 / (1 + exp(-({}))))"
_X = "((ids[t + 1] * 37 % 11 - 5) / 10.0)::double"
_I, _J = f"{_X} * 0.5::double + h * 0.1::double + 0.05::double", f"{_X} * -0.4::double + h * 0.6::double - 0.1::double"
_F, _O = f"{_X} * 0.3::double + h * -0.2::double", f"{_X} * 0.2::double + h * 0.3::double + 0.1::double"
TEXT_IDS = f"""texts as (select uid, body as ws from words union all select -1, {X.duck_tokens("'" + QUESTION.replace("'", "''") + "'")}),
  each_word as (select uid, unnest(ws[1:160]) as word, generate_subscripts(ws[1:160], 1) as pos from texts),
  known as (select uid, list(coalesce(id, 0) order by pos) as ids from each_word left join vocab using (word) group by uid),
  feat as (select texts.uid, coalesce(ids, []) as ids, len(ws)::int as n_words from texts left join known using (uid))"""
#: The encoder's state of each text after each word; an utterance is read up to 80 words, a context up to 160.
STATES = f"""run as (select uid, 0 as t, 0.0::double as c, 0.0::double as h from feat union all
    select uid, t + 1, nc, {_S.format("o + 0.15::double * nc")} * tanh(nc) from (
      select uid, t, o, {_S.format("f + 2.0::double - 0.2::double * c")} * c + {_S.format("i + 0.1::double * c")} * tanh(j) as nc from (
        select uid, t, c, {_I} as i, {_J} as j, {_F} as f, {_O} as o from run join feat using (uid) where t < len(ids)))),
  states as (select uid, max(case when t = least(n_words, 160) then h end) as context, max(case when t = least(n_words, 80) then h end) as utterance from run join feat using (uid) group by uid)"""
ENCODED = f"with recursive {WITH[5:]}, {VOCAB}, {TEXT_IDS}, {STATES}"
_P = "round(1 / (1 + exp(-({} * 3.0::double * {}))), 6)"
RERANKED = f"""{POSTINGS}, {ASKED}, {BM25}, candidates as (select uid from bm25 order by score desc, uid desc limit {DEPTH}),
  neural as (select s.uid, {_P.format("q.context", "s.utterance")} as score from candidates join states s using (uid), (select context from states where uid = -1) q order by score desc, uid desc limit {TOP})"""


@query(f"{WITH}, {VOCAB}, {TEXT_IDS} select uid, md5(array_to_string(list_concat(ids, list_transform(range(0, 160 - len(ids)), lambda x: 0)), ' ')) as ids_md5, n_words, least(n_words, 160) as context_len, least(n_words, 80) as utterance_len from feat where uid >= 0")
def encoder_features(spark, sf_dir):
    own = docs(spark, sf_dir)
    rows = dataset.text_features(own, dataset.vocabulary(own))
    n = F.col("n_words")
    return rows.select("uid", _digest("ids").alias("ids_md5"), "n_words", dataset.clamped(n, dataset.MAX_CONTEXT).alias("context_len"), dataset.clamped(n, dataset.MAX_UTTERANCE).alias("utterance_len"))


def _digest(name):
    return F.md5(F.array_join(F.transform(name, lambda x: x.cast("string")), " "))


_PADDED = "md5(array_to_string(list_concat({0}.ids, list_transform(range(0, 160 - len({0}.ids)), lambda x: 0)), ' '))"


@query(f"""{WITH}, {VOCAB}, {TEXT_IDS}, {NUMBERED}, dr as (select uid, 1 as pos from numbered), p as (select uid, {_DRAWN.format(2)} as position from dr),
  pairs as (select uid as a, uid as b, 1 as label from numbered union all select p.uid, numbered.uid, 0 from p join numbered using (position) where p.uid <> numbered.uid)
  select {_PADDED.format("x")} as context, x.n_words as context_len, {_PADDED.format("y")} as utterance, y.n_words as utterance_len, label from pairs join feat x on x.uid = a join feat y on y.uid = b""")
def encoder_train_examples(spark, sf_dir):
    own = docs(spark, sf_dir)
    rows = dataset.train_examples(dataset.train_pairs(own), dataset.text_features(own, dataset.vocabulary(own)))
    return rows.select(_digest("context").alias("context"), "context_len", _digest("utterance").alias("utterance"), "utterance_len", "label")


def _evaluated(spark, sf_dir, what=lambda ids: F.col(ids)):
    """Evaluation examples, with what is wanted of each text's ids."""
    own = docs(spark, sf_dir)
    vocab = dataset.vocabulary(own)
    return dataset.eval_examples(dataset.distractors(own), dataset.text_features(own, vocab).withColumn("ids", what("ids"))), vocab


@query(f"""{WITH}, {VOCAB}, {TEXT_IDS}, {NUMBERED}, dr as (select uid, unnest(range(1, 10)) as pos from numbered), p as (select uid, pos, {_DRAWN.format(1)} as position from dr),
  drawn as (select p.uid, p.pos, feat.n_words as n, {_PADDED.format("feat")} as m from p join numbered using (position) join feat on feat.uid = numbered.uid)
  select {_PADDED.format("feat")} as context, feat.n_words as context_len, string_agg(m || ' ' || n, ',' order by pos) as distractors from drawn join feat using (uid) group by feat.uid, feat.ids, feat.n_words""")
def encoder_eval_examples(spark, sf_dir):
    # Each text's ids are digested once, where they are read, and not in each example that it is part of.
    rows, _ = _evaluated(spark, sf_dir, _digest)
    others = [F.concat_ws(" ", f"distractor_{k}", f"distractor_{k}_len") for k in range(dataset.DISTRACTORS)]
    return rows.select("context", "context_len", F.concat_ws(",", *others).alias("distractors"))


@query(f"""{ENCODED}, {NUMBERED}, dr as (select uid, unnest(range(1, 10)) as pos from numbered), p as (select uid, pos, {_DRAWN.format(1)} as position from dr),
  scored as (select p.uid, {_P.format("a.context", "a.utterance")} as truth, {_P.format("a.context", "b.utterance")} as other
    from p join numbered using (position) join states a on a.uid = p.uid join states b on b.uid = numbered.uid),
  r as (select uid, count(*) filter (where other > truth) as rank from scored group by uid)
  select round(avg(case when rank < 1 then 1.0 else 0.0 end), 6) as recall_at_1, round(avg(case when rank < 2 then 1.0 else 0.0 end), 6) as recall_at_2,
    round(avg(case when rank < 5 then 1.0 else 0.0 end), 6) as recall_at_5, round(avg(case when rank < 10 then 1.0 else 0.0 end), 6) as recall_at_10 from r""")
def encoder_recall(spark, sf_dir):
    rows, vocab = _evaluated(spark, sf_dir)
    return evaluate.recall_at(models.example_ranks(rows, weights_for(vocab)), 1, 2, 5, 10)


@query(f"{ENCODED}, {RERANKED} select * from neural")
def retrieve_rerank_topk(spark, sf_dir):
    own = docs(spark, sf_dir)
    vocab = dataset.vocabulary(own)
    return rank.retrieve_rerank(indexed(spark, sf_dir), own, QUESTION, vocab, weights_for(vocab), DEPTH, TOP)


@query(f"""{ENCODED}, {RERANKED}, {WORD_RANK}, {AUTHOR_RANK}, {COMBINED},
  scores as (select 'graph' as model, * from combined union all select 'neural', * from neural union all select 'search', * from bm25),
  ranked as (select model, row_number() over (partition by model order by score desc, uid desc) - 1 as rank, uid, score from scores)
  select model, rank::int as rank, ranked.uid, score, question_title from ranked join docs using (uid) where rank < {TOP}""")
def neural_fanout(spark, sf_dir):
    own = docs(spark, sf_dir)
    vocab = dataset.vocabulary(own)
    return rank.neural_fan_out(indexed(spark, sf_dir), own, QUESTION, vocab, weights_for(vocab), DEPTH, TOP)


@query("""select epoch, doc_id as uid, ((row_number() over (partition by epoch order by cast(('0x' || substr(md5('4:' || epoch || ':' || doc_id), 1, 7)) as bigint), doc_id) - 1) // 128)::int as batch
  from documents, (select unnest([0, 1, 2]) as epoch)""")
def training_batches(spark, sf_dir):
    return dataset.batches(docs(spark, sf_dir).select("uid"), models.EncoderSettings.batch, epochs=3).select("epoch", "uid", "batch")


@query(f"""{WITH}, {VOCAB}, k as (select id, unnest([1, 2, 3, 4]) as pos, word from vocab),
  v as (select k.id, pos, coalesce(e.embedding[pos]::double, cast(('0x' || substr(md5('6:' || word || ':' || pos), 1, 7)) as bigint) / 536870912.0 - 0.25) as x from k left join embeddings e on e.vec_id = k.id and k.id % 2 = 0)
  select id, string_agg(round(x * 1000000)::bigint, ' ' order by pos) as vector from v group by id""")
def embedding_init(spark, sf_dir):
    vocab = dataset.vocabulary(docs(spark, sf_dir))
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 4).alias("vector"))
    known = vocab.join(own, "id").where("id % 2 = 0").select("word", "vector")
    rows = models.initial_embeddings(vocab.select("id", "word"), known, 4)
    return rows.select("id", F.array_join(F.transform("vector", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), " ").alias("vector"))
