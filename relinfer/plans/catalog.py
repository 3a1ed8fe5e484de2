"""Queries over the supplied tables, one or more per operator.

Each takes (spark, folder) and returns a DataFrame with values rounded to a
fixed number of places, so that it can be compared with the SQL in
`catalog_sql`.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relinfer.config import TINY, ModelConfig, SamplingParams
from relinfer.functions import vector as V
from relinfer.operators import keyed as K
from relinfer.operators import layers as L
from relinfer.operators import sampling as S
from relinfer.operators import tensor as X
from relinfer.operators.skew import lookup_join, with_group_value
from relinfer.plans import model as M
from relinfer.session import cut, new_table_path
from relinfer.sources import text as T
from relinfer.sources.weights import Model, formula_model, rope_table
from relinfer.streaming.serve import Server, drain, serve_stream

# A model as wide as the supplied embeddings.
WIDE = ModelConfig(
    hidden=64, n_layers=1, head_dim=16, n_heads=4, n_kv_heads=2, ffn_dim=96, vocab_size=128
)
ONE_HEAD = ModelConfig(
    hidden=64, n_layers=1, head_dim=64, n_heads=1, n_kv_heads=1, ffn_dim=96, vocab_size=128
)
PARAMS = SamplingParams()
SEED = 42
# Length of the sequences that consecutive embeddings form.
SPAN = 16
DOC_VOCAB = 1000


@lru_cache(maxsize=8)
def _model(spark: SparkSession, config: ModelConfig) -> Model:
    return formula_model(spark, config)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vectors(spark, folder) -> DataFrame:
    """Every embedding as (seq_id, x)."""
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("x")
    )


def sequences(spark, folder) -> DataFrame:
    """Consecutive embeddings as sequences (seq_id, pos, x)."""
    return read(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / SPAN).alias("seq_id"), (F.col("vec_id") % SPAN).alias("pos"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def long(df: DataFrame, vec: str, keys=("seq_id",), index: str = "i", places: int = 6) -> DataFrame:
    """Vector rows as rounded components with bigint keys."""
    rows = X.to_long(df.select(*keys, vec), vec, index, "val")
    return rows.select(
        *[F.col(k).cast("bigint").alias(k) for k in [*keys, index]],
        F.round("val", places).alias("val"),
    )


def big(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ids})


# ---------------------------------------------------------- vector algebra


def dot_scores(spark, folder):
    out = X.linear_rows(vectors(spark, folder), _model(spark, WIDE).matrix("out"), "x")
    return big(out, "token").withColumn("val", F.round("val", 6))


def linear_packed(spark, folder):
    df = X.linear(vectors(spark, folder), _model(spark, WIDE).matrix("q"), "x", engine="arrow")
    return long(df, "y")


def linear_inline(spark, folder):
    df = X.linear(vectors(spark, folder), _model(spark, WIDE).matrix("k"), "x", engine="inline")
    return long(df, "y")


def linear_transposed(spark, folder):
    df = X.linear_t(vectors(spark, folder), _model(spark, WIDE).matrix("o"), "x")
    return long(df, "y")


def linear_joined(spark, folder):
    rows = _model(spark, WIDE).rows("o").withColumnRenamed("row", "in_idx")
    out = X.linear_join(vectors(spark, folder), rows, "seq_id", "x", index="i")
    return big(out, "i").withColumn("val", F.round("val", 6))


def rms_norm(spark, folder):
    gain = _model(spark, WIDE).matrix("norm")
    return long(L.rms_norm(vectors(spark, folder), gain), "x_norm")


def scale_by(spark, folder):
    df = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") + 1).cast("double").alias("s"),
    )
    return long(L.scale_by(df, "x", "s", _model(spark, WIDE).matrix("ffn_norm")), "y")


def residual_add(spark, folder):
    df = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") != 0, F.reverse(F.col("embedding").cast("array<double>"))).alias("d"),
    )
    return long(L.residual_add(df, "x", "d"), "x")


def swiglu(spark, folder):
    m = _model(spark, WIDE)
    df = X.linears(vectors(spark, folder), {"g": m.matrix("gate"), "u": m.matrix("up")}, "x")
    return long(L.swiglu(df, "g", "u"), "h")


def split_heads(spark, folder):
    return long(X.split_heads(vectors(spark, folder), "x", WIDE.head_dim), "w", ("seq_id", "head"))


def head_index(spark, folder):
    rows = X.head_index(X.to_long(vectors(spark, folder), "x", "o"), "o", WIDE.head_dim)
    return big(rows, "o", "head", "h_dim").withColumn("val", F.round("val", 6))


def transpose_matrix(spark, folder):
    heads = X.split_heads(vectors(spark, folder), "x", WIDE.head_dim)
    return long(X.transpose_matrix(heads, "seq_id", "head", "w"), "w", ("seq_id", "in_idx"))


def _label_sums(spark, folder):
    df = read(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"),
        (F.lit(1.0) / (1 + F.col("vec_id") % 5)).alias("weight"),
    )
    return X.vec_weighted_sum(df, "label", "x", "weight", WIDE.hidden)


def vec_weighted_sum(spark, folder):
    return long(_label_sums(spark, folder), "vec", ("label",))


def label_affinity(spark, folder):
    df = read(spark, folder, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    joined = lookup_join(df, _label_sums(spark, folder), "label")
    return joined.select(
        "vec_id", F.round(V.dot("x", "vec"), 6).alias("score"),
        F.round(V.sum_sq("vec"), 6).alias("norm_sq"),
    )


# ---------------------------------------------------------------- attention


def rope_lookup(spark, folder):
    table = rope_table(spark, SPAN, WIDE.head_dim)
    pos = sequences(spark, folder).select("seq_id", F.col("pos").cast("int").alias("pos"))
    out = pos.join(F.broadcast(table), "pos")
    return big(out, "pos", "h_dim").select(
        "seq_id", "pos", "h_dim", F.round("cos_val", 6).alias("cos_val"),
        F.round("sin_val", 6).alias("sin_val"),
    )


def rope_apply(spark, folder):
    return long(L.rope(sequences(spark, folder), "x", 64), "x", ("seq_id", "pos"))


def rope_joined(spark, folder):
    table = rope_table(spark, SPAN, WIDE.head_dim)
    df = L.rope_join(sequences(spark, folder), table, WIDE.head_dim, SPAN, "x", "x")
    return long(df, "x", ("seq_id", "pos"))


def _qkv(spark, folder):
    return sequences(spark, folder).select(
        "seq_id", "pos", F.col("x").alias("q"), F.slice("x", 1, WIDE.kv_dim).alias("k"),
        F.slice("x", WIDE.kv_dim + 1, WIDE.kv_dim).alias("v"),
    )


def attn_scores(spark, folder):
    scores = L.attn_scores(_qkv(spark, folder), WIDE)
    out = scores.select("seq_id", "pos", "head", F.explode(F.arrays_zip("kpos", "val")).alias("s"))
    return big(
        out.select("seq_id", "pos", "head", "s.kpos", F.round("s.val", 6).alias("val")),
        "seq_id", "pos", "head", "kpos",
    )


def attn_weights(spark, folder):
    scores = L.attn_softmax(L.attn_scores(_qkv(spark, folder), WIDE))
    out = scores.select("seq_id", "pos", "head", F.explode(F.arrays_zip("kpos", "prob")).alias("s"))
    return big(
        out.select("seq_id", "pos", "head", "s.kpos", F.round("s.prob", 6).alias("prob")),
        "seq_id", "pos", "head", "kpos",
    )


def causal_attention(spark, folder):
    turned = L.rope(sequences(spark, folder), "x", 64, out="q")
    qkv = turned.select("seq_id", "pos", "q", F.col("q").alias("k"), F.col("x").alias("v"))
    weights = L.attn_softmax(L.attn_scores(qkv, ONE_HEAD))
    return long(L.attn_mix(weights, qkv, ONE_HEAD), "o", ("seq_id", "pos"))


def gqa_attention(spark, folder):
    return long(L.attend(_qkv(spark, folder), WIDE), "o", ("seq_id", "pos"))


def kv_append(spark, folder):
    qkv = _qkv(spark, folder)
    cache = qkv.select("seq_id", "pos", "k", "v")
    after = qkv.withColumn("pos", F.col("pos") + SPAN)
    grown = M.kv_append(cache, after.select("seq_id", "pos", "k"), after.select("seq_id", "pos", "v"))
    return grown.select(
        "seq_id", "pos", F.round(V.sum_sq("k"), 6).alias("k_sq"), F.round(V.sum_sq("v"), 6).alias("v_sq")
    )


# ----------------------------------------------------------------- sampling


def _event_logits(spark, folder):
    return read(spark, folder, "events").select(
        "user_id", "event_type", F.col("event_id").alias("token"), "value"
    )


def softmax_grouped(spark, folder):
    out = S.softmax(_event_logits(spark, folder), "user_id", "value")
    return out.select("token", "user_id", F.round("prob", 9).alias("prob"))


def softmax_hot(spark, folder):
    out = S.softmax(_event_logits(spark, folder), "event_type", "value")
    return out.select("token", "event_type", F.round("prob", 9).alias("prob"))


def temperature(spark, folder):
    out = S.temperature(_event_logits(spark, folder), PARAMS.temp, "value")
    return out.select("token", F.round("t_val", 6).alias("t_val"))


def with_params(spark, folder):
    """Temperatures of the users with an even number; the others have the default."""
    events = _event_logits(spark, folder)
    params = events.where("user_id % 2 = 0").groupBy("user_id").agg(
        (F.count(F.lit(1)) % 3 * 0.25 + 0.5).alias("temp")
    )
    out = S.temperature(S.with_params(events, params, ["user_id"]), "temp", "value")
    return out.select("token", "user_id", F.round("t_val", 6).alias("t_val"))


def _event_probs(spark, folder, key):
    return S.softmax(S.temperature(_event_logits(spark, folder), 50.0, "value"), key, "t_val")


def min_p(spark, folder):
    out = S.min_p_filter(_event_probs(spark, folder, "user_id"), "user_id", PARAMS.min_p)
    return out.select("user_id", "token", F.round("prob", 9).alias("prob"))


def top_k(spark, folder):
    out = S.top_k_filter(_event_probs(spark, folder, "user_id"), "user_id", 10)
    return out.select("user_id", "token", F.round("prob", 9).alias("prob"))


def top_p(spark, folder):
    out = S.top_p_filter(_event_probs(spark, folder, "user_id"), "user_id", PARAMS.top_p)
    return out.select("user_id", "token", F.round("prob", 9).alias("prob"))


def top_p_hot(spark, folder):
    out = S.top_p_filter(_event_probs(spark, folder, "event_type"), "event_type", PARAMS.top_p)
    return out.select("event_type", "token", F.round("prob", 9).alias("prob"))


def nucleus_lines(spark, folder):
    """Nucleus over three groups that hold all order lines."""
    lines = read(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("token"),
        (F.col("l_extendedprice") / 20000.0).alias("t_val"),
    )
    out = S.top_p_filter(S.softmax(lines, "l_returnflag", "t_val"), "l_returnflag", PARAMS.top_p)
    return out.select("l_returnflag", "token", F.round("prob", 9).alias("prob"))


def uniform_draw(spark, folder):
    return read(spark, folder, "events").select(
        "event_id", F.round(V.uniform(SEED, "event_id", "event_type"), 6).alias("u")
    )


def gumbel_sample(spark, folder):
    scaled = S.temperature(_event_logits(spark, folder), 50.0, "value")
    return S.gumbel_sample(scaled, "user_id", SEED)


def _logit_rows(spark, folder):
    return X.linear_rows(vectors(spark, folder), _model(spark, WIDE).matrix("out"), "x")


def filter_logits(spark, folder):
    out = S.filter_logits(_logit_rows(spark, folder), PARAMS)
    return big(out, "token").select("seq_id", "token", F.round("prob", 9).alias("prob"))


def score_and_sample(spark, folder):
    """For each embedding, score all items and draw one; no shuffle anywhere."""
    logits = X.linear(vectors(spark, folder), _model(spark, WIDE).matrix("out"), "x", "logits")
    kept = logits.select("seq_id", S.survivors_vec("logits", PARAMS).alias("kept"))
    drawn = kept.select("seq_id", S.gumbel_vec("kept", SEED, "seq_id").alias("token"))
    return big(drawn, "token")


# --------------------------------------------------------------------- text


def _item_vocab(spark, folder, size=WIDE.vocab_size):
    return T.build_vocab(read(spark, folder, "benchmark"), size, specials=T.SPECIALS)


def item_tokens(spark, folder, size=WIDE.vocab_size):
    """Tokens (seq_id, pos, token) of every benchmark text."""
    items = read(spark, folder, "benchmark").select(F.col("item_id").alias("seq_id"), "text")
    return T.encode(items, _item_vocab(spark, folder, size), vocab_size=size)


def vocab_build(spark, folder):
    return big(T.build_vocab(read(spark, folder, "documents"), DOC_VOCAB), "token", "n")


def load_vocab(spark, folder):
    raw = read(spark, folder, "documents").select(
        F.col("doc_id").alias("token"), F.concat(F.lit("Ġ"), "lang", F.lit("Ċ"), "text").alias("text")
    )
    return big(T.load_vocab(raw), "token")


def encode(spark, folder):
    docs = read(spark, folder, "documents")
    vocab = T.build_vocab(docs, DOC_VOCAB)
    out = T.encode(docs, vocab, ("doc_id",), unk_id=DOC_VOCAB, vocab_size=DOC_VOCAB)
    return big(out, "pos", "token")


def decode_text(spark, folder):
    docs = read(spark, folder, "documents")
    vocab = T.build_vocab(docs, DOC_VOCAB)
    tokens = T.encode(
        docs.withColumnRenamed("doc_id", "seq_id"), vocab, unk_id=DOC_VOCAB, vocab_size=DOC_VOCAB
    )
    return T.decode(tokens, vocab, vocab_size=DOC_VOCAB)


def text_round_trip(spark, folder):
    """Documents cut into tokens and joined again, with a vocabulary of all their tokens."""
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("seq_id"), "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN_PATTERN), F.lit(0))).alias("text"))
    # Counted once, for the vocabulary and for both joins.
    vocab = cut(words.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("text").alias("token"), "text", "n"))
    return T.decode(T.encode(docs, vocab, unk_id=-1, counts=vocab), vocab, counts=vocab)


def chat_render(spark, folder):
    return T.render_chat(read(spark, folder, "conversations"))


def chat_parts(spark, folder):
    """Prompts in parts of two turns, with the place of each part."""
    return T.render_chat(read(spark, folder, "conversations"), part_turns=2)


def decode_parts(spark, folder):
    """Texts of the documents in parts of 100 tokens, with the place of each part."""
    docs = read(spark, folder, "documents")
    vocab = T.build_vocab(docs, DOC_VOCAB)
    tokens = T.encode(
        docs.withColumnRenamed("doc_id", "seq_id"), vocab, unk_id=DOC_VOCAB, vocab_size=DOC_VOCAB
    )
    return T.decode(tokens, vocab, vocab_size=DOC_VOCAB, part_tokens=100)


def encode_long(spark, folder):
    """Every document is a word of the vocabulary as a whole, whatever its length."""
    docs = read(spark, folder, "documents")
    vocab = docs.groupBy("text").agg(F.min("doc_id").cast("int").alias("token"))
    every = T.encode(docs, vocab, ["doc_id"], unk_id=-1, vocab_size=docs.count(), pattern="(?s).+")
    return big(every, "token").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def _chat_tiles(spark, folder, again=False):
    """Tokens of the conversations, where attention takes them as they lie."""
    return _chat_tokens(spark, folder, tiles=TINY, again=again)


def _chat_tokens(spark, folder, **places):
    conv = read(spark, folder, "conversations")
    vocab = T.build_vocab(conv, TINY.vocab_size, specials=T.SPECIALS)
    return T.encode_chat(conv, vocab, vocab_size=TINY.vocab_size, **places)


def chat_tokens(spark, folder):
    return big(_chat_tokens(spark, folder), "token")


def prompt_lengths(spark, folder):
    return T.make_prompts(_chat_tokens(spark, folder), 100)


# -------------------------------------------------------------- token rules


def repetition_penalty(spark, folder):
    out = S.repetition_penalty(_logit_rows(spark, folder), item_tokens(spark, folder))
    return big(out, "token").withColumn("val", F.round("val", 6))


def repetition_penalty_at(spark, folder):
    logits = X.linear_rows(sequences(spark, folder), _model(spark, WIDE).matrix("out"), "x")
    out = S.repetition_penalty(logits, item_tokens(spark, folder), window=4, at="pos")
    return big(out, "pos", "token").withColumn("val", F.round("val", 6))


def stop_rules(spark, folder):
    tokens = item_tokens(spark, folder)
    limit = T.make_prompts(tokens, 0).withColumn("max_pos", F.col("max_pos") - F.col("seq_id") % 2)
    out = (
        S.next_pos(tokens).join(S.last_token(tokens), "seq_id")
        .join(S.is_stopped(tokens, (0, 2, 4)), "seq_id").join(S.is_exhausted(tokens, limit), "seq_id")
    )
    return big(out, "pos", "token")


def next_token(spark, folder):
    tokens = item_tokens(spark, folder)
    out = S.next_token(
        tokens, _logit_rows(spark, folder), PARAMS, SEED, stop=(0, 2, 5),
        max_pos=T.make_prompts(tokens, 100),
    )
    return big(out, "pos", "token")


def choose_token(spark, folder):
    logits = X.linear_rows(sequences(spark, folder), _model(spark, WIDE).matrix("out"), "x")
    best = logits.groupBy("seq_id", "pos").agg(
        F.max_by("token", F.struct("val", -F.col("token"))).alias("token")
    )
    return big(S.choose_token(item_tokens(spark, folder), best), "pos", "token")


# -------------------------------------------------------------------- model


def _prompt_tokens(spark, folder):
    return item_tokens(spark, folder, TINY.vocab_size)


def embed(spark, folder):
    m = _model(spark, TINY)
    x = L.embed(_prompt_tokens(spark, folder), m.rows("emb"), TINY.matrix_bytes("emb"))
    return long(x, "x", ("seq_id", "pos"))


def embed_joined(spark, folder):
    """Embedding lookup without a size bound: the skew-safe join."""
    x = L.embed(_prompt_tokens(spark, folder), _model(spark, TINY).rows("emb"))
    return long(x, "x", ("seq_id", "pos"))


def block_forward(spark, folder):
    m = _model(spark, TINY)
    x = M.ffn(M.attention(M.embedded(_prompt_tokens(spark, folder), m), m, 0), m, 0)
    return long(x, "x", ("seq_id", "pos"))


def model_logits(spark, folder):
    out = M.forward(_prompt_tokens(spark, folder), _model(spark, TINY))
    return long(out, "logits", ("seq_id", "pos"), "token")


def greedy_generate(spark, folder):
    out = M.generate(_prompt_tokens(spark, folder), _model(spark, TINY), PARAMS.greedy(), 3, SEED)
    return big(out, "token")


def sampled_generate(spark, folder):
    out = M.generate(_prompt_tokens(spark, folder), _model(spark, TINY), PARAMS, 3, SEED)
    return big(out, "token")


def blocked_logits(spark, folder):
    """All logits by a model of which 600 bytes are broadcast at once: every matrix in blocks."""
    tight = Model(TINY, _model(spark, TINY).weights, max_bytes=600)
    return long(M.forward(_prompt_tokens(spark, folder), tight), "logits", ("seq_id", "pos"), "token")


def _settings(ids):
    """Settings for every second id; the others have the defaults."""
    n = F.col("seq_id")
    return ids.where(n % 2 == 0).select(
        "seq_id", (n % 3 * 0.25 + 0.5).alias("temp"), (n % 4 * 0.125 + 0.5).alias("top_p"),
        (n % 7 * 5 + 1).alias("top_k"), (n % 5 * 0.03125).alias("min_p"),
        (n % 4 * 0.25 + 1).alias("rep_pen"), (n % 100 + 20).alias("max_pos"),
    )


def filter_with_params(spark, folder):
    logits = _logit_rows(spark, folder)
    out = S.filter_logits(logits, _settings(vectors(spark, folder).select("seq_id")))
    return big(out, "token").select("seq_id", "token", F.round("prob", 9).alias("prob"))


def generate_with_params(spark, folder):
    """Continuations with settings of their own, of which every third has a token forced on it."""
    tokens = _prompt_tokens(spark, folder)
    ends = S.next_pos(tokens)
    forced = ends.where("seq_id % 3 = 1").select(
        "seq_id", (F.col("pos") + 1).alias("pos"), (F.col("seq_id") % 50 + 20).alias("token")
    )
    out = M.generate(tokens, _model(spark, TINY), _settings(ends), 3, SEED, forced=forced)
    return big(out, "token")


def generate_unknown(spark, folder):
    """Greedy continuation of prompts in which every rarer token lies outside the vocabulary."""
    model = Model(replace(TINY, unk_token=T.UNK_ID), _model(spark, TINY).weights)
    tokens = _prompt_tokens(spark, folder).withColumn(
        "token", F.when(F.col("token") > 200, F.col("token") + 1000).otherwise(F.col("token")).cast("int")
    )
    return big(M.generate(tokens, model, PARAMS.greedy(), 2, SEED), "token")


def long_attention(spark, folder):
    """Attention over all tokens of the conversations, which are longer than its blocks."""
    model = _model(spark, TINY)
    x = M.attention(M.embedded(_chat_tiles(spark, folder), model), model, 0)
    return long(x, "x", ("seq_id", "pos"))


def blocked_attention(spark, folder):
    """The same by partial softmax over pairs of blocks."""
    model = _model(spark, TINY)
    x = M.attention(M.embedded(_chat_tiles(spark, folder), model), model, 0, L.attend_blocked)
    return long(x, "x", ("seq_id", "pos"))


def chat_scores(spark, folder):
    """Scores of all tokens of the conversations: how many, the greatest, and the greatest probability."""
    model = _model(spark, TINY)
    rows = M.projected(M.embedded(_chat_tiles(spark, folder, again=True), model), model, 0)
    weights = L.attn_softmax(L.attn_scores(rows, TINY))
    out = L.attn_summary(weights).groupBy("seq_id", "pos", "head").agg(
        F.sum("n").alias("n"), F.round(F.max("top"), 6).alias("top"), F.round(F.max("prob"), 6).alias("prob"),
    )
    return big(out, "head")


def chat_mix(spark, folder):
    """Values of all tokens of the conversations, mixed by their attention weights."""
    model = _model(spark, TINY)
    rows = M.projected(M.embedded(_chat_tiles(spark, folder, again=True), model), model, 0)
    mixed = L.attn_mix(L.attn_softmax(L.attn_scores(rows, TINY)), None, TINY)
    return big(long(mixed, "o", ("seq_id", "pos", "head")), "head")


def answer_items(spark, folder):
    vocab = _item_vocab(spark, folder, TINY.vocab_size)
    tokens = _prompt_tokens(spark, folder)
    log = M.generate(tokens, _model(spark, TINY), PARAMS, 3, SEED)
    return T.decode(log, vocab, T.make_prompts(tokens, 3), vocab_size=TINY.vocab_size)


def stream_answers(spark, folder):
    """The same items as a stream: answers of a server whose sequences live through several batches."""
    items = read(spark, folder, "benchmark").select(F.col("item_id").alias("seq_id"), "text")
    root = new_table_path(spark, "stream")
    items.repartitionByRange(2, "seq_id").write.parquet(f"{root}/in")
    prompts = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    vocab = _item_vocab(spark, folder, TINY.vocab_size)
    server = Server(spark, _model(spark, TINY), vocab, PARAMS, f"{root}/run", f"{root}/out", 3, SEED, steps=2, buckets=2)
    query = serve_stream(prompts, server, f"{root}/checkpoint", chat=False)
    query.awaitTermination()
    drain(server, query.lastProgress.batchId + 1)
    server.drop()
    return spark.read.parquet(f"{root}/out").select("seq_id", "text")


def insert_missing(spark, folder):
    """Rows of the orders' lines, of which a part was stored before and a part comes twice."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    stored = lines.where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    new = lines.withColumn("l_partkey", -F.col("l_partkey")).unionByName(lines.where("l_linenumber = 3"))
    grown = K.insert_missing(stored, new, ["l_orderkey", "l_linenumber"])
    return K.unique(grown, ["l_orderkey", "l_linenumber"]).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts")
    )


QUERIES = {
    f.__name__: f
    for f in (
        score_and_sample, dot_scores, linear_packed, linear_inline, linear_transposed,
        linear_joined, rms_norm, scale_by, residual_add, swiglu, split_heads, head_index,
        transpose_matrix, vec_weighted_sum, label_affinity, rope_lookup, rope_apply, rope_joined,
        attn_scores, attn_weights, causal_attention, gqa_attention, kv_append, softmax_grouped,
        softmax_hot, temperature, with_params, min_p, top_k, top_p, top_p_hot, nucleus_lines, uniform_draw,
        gumbel_sample, filter_logits, vocab_build, load_vocab, encode, decode_text, chat_render,
        chat_tokens, prompt_lengths, repetition_penalty, repetition_penalty_at, stop_rules,
        next_token, choose_token, embed, embed_joined, block_forward, model_logits,
        greedy_generate, sampled_generate, answer_items, generate_unknown, long_attention, blocked_attention, chat_scores, chat_mix,
        stream_answers, insert_missing, chat_parts, decode_parts, encode_long,
        text_round_trip, blocked_logits, filter_with_params, generate_with_params,
    )
}
