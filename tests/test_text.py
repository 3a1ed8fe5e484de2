import pytest
from pyspark.sql import functions as F

from relinfer.operators import layers as L
from relinfer.plans import catalog
from relinfer.sources import text as T
from tests.conftest import FOLDER, SMALL

DIALOGUE = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi there\nyou"), (1, 2, "assistant", "Yes."),
    (2, 5, "user", "What?"), (3, 0, "user", ""),
]


@pytest.fixture(scope="module")
def conv(spark):
    return spark.createDataFrame(DIALOGUE, "conv_id bigint, turn bigint, role string, text string")


@pytest.fixture(scope="module")
def vocab(spark, conv):
    return T.build_vocab(conv, 64, specials=T.SPECIALS)


def by_key(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_chat_template(conv):
    got = by_key(T.render_chat(conv, system_prompt="S"), "conv_id", "prompt")
    assert got[1] == (
        "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nHi there\nyou<|im_end|>\n"
        "<|im_start|>assistant\nYes.<|im_end|>\n<|im_start|>assistant\n"
    )
    assert got[2] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nWhat?<|im_end|>\n<|im_start|>assistant\n"
    closed = by_key(T.render_chat(conv, None, False), "conv_id", "prompt")
    assert closed[2] == "<|im_start|>user\nWhat?<|im_end|>\n"


def test_parts_make_up_the_whole(spark, conv, vocab):
    whole = by_key(T.render_chat(conv), "conv_id", "prompt")
    parts = T.render_chat(conv, part_turns=2).orderBy("conv_id", "part").collect()
    assert len(parts) > len(whole)
    assert whole == {k: "".join(r.prompt for r in parts if r.conv_id == k) for k in whole}
    tokens = T.encode_chat(conv, vocab)
    texts = by_key(T.decode(tokens, vocab), "seq_id", "text")
    pieces = T.decode(tokens, vocab, part_tokens=4).orderBy("seq_id", "part").collect()
    assert texts == {k: "".join(r.text for r in pieces if r.seq_id == k) for k in texts}


def test_vocabulary_order_and_limit(spark):
    docs = spark.createDataFrame([("b-a-b-c",), ("a-b-d",)], ["text"])
    full = T.build_vocab(docs, 10, specials=["<x>"]).orderBy("token").collect()
    assert [(r.token, r.text) for r in full] == [(0, "<x>"), (1, "-"), (2, "b"), (3, "a"), (4, "c"), (5, "d")]
    assert T.build_vocab(docs, 3, specials=["<x>"]).count() == 3


def test_markers(spark):
    raw = spark.createDataFrame([(0, "Ġword"), (1, "Ċ"), (2, "ĠĊĠ"), (3, "Ã©")], ["token", "text"])
    assert by_key(T.load_vocab(raw), "token", "text") == {0: " word", 1: "\n", 2: " \n ", 3: "Ã©"}


def test_turnwise_encoding_equals_encoding_the_prompt(conv, vocab):
    whole = T.encode(T.render_chat(conv).withColumnsRenamed({"conv_id": "seq_id", "prompt": "text"}), vocab)
    turns = T.encode_chat(conv, vocab, vocab_size=64)
    rows = lambda df: sorted(map(tuple, df.select("seq_id", "pos", "token").collect()))
    assert rows(whole) == rows(turns)
    assert turns.groupBy("seq_id", "pos").count().where("count > 1").isEmpty()


def test_unknown_words(spark, vocab):
    docs = spark.createDataFrame([(1, "Hi zebra")], ["seq_id", "text"])
    for size in (None, 64):
        tokens = T.encode(docs, vocab, vocab_size=size).orderBy("pos").collect()
        assert [t.token == T.UNK_ID for t in tokens] == [False, True]


def test_every_character_comes_back(spark):
    texts = [
        "hello world, the größe is 12.5 km", "  two  spaces\t\n\n end ", "中文 é\u00a0x \x0b\r\n", "a" * 70,
        "<|im_start|>user\nHi <|im_end|>\n", " ",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), ["seq_id", "text"])
    raw = docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN_PATTERN), F.lit(0))).alias("text"))
    vocab = raw.distinct().select(F.xxhash64("text").alias("token"), "text")
    assert by_key(T.decode(T.encode(docs, vocab, unk_id=-1), vocab), "seq_id", "text") == dict(enumerate(texts))


def test_loaded_vocabulary_encodes_words_with_their_space(spark):
    raw = spark.createDataFrame([(4, "Hello"), (5, "Ġworld"), (6, "Ċ"), (9, "Ġworld")], ["token", "text"])
    docs = spark.createDataFrame([(1, "Hello world\n")], ["seq_id", "text"])
    for size in (None, 8):
        tokens = T.encode(docs, T.load_vocab(raw), vocab_size=size).orderBy("pos").collect()
        assert [t.token for t in tokens] == [4, 5, 6]


def test_long_texts_of_a_vocabulary_encode(spark):
    vocab = spark.createDataFrame([(5, "a" * 300), (6, "a" * 301), (7, "b")], ["token", "text"])
    docs = spark.createDataFrame([(1, "a" * 300), (2, "a" * 301), (3, "a" * 302), (4, "b")], ["seq_id", "text"])
    for size in (None, 3):
        assert by_key(T.encode(docs, vocab, vocab_size=size), "seq_id", "token") == {1: 5, 2: 6, 3: T.UNK_ID, 4: 7}


def test_empty_prompt_has_no_rows(spark, vocab):
    docs = spark.createDataFrame([(1, ""), (2, "Hi")], ["seq_id", "text"])
    tokens = T.encode(docs, vocab)
    assert [r.seq_id for r in T.make_prompts(tokens, 5).collect()] == [2]


def test_decode_keeps_the_stop_token_and_drops_unknown_ids(spark):
    vocab = spark.createDataFrame([(0, "<end>"), (5, "a"), (6, " b")], "token int, text string")
    log = spark.createDataFrame(
        [(1, 3, 0), (1, 0, 6), (1, 1, 5), (1, 2, 6), (2, 0, 5), (2, 1, 99), (2, 2, 5)],
        "seq_id bigint, pos bigint, token int",
    )
    assert by_key(T.decode(log, vocab), "seq_id", "text") == {1: " ba b<end>", 2: "aa"}
    assert by_key(T.decode(log, vocab, strip_stop=True), "seq_id", "text")[1] == " ba b"
    prompts = spark.createDataFrame([(1, 2), (2, 1)], "seq_id bigint, prompt_len bigint")
    assert by_key(T.decode(log, vocab, prompts, 7), "seq_id", "text") == {1: " b<end>", 2: "a"}


def test_prompt_lengths(spark):
    log = spark.createDataFrame([(1, 0, 6), (1, 1, 5)], "seq_id bigint, pos bigint, token int")
    r = T.make_prompts(log, 7).first()
    assert (r.prompt_len, r.max_pos) == (2, 9)


def test_vocabulary_counts_combine_before_the_shuffle(conv):
    from tests.conftest import plan
    text = plan(T.build_vocab(conv, 20))
    assert "partial_count" in text and "TakeOrderedAndProject" in text


def test_given_counts_save_counting_the_words(spark):
    docs = spark.createDataFrame([(1, "a b a\nc"), (2, "a x" * 50), (3, None), (4, "x" * 300)], "seq_id long, text string")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN_PATTERN), F.lit(0))).alias("text"))
    vocab = words.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("text").alias("token"), "text", "n")
    vocab = spark.createDataFrame(vocab.collect(), vocab.schema)

    def passes(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Generate")

    tokens = T.encode(docs, vocab, unk_id=-1, counts=vocab)
    texts = T.decode(tokens, vocab, counts=vocab)
    assert passes(tokens) == passes(texts) == 1 < passes(T.decode(T.encode(docs, vocab, unk_id=-1), vocab))
    assert sorted(map(tuple, tokens.collect())) == sorted(map(tuple, T.encode(docs, vocab, unk_id=-1).collect()))
    assert {r.seq_id: r.text for r in texts.collect()} == {r.seq_id: r.text for r in docs.collect() if r.text}


@pytest.mark.parametrize("again", [False, True])
def test_turns_are_cut_where_their_tile_lies(spark, vocab, monkeypatch, again):
    """Tokens of tiles without a row for each token in a shuffle: the same rows as tokens that are sent to their tiles."""
    monkeypatch.setattr(L, "ATTENTION_BLOCK", 4)
    monkeypatch.setattr(L, "TILE_BYTES", 1)
    turns = [(s, t, "user", "a b " * (s * t % 5)) for s in range(1, 6) for t in range(s)]
    turns += [(7, 0, "system", "a"), (7, 1, "user", "b a " * 9), (7, 1, "user", "b"), (8, 0, "user", None), (8, 1, "user", "a"), (None, 0, "user", "b")]
    turns += [(9, None, "user", "a"), (10, 0, "system", "")]
    conv = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    options = {"vocab_size": 64, "system_prompt": None, "open_assistant": False}
    lying = T.encode_chat(conv, vocab, tiles=SMALL, again=again, **options)
    sent = L.in_tiles(T.encode_chat(conv, vocab, **options), SMALL, again=again)
    assert lying.columns == sent.columns
    rows = sorted(map(tuple, sent.collect()))
    assert sorted(map(tuple, lying.collect())) == rows and len({r[3] for r in rows}) > 3
    parts = [list(p) for p in lying.rdd.glom().collect()]
    units = [(r.seq_id, r._tile) for p in parts for r in {(r.seq_id, r._tile): r for r in p}.values()]
    assert len(units) == len(set(units))
    for p in parts:
        order = [(r.seq_id, r._tile, r._kind, r.pos) for r in p]
        assert order == sorted(order)
    wider = T.encode_chat(conv, vocab, tiles=SMALL, again=again, **options | {"vocab_size": None})
    assert sorted(map(tuple, wider.collect())) == rows


def test_tokens_cross_no_shuffle_to_their_tile(spark):
    """Turns are sent as texts, and cut into words only where their tile lies."""
    tree = catalog._chat_tiles(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "_words" not in tree and tree.index("posexplode(regexp_extract_all") < tree.index("RepartitionByExpression")
