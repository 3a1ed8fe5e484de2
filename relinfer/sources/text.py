"""Text side: vocabulary, chat template, encoding and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relinfer.config import MAX_BROADCAST_BYTES, ModelConfig
from relinfer.operators.layers import by_sequence, by_tile, in_tiles, tile_of
from relinfer.operators.skew import lookup_join, running_sum

# Chat markup and default system prompt of the published models.
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"
SYSTEM_PROMPT = "You are a helpful AI assistant named SmolLM, trained by Hugging Face"

# Special tokens of the corpus vocabulary; the first three ids are the models' own.
SPECIALS = ("<|endoftext|>", TURN_OPEN, TURN_CLOSE, "<unk>")
UNK_ID = 3

# Token pattern of the corpus tokenizer: chat markup, newlines, words with the space in
# front of them, digits, other signs, other white space. Every character is in one token.
TOKEN_PATTERN = r"<\|im_start\|>|<\|im_end\|>|\n| ?\p{L}+|\p{N}|[^ \t\n\r\f\p{L}\p{N}]|[ \t\r\f]"

# Bytes of a vocabulary row in a broadcast, and of the longest text that is a key itself.
VOCAB_ROW_BYTES = 256
VOCAB_TEXT_BYTES = 192


# Turns and tokens whose texts are joined at once.
PART_TURNS, PART_TOKENS = 64, 4096


def load_vocab(df: DataFrame, token: str = "token", text: str = "text") -> DataFrame:
    """Vocabulary rows with the two byte markers mapped to space and newline."""
    spaced = F.replace(F.col(text), F.lit("Ġ"), F.lit(" "))
    return df.select(
        F.col(token).cast("int").alias("token"),
        F.replace(spaced, F.lit("Ċ"), F.lit("\n")).alias("text"),
    )


def _key(text: str) -> list[Column]:
    """A text as a key of bounded size: itself, or if it is long, its SHA-256."""
    long = F.octet_length(text) > VOCAB_TEXT_BYTES
    return [long.alias("_long"), F.when(long, F.sha2(text, 256)).otherwise(F.col(text)).alias("_w")]


def _lookup(
    words: DataFrame, vocab: DataFrame, unk_id: int, vocab_size: int | None, counts: DataFrame | None = None,
) -> DataFrame:
    """words (.., _w) with their token; of several ids of a text, the least.

    Long texts are looked up by their hash, so that a vocabulary of a known limit of rows is broadcast,
    whatever its texts are; without the limit the join is skew-safe. `counts` (text, n) saves counting the words for it.
    """
    rest = [c for c in words.columns if c != "_w"]
    known = vocab.select(*_key("text"), "token").groupBy("_long", "_w").agg(F.min("token").alias("token"))
    bound = None if vocab_size is None else vocab_size * VOCAB_ROW_BYTES
    if counts is not None:
        counts = counts.select(*_key("text"), "n").groupBy("_long", "_w").agg(F.sum("n").alias("_n"))
    found = lookup_join(words.select(*rest, *_key("_w")), known, ["_long", "_w"], "left", bound, counts)
    return found.withColumn("token", F.coalesce("token", F.lit(unk_id))).drop("_long", "_w")


def build_vocab(
    docs: DataFrame, max_size: int, text: str = "text", pattern: str = TOKEN_PATTERN,
    specials: Sequence[str] = (), lower: bool = False,
) -> DataFrame:
    """Vocabulary (token, text): special tokens first, then words by falling count.

    Counting combines before the shuffle; only the `max_size` most frequent
    words are ever ordered in one place.
    """
    source = F.lower(text) if lower else F.col(text)
    words = docs.select(F.explode(F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).alias("text"))
    if specials:
        words = words.where(~F.col("text").isin(*specials))
    room = max_size - len(specials)
    if room < 0:
        raise ValueError("max_size is smaller than the number of special tokens")
    top = (
        words.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("text")).limit(room)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("text"))) - 1 + len(specials)
    ranked = top.select(rank.cast("int").alias("token"), "text", "n")
    if not specials:
        return ranked
    fixed = docs.sparkSession.createDataFrame(
        [(i, s, None) for i, s in enumerate(specials)], "token int, text string, n bigint"
    )
    return fixed.unionByName(ranked)


def encode(
    df: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("seq_id",), text: str = "text",
    unk_id: int = UNK_ID, vocab_size: int | None = None, pattern: str = TOKEN_PATTERN,
    lower: bool = False, counts: DataFrame | None = None,
) -> DataFrame:
    """Text to (keys, pos, token); a word that is not in the vocabulary gets `unk_id`.

    `vocab_size` is the known limit of the vocabulary's rows; with it the vocabulary is
    broadcast, without it the join is skew-safe. `counts` (text, n) may give how often each word occurs, by which that
    join finds the frequent ones.
    """
    source = F.lower(text) if lower else F.col(text)
    words = df.select(
        *keys, F.posexplode(F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).alias("pos", "_w")
    )
    return _lookup(words, vocab, unk_id, vocab_size, counts).select(*keys, "pos", "token")


def chat_segments(
    conv: DataFrame, system_prompt: str | None = SYSTEM_PROMPT, open_assistant: bool = True,
    key: str = "conv_id",
) -> DataFrame:
    """The marked-up turns (key, turn, text) of every conversation, one row each.

    A conversation without a system turn gets one before its first turn when
    `system_prompt` is given; `open_assistant` adds the start of the reply after
    its last turn.
    """
    turn = F.concat(
        F.lit(TURN_OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(TURN_CLOSE + "\n")
    )
    segments = conv.select(key, F.col("turn").cast("bigint").alias("turn"), turn.alias("text"))
    ends = conv.groupBy(key).agg(
        F.min("turn").cast("bigint").alias("_first"), F.max("turn").cast("bigint").alias("_last"),
        F.max((F.col("role") == "system").cast("int")).alias("_system"),
    )
    extra = []
    if system_prompt is not None:
        head = f"{TURN_OPEN}system\n{system_prompt}{TURN_CLOSE}\n"
        extra.append(
            F.when(
                F.col("_system") == 0,
                F.struct((F.col("_first") - 1).alias("turn"), F.lit(head).alias("text")),
            )
        )
    if open_assistant:
        extra.append(
            F.struct(
                (F.col("_last") + 1).alias("turn"), F.lit(f"{TURN_OPEN}assistant\n").alias("text")
            )
        )
    if not extra:
        return segments
    added = ends.select(key, F.explode(F.array_compact(F.array(*extra))).alias("s")).select(key, "s.*")
    return segments.unionByName(added)


def concat_ordered(
    df: DataFrame, key: str, order: str, part: int, text: str = "text", sep: str = "", whole: bool = True,
) -> DataFrame:
    """Texts of a key joined by a unique integer `order`: (key, text), or (key, part, start, text).

    A part has the rows of `part` consecutive numbers, so that no list is longer than that and a large group is
    spread; a whole text is made of its parts. Of parts, `start` is the code points in front of it, separators included.
    """
    parts = df.groupBy(key, F.floor(F.col(order) / part).alias("part")).agg(
        _listed(order, text, sep).alias("text")
    )
    if whole:
        return parts.groupBy(key).agg(_listed("part", "text", sep).alias("text"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(sep)).over(before), F.lit(0))
    return parts.select(key, "part", start.cast("bigint").alias("start"), "text")


def _listed(order: str, text: str, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("_text"))))
    return F.array_join(F.transform(ordered, lambda s: s.getField("_text")), sep)


def render_chat(
    conv: DataFrame, system_prompt: str | None = SYSTEM_PROMPT, open_assistant: bool = True,
    key: str = "conv_id", part_turns: int | None = None,
) -> DataFrame:
    """One prompt string per conversation, put together from parts of PART_TURNS turns.

    With `part_turns` the prompt comes in numbered parts (key, part, start, prompt) of that many turns, so that a
    conversation of any length stays distributed. `encode_chat` gives tokens without joining any text.
    """
    segments = chat_segments(conv, system_prompt, open_assistant, key)
    joined = concat_ordered(segments, key, "turn", part_turns or PART_TURNS, whole=part_turns is None)
    return joined.withColumnRenamed("text", "prompt")


def encode_chat(
    conv: DataFrame, vocab: DataFrame, unk_id: int = UNK_ID, vocab_size: int | None = None,
    system_prompt: str | None = SYSTEM_PROMPT, open_assistant: bool = True,
    key: str = "conv_id", pattern: str = TOKEN_PATTERN, tiles: ModelConfig | None = None, again: bool = False,
) -> DataFrame:
    """Conversations to prompt tokens (seq_id, pos, token), turn by turn.

    Turns are cut into tokens on their own and placed by a running count of the
    tokens before them, so a conversation of any length stays distributed. No
    token spans two turns, since every turn starts with its own markup. (key,
    turn) must be unique. A turn is sent as its text, and cut where it is placed.

    For a model `tiles` the tokens lie `in_tiles` (with `again` as there). With a broadcast vocabulary it is
    the turns that are sent to the tiles, and they are cut there: a row for each token is never stored.
    """
    segments = chat_segments(conv, system_prompt, open_assistant, key)
    words = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    lengths = segments.select(key, "turn", F.size(words).cast("bigint").alias("_len"))
    ends = running_sum(lengths, key, [(F.col("turn"), False)], "_len", "_end")
    sent = tiles is not None and vocab_size is not None and vocab_size * VOCAB_ROW_BYTES <= MAX_BROADCAST_BYTES
    if sent:
        turns = _turns_in_tiles(segments.withColumnRenamed(key, "seq_id"), ends.withColumnRenamed(key, "seq_id"), tiles)
    else:
        turns = segments.join(_starts(ends, key), [key, "turn"]).withColumnRenamed(key, "seq_id")
    placed = ["_tile"] if sent else []
    cut = turns.select("seq_id", "_start", *placed, F.posexplode(words).alias("_i", "_w"))
    rows = cut.select("seq_id", (F.col("_start") + F.col("_i")).alias("pos"), *placed, "_w")
    if not sent:
        tokens = _lookup(rows, vocab, unk_id, vocab_size).select("seq_id", "pos", "token")
        return tokens if tiles is None else in_tiles(tokens, tiles, again=again)
    # A turn may reach into later tiles than the one it was sent to.
    own = tile_of("pos", tiles)
    kinds = F.array(F.lit(1), F.lit(2)) if again else F.array(F.lit(1))
    kind = F.explode(F.when(own == F.col("_tile"), F.array(F.lit(0))).otherwise(kinds)).alias("_kind")
    tokens = _lookup(rows.where(own <= F.col("_tile")), vocab, unk_id, vocab_size)
    return tokens.select("seq_id", "pos", "token", "_tile", kind).sortWithinPartitions("seq_id", "_tile", "_kind", "pos")


def _starts(ends: DataFrame, key: str = "seq_id") -> DataFrame:
    return ends.select(key, "turn", (F.col("_end") - F.col("_len")).alias("_start"))


def _turns_in_tiles(segments: DataFrame, ends: DataFrame, config: ModelConfig) -> DataFrame:
    """Turns (seq_id, _start, text, _tile) in the tile in which they start and each later one of their sequence.

    `ends` has (seq_id, turn, _len, _end). The texts of a sequence of one tile are sent once, and meet their starts
    there; those of a longer one are sent to their starts and then to the tiles. Only the longer sequences are broadcast.
    """
    # A turn that comes twice is placed as often as there are ends of it.
    stop = (F.max(F.col("_end") - F.col("_len")) + F.max("_len")).alias("_stop")
    last = ends.groupBy("seq_id", "turn").agg(stop).groupBy("seq_id").agg(F.max(tile_of(F.col("_stop") - 1, config)).alias("_last"))
    longer = F.broadcast(last.where("_last > 0"))
    texts = segments.select("seq_id", "turn", "text", F.lit(None).cast("bigint").alias("_start"))
    both = texts.unionByName(_starts(ends), allowMissingColumns=True).where("seq_id IS NOT NULL AND turn IS NOT NULL")
    alone = by_sequence(both.join(longer, "seq_id", "left_anti"))
    found = F.collect_list("_start").over(Window.partitionBy("seq_id", "turn"))
    met = alone.withColumn("_starts", found).where("text IS NOT NULL")
    first = tile_of("_start", config)
    spread = segments.join(longer, "seq_id").join(_starts(ends), ["seq_id", "turn"]).select(
        "seq_id", "_start", "text", F.explode(F.sequence(first, F.greatest(first, "_last"))).alias("_tile")
    )
    return met.select("seq_id", F.explode("_starts").alias("_start"), "text", F.lit(0).alias("_tile")).unionByName(by_tile(spread, "_tile"))


def make_prompts(tokens: DataFrame, max_new: int) -> DataFrame:
    """Length of each prompt and the position limit of its sequence."""
    return tokens.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("prompt_len"), (F.count(F.lit(1)) + max_new).alias("max_pos")
    )


def decode(
    tokens: DataFrame, vocab: DataFrame, prompts: DataFrame | None = None,
    vocab_size: int | None = None, sep: str = "", strip_stop: bool = False,
    stop: Sequence[int] = (0, 2), part_tokens: int | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Tokens to text, in order of position.

    With `prompts` (seq_id, prompt_len) only generated tokens are kept. Ids that
    the vocabulary lacks are dropped. The stop token is part of the text unless
    `strip_stop`. A text is put together from parts of PART_TOKENS positions; with `part_tokens` it
    comes in numbered parts (seq_id, part, start, text) of that many. `counts` (token, n) may give how often each token
    occurs, which otherwise is counted where the vocabulary has no `vocab_size`.
    """
    rows = tokens
    if prompts is not None:
        rows = lookup_join(tokens, prompts.select("seq_id", "prompt_len"), "seq_id").where(
            F.col("pos") >= F.col("prompt_len")
        )
    if strip_stop:
        rows = rows.where(~F.col("token").isin(*[int(s) for s in stop]))
    bound = None if vocab_size is None else vocab_size * VOCAB_ROW_BYTES
    if counts is not None:
        counts = counts.groupBy("token").agg(F.sum("n").alias("_n"))
    named = lookup_join(
        rows.select("seq_id", "pos", "token"), vocab.select("token", "text"), "token", "inner", bound, counts
    )
    return concat_ordered(named, "seq_id", "pos", part_tokens or PART_TOKENS, sep=sep, whole=part_tokens is None)
