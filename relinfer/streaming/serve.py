"""Serve a stream of prompts through Structured Streaming."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relinfer.config import SamplingParams
from relinfer.plans.model import State, decode_step, generate, init_state, prefill
from relinfer.session import cut
from relinfer.sources.text import SYSTEM_PROMPT, decode, encode, encode_chat, make_prompts
from relinfer.sources.weights import Model


def answer_prompts(
    prompts: DataFrame, model: Model, vocab: DataFrame, params: SamplingParams, max_new: int,
    seed: int = 0, system_prompt: str | None = SYSTEM_PROMPT, chat: bool = True,
    state: State | None = None,
) -> DataFrame:
    """Prompts (seq_id, text) to generated text (seq_id, text).

    A prompt is wrapped as the user's turn of a chat, with the system prompt in front and
    the assistant's turn opened; `chat=False` continues the text itself. The answers are read
    from the run's state, which a caller that gives one can drop once they are stored.
    """
    size = model.config.vocab_size
    tokens = cut(_prompt_tokens(prompts, vocab, size, system_prompt, chat))
    log = generate(tokens, model, params, max_new, seed, state=state)
    return decode(log, vocab, make_prompts(tokens, max_new), vocab_size=size)


def _prompt_tokens(
    prompts: DataFrame, vocab: DataFrame, size: int, system_prompt: str | None, chat: bool
) -> DataFrame:
    if not chat:
        return encode(prompts, vocab, vocab_size=size)
    turns = prompts.select(
        F.col("seq_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text"
    )
    return encode_chat(turns, vocab, vocab_size=size, system_prompt=system_prompt)


def stream_generate(
    prompts_stream: DataFrame, model: Model, vocab: DataFrame, params: SamplingParams,
    sink: str, checkpoint: str, max_new: int, seed: int = 0,
    system_prompt: str | None = SYSTEM_PROMPT, chat: bool = True, trigger: dict | None = None,
) -> StreamingQuery:
    """Answer every prompt of a stream (seq_id, text) into a Parquet folder.

    A prompt is completed within its micro-batch. Each batch overwrites its own
    partition `batch_id=N`, and sampling is a function of seed, sequence and
    position, so a replayed batch changes nothing. `trigger` has the options of the
    writer's trigger; by default all that is there is answered. The state of a batch is
    deleted when its answers are written.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        state = init_state(batch.sparkSession, model)
        answers = answer_prompts(batch, model, vocab, params, max_new, seed, system_prompt, chat, state)
        answers.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        state.drop()

    return (
        prompts_stream.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@dataclass
class Server:
    """Continuous batching: every micro-batch takes its prompts in and moves all live sequences on.

    What a batch leaves is in `root` (a folder that all executors reach): keys and values in the tables of the
    state, the prompts' lengths, and a manifest of which segments count after the batch. A batch that is
    repeated starts from the manifest of the one before, overwrites its own segments, prompts and answers, and so
    changes nothing; one that fails half-way leaves nothing that is read. Draws depend on seed, sequence and
    position alone, so answers are those of `answer_prompts`, however the prompts were batched.
    """

    spark: SparkSession
    model: Model
    vocab: DataFrame
    params: SamplingParams
    root: str
    sink: str
    max_new: int
    seed: int = 0
    # Tokens that a live sequence gets in a batch.
    steps: int = 8
    # Segments from which on the state is merged; sequences that have ended leave it then.
    compact_every: int = 64
    # Buckets of a new state; the session's number of partitions if there is none.
    buckets: int | None = None

    def _manifest(self, number: int) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/manifest/{number:09d}").first().value)
        except AnalysisException:
            return None

    def _state(self, before: dict | None) -> State:
        state = init_state(self.spark, self.model, path=f"{self.root}/state", buckets=before["buckets"] if before else self.buckets)
        if before:
            state.segments, state.segment, state.merged = before["segments"], before["segment"], before["merged"]
        return state

    def _prompts(self, number: int) -> DataFrame:
        """Lengths and last positions of the sequences of all batches so far."""
        schema = "seq_id bigint, prompt_len bigint, max_pos bigint, batch int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/prompts").where(F.col("batch") <= number)

    def _open(self, frontier: DataFrame, limits: DataFrame) -> DataFrame:
        """The sequences of a frontier that may go on."""
        placed = frontier.join(limits.select("seq_id", "max_pos"), "seq_id")
        is_open = ~F.col("token").isin(*self.model.config.stop_tokens) & (F.col("pos") < F.col("max_pos"))
        return placed.where(is_open).select(frontier.columns)

    def batch(self, tokens: DataFrame | None, number: int, steps: int | None = None) -> int:
        """Take in prompts (seq_id, pos, token), make `steps` tokens of each live sequence, write the answers that ended.

        Returns the number of sequences that are still live. A sequence id must not come twice.
        """
        before = self._manifest(number - 1)
        state = self._state(before)
        last = len(state.groups) - 1
        frontier = None
        if before and before["frontier"] is not None:
            stored = state.read(last, [before["frontier"]]).where("last").select("seq_id", "pos", "token", "x", "recent")
            # Not those whose answer the batch before has written.
            frontier = self._open(stored, self._prompts(number - 1))
        lengths = None
        if tokens is not None and not tokens.isEmpty():
            end = F.least(F.col("prompt_len") + self.max_new - 1, F.lit(self.params.max_pos))
            lengths = make_prompts(tokens, self.max_new).withColumn("max_pos", end)
            lengths.write.mode("overwrite").parquet(f"{self.root}/prompts/batch={number}")
            new = prefill(tokens, self.model, state).select("seq_id", "pos", "token", "x", "recent")
            frontier = new if frontier is None else frontier.unionByName(new)
        if frontier is None:
            self._commit(number, state, None)
            return 0
        limits = self._prompts(number).select("seq_id", "max_pos")
        # What was live before the batch or came with it, and is none afterwards, has ended.
        begun = cut(frontier.select("seq_id", "pos"))
        at = None
        for step in range(self.steps if steps is None else steps):
            moved = decode_step(frontier, self.model, self.params, state, self.seed, limits)
            if moved.isEmpty():
                frontier = None
                break
            frontier, at = moved, state.segments[-1]
        going = begun.limit(0)
        if frontier is not None:
            going = self._open(frontier, limits).select("seq_id")
        ended = begun.join(going, "seq_id", "left_anti").select("seq_id")
        log = state.tokens().join(ended, "seq_id", "left_semi")
        size = self.model.config.vocab_size
        answers = decode(log, self.vocab, self._prompts(number), vocab_size=size)
        answers.write.mode("overwrite").parquet(f"{self.sink}/batch_id={number}")
        live = going.count()
        if len(state.segments) > self.compact_every:
            state.retain(cut(going))
        self._commit(number, state, at if live else None)
        # A repeated batch starts from the manifest before; what only older ones name goes.
        older = self._manifest(number - 2)
        if before and older:
            state.forget(sorted(set(older["segments"]) - set(before["segments"]) - set(state.segments)))
        return live

    def _commit(self, number: int, state: State, frontier: int | None) -> None:
        now = {"buckets": state.buckets, "segments": state.segments, "segment": state.segment, "merged": state.merged, "frontier": frontier}
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.root}/manifest/{number:09d}"
        )

    def encoded(self, prompts: DataFrame, system_prompt: str | None, chat: bool) -> DataFrame:
        return cut(_prompt_tokens(prompts, self.vocab, self.model.config.vocab_size, system_prompt, chat))

    def drop(self) -> None:
        """Delete the state of a stream that has ended; its answers stay."""
        self._state(None).drop()


def serve_stream(
    prompts_stream: DataFrame, server: Server, checkpoint: str, system_prompt: str | None = SYSTEM_PROMPT,
    chat: bool = True, trigger: dict | None = None,
) -> StreamingQuery:
    """Answer a stream of prompts (seq_id, text) by a server whose answers span micro-batches.

    Rows without text are ignored: a `heartbeat` joined to the stream keeps batches coming while
    sequences are live. `drain` ends what is live when a stream has ended.
    """

    def take(batch: DataFrame, number: int) -> None:
        server.spark = batch.sparkSession
        server.batch(server.encoded(batch.where("text IS NOT NULL"), system_prompt, chat), number)

    return (
        prompts_stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def heartbeat(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stream of prompts without text, to union with another one."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.col("value").alias("seq_id"), F.lit(None).cast("string").alias("text"))


def drain(server: Server, number: int) -> int:
    """Go on without new prompts, from batch `number`, until no sequence is live; the next batch's number."""
    while server.batch(None, number):
        number += 1
    return number + 1
