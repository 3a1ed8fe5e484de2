from pathlib import Path

from pyspark.sql import functions as F

from relinfer.config import SamplingParams
from relinfer.session import shared_dir
from relinfer.sources import text as T
from relinfer.sources.weights import formula_model
from relinfer.streaming import serve
from relinfer.streaming.serve import Server, answer_prompts, drain, serve_stream, stream_generate
from tests.conftest import FOLDER, SMALL


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    model = formula_model(spark, SMALL)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(F.col("item_id").alias("seq_id"), "text")
    vocab = T.build_vocab(items, SMALL.vocab_size, specials=T.SPECIALS)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    items.where("seq_id < 4").coalesce(1).write.parquet(source)
    items.where("seq_id >= 4 and seq_id < 8").coalesce(1).write.mode("append").parquet(source)
    prompts = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(checkpoint):
        query = stream_generate(prompts, model, vocab, SamplingParams(), sink, str(tmp_path / checkpoint), 2, seed=3)
        query.awaitTermination()
        return sorted((r.seq_id, r.text) for r in spark.read.parquet(sink).collect())

    def states():
        return set(Path(shared_dir(spark).removeprefix("file:")).glob("relinfer-state-*"))

    before = states()
    streamed = run("first")
    assert len(spark.read.parquet(sink).select("batch_id").distinct().collect()) == 2
    assert states() == before
    batch = answer_prompts(items.where("seq_id < 8"), model, vocab, SamplingParams(), 2, seed=3)
    assert streamed == sorted((r.seq_id, r.text) for r in batch.collect())
    # A new checkpoint replays both batches into the same partitions.
    assert run("second") == streamed


def _server(spark, model, vocab, folder, **options):
    return Server(spark, model, vocab, SamplingParams(), str(folder / "state"), str(folder / "out"), 4, 3, **options)


def test_answers_span_batches_and_restarts(spark, tmp_path, monkeypatch):
    """Prompts of three batches, a failure in the middle, a restart: the answers are those of one batch run."""
    model = formula_model(spark, SMALL)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(F.col("item_id").alias("seq_id"), "text")
    vocab = T.build_vocab(items, SMALL.vocab_size, specials=T.SPECIALS)
    source = str(tmp_path / "in")
    for k in range(3):
        items.where(f"seq_id >= {2 * k} and seq_id < {2 * k + 2}").coalesce(1).write.mode("append").parquet(source)
    prompts = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(source)
    server = _server(spark, model, vocab, tmp_path, steps=1, compact_every=2)
    written, failures = serve.decode, []

    def failing(*args, **kwargs):
        # The second batch has stored its keys and values by now.
        if len(failures) == 1:
            failures.append(True)
            raise RuntimeError("lost")
        failures.append(False)
        return written(*args, **kwargs)

    monkeypatch.setattr(serve, "decode", failing)
    try:
        serve_stream(prompts, server, str(tmp_path / "check"), chat=False).awaitTermination()
    except Exception as error:
        assert "lost" in str(error)
    assert failures == [False, True]
    serve_stream(prompts, server, str(tmp_path / "check"), chat=False).awaitTermination()
    live = server._manifest(2)["frontier"]
    assert live is not None
    number = drain(server, 3)
    answers = spark.read.parquet(server.sink)
    assert answers.select("batch_id").distinct().count() > 1
    got = sorted((r.seq_id, r.text) for r in answers.collect())
    batch = answer_prompts(items.where("seq_id < 6"), model, vocab, SamplingParams(), 4, seed=3, chat=False)
    assert got == sorted((r.seq_id, r.text) for r in batch.collect())
    # A batch that is repeated changes nothing.
    server.batch(None, number - 1)
    assert got == sorted((r.seq_id, r.text) for r in spark.read.parquet(server.sink).collect())
    server.drop()


def test_server_without_prompts(spark, tmp_path):
    model = formula_model(spark, SMALL)
    vocab = spark.createDataFrame([(5, "a")], "token int, text string")
    server = _server(spark, model, vocab, tmp_path)
    none = spark.createDataFrame([], "seq_id bigint, pos bigint, token int")
    assert server.batch(none, 0) == 0 and server.batch(None, 1) == 0
    assert drain(server, 2) == 3
