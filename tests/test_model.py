import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from relinfer.config import SamplingParams
from relinfer.operators import layers as L
from relinfer.operators import tensor as X
from relinfer.operators.sampling import survivors_vec
from relinfer.plans import catalog
from relinfer.plans import model as M
from relinfer.sources.weights import (
    Model, check_weights, infer_config, load_weights, rope_table, save_weights,
)
from tests import reference as R
from tests.conftest import FOLDER, SMALL, plan

GREEDY = SamplingParams().greedy()


def prompt_lists(tokens):
    out = {}
    for r in tokens.orderBy("seq_id", "pos").collect():
        out.setdefault(r.seq_id, []).append(r.token)
    return out


def test_forward_equals_brute_force(model, prompts):
    got = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, model).collect()}
    assert len(got) == prompts.count()
    for s, tokens in prompt_lists(prompts).items():
        for n in (1, len(tokens)):
            assert np.allclose(got[s, n - 1], R.logits(model, tokens[:n]), atol=1e-12)


def test_layers_in_separate_jobs_agree(model, prompts):
    one = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, model, 1).collect()}
    all_ = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, model, 4).collect()}
    assert one.keys() == all_.keys() and all(np.allclose(one[k], all_[k], atol=1e-12) for k in one)


def test_later_positions_do_not_leak(model, prompts):
    whole = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, model).collect()}
    short = M.forward(prompts.where("pos < 3"), model).collect()
    assert all(np.allclose(r.logits, whole[r.seq_id, r.pos], atol=1e-12) for r in short)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_attention_in_blocks_equals_brute_force(model, prompts, monkeypatch, block):
    """Sequences of several blocks: every position attends to all before it."""
    monkeypatch.setattr(L, "ATTENTION_BLOCK", block)
    got = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, model).collect()}
    assert len(got) == prompts.count()
    for s, tokens in prompt_lists(prompts).items():
        assert np.allclose(got[s, len(tokens) - 1], R.logits(model, tokens), atol=1e-12)
    out = prompt_lists(M.generate(prompts, model, GREEDY, 3))
    for s, tokens in prompt_lists(prompts).items():
        assert out[s] == R.greedy(model, tokens, 3)


def test_no_pairs_and_no_row_udf_in_the_layers(model, prompts):
    text = plan(M.layers(M.embedded(prompts, model), model))
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("layers_per_job", [1, 4])
def test_greedy_generation_equals_brute_force(model, prompts, layers_per_job):
    """Decoding through the stored keys and values equals recomputing everything."""
    out = prompt_lists(M.generate(prompts, model, GREEDY, 4, layers_per_job=layers_per_job, compact_every=2))
    for s, tokens in prompt_lists(prompts).items():
        assert out[s] == R.greedy(model, tokens, 4)


def test_sampling_is_reproducible_and_seeded(model, prompts):
    params = SamplingParams(temp=2.0, min_p=0.0, top_p=1.0)
    a, b, c = (prompt_lists(M.generate(prompts, model, params, 3, seed)) for seed in (1, 1, 2))
    assert a == b and a != c


def test_stop_token_ends_a_sequence_and_is_kept(spark, model, prompts):
    forced = spark.createDataFrame([(1, 6, 2), (2, 3, 0)], "seq_id bigint, pos bigint, token int")
    out = prompt_lists(M.generate(prompts, model, GREEDY, 3, forced=forced))
    assert len(out[1]) == 7 and out[1][-1] == 2
    assert len(out[2]) == 4 and out[2][-1] == 0
    assert len(out[3]) <= 10


def test_prompt_that_ends_in_a_stop_token(spark, model):
    tokens = spark.createDataFrame([(1, 0, 5), (1, 1, 2)], "seq_id bigint, pos bigint, token int")
    assert prompt_lists(M.generate(tokens, model, GREEDY, 3)) == {1: [5, 2]}


def test_both_length_limits(spark, model, prompts):
    limit = spark.createDataFrame([(1, 5), (2, 100), (3, 7)], "seq_id bigint, max_pos bigint")
    out = prompt_lists(M.generate(prompts, model, GREEDY, 2, max_pos=limit))
    # Position 4 is the last of the first prompt; the limit allows positions up to 5.
    assert len(out[1]) <= 6 and len(out[2]) <= 5 and len(out[3]) <= 8


def test_unknown_token_is_an_error_or_the_unknown_one(spark, model):
    tokens = spark.createDataFrame([(1, 0, 5), (1, 1, 999), (2, 0, 999)], "seq_id bigint, pos bigint, token int")
    with pytest.raises(Exception, match="no embedding for token 999"):
        M.forward(tokens, model).collect()
    lenient = Model(dataclasses.replace(SMALL, unk_token=3), model.weights)
    out = prompt_lists(M.generate(tokens, lenient, GREEDY, 2))
    for s, log in ((1, [5, 3]), (2, [3])):
        assert out[s][:len(log)] == [t if t != 3 else 999 for t in log]
        assert out[s][len(log):] == R.greedy(model, log, 2)[len(log):]


def test_keys_of_the_log_are_unique(model, prompts):
    log = M.generate(prompts, model, GREEDY, 3)
    assert log.groupBy("seq_id", "pos").count().where("count > 1").isEmpty()


def test_default_length_limit(model, prompts):
    out = prompt_lists(M.generate(prompts, model, SamplingParams(max_pos=5).greedy(), 3))
    assert [len(out[s]) for s in (1, 3)] == [6, 7] or len(out[1]) <= 6


def test_state_can_be_dropped(spark, model, prompts):
    state = M.init_state(spark, model)
    assert M.generate(prompts, model, GREEDY, 1, state=state).count() > prompts.count()
    state.drop()
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|PATH_NOT_FOUND|does not exist"):
        state.tokens().count()


def test_constants_are_stored_with_the_weights(spark, model, tmp_path):
    config = dataclasses.replace(SMALL, rms_eps=1e-6, rope_theta=1e4, unk_token=3)
    save_weights(model.weights, str(tmp_path / "w"), config)
    assert load_weights(spark, str(tmp_path / "w")).config == config


def test_penalty_window_slides_with_generation(spark, model):
    small = Model(dataclasses.replace(SMALL, rep_window=1, protected_tokens=3), model.weights)
    tokens = spark.createDataFrame([(1, p, t) for p, t in enumerate([20, 21, 22, 23])], "seq_id bigint, pos bigint, token int")
    state = M.init_state(spark, small)
    frontier = M.prefill(tokens, small, state)
    assert frontier.first().recent == [22, 23]
    step = M.decode_step(frontier, small, GREEDY, state, 0).first()
    assert step.recent == [23, step.token]


@pytest.mark.parametrize("bound", [100, 400, 1500])
def test_tensors_beyond_the_broadcast_bound(model, prompts, bound):
    """Blocks of one output, of several, and a mix of whole tensors and blocks."""
    expected = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, model).collect()}
    tight = Model(SMALL, model.weights, max_bytes=bound)
    got = {(r.seq_id, r.pos): r.logits for r in M.forward(prompts, tight).collect()}
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[k], expected[k], atol=1e-12) for k in got)
    assert not [k for k, v in tight._cache.items() if np.ndim(v) != 1]


def test_blocks_keep_rows_without_a_vector(spark, model):
    for tensor in ("q", "down"):
        x = [0.5] * (16 if tensor == "down" else 12)
        df = spark.createDataFrame([(1, 0, x, "a"), (2, 0, None, None)], "seq_id int, pos int, x array<double>, y string")
        whole, blocks = (
            {r.seq_id: r.y for r in m.multiply(df, {"y": tensor}, "x", 1).collect()}
            for m in (Model(SMALL, model.weights), Model(SMALL, model.weights, max_bytes=300))
        )
        assert np.allclose(whole[1], blocks[1], atol=1e-12) and whole[2] is None and blocks[2] is None


def test_shards_pass_neither_the_driver_nor_a_broadcast(model, prompts, monkeypatch):
    """A model of which nothing fits but single rows runs without a fetch of a matrix."""
    tight = Model(SMALL, model.weights, max_bytes=96)
    fetched = []
    fetch = Model._fetch
    monkeypatch.setattr(Model, "_fetch", lambda self, tensors, layer: (fetched.extend(tensors), fetch(self, tensors, layer)))
    out = M.forward(prompts, tight)
    assert out.count() == prompts.count() and set(fetched) <= {"norm", "ffn_norm", "out_norm"}
    assert not tight._kernels and not tight._sent


def test_settings_of_each_sequence(spark, model, prompts):
    """A table of settings does for each sequence what they do for all; nulls and missing ones are defaults."""
    table = spark.createDataFrame(
        [(1, 2.0, 1, 5), (2, None, 3, None)], "seq_id bigint, temp double, top_k int, max_pos bigint"
    )
    out = prompt_lists(M.generate(prompts, model, table, 1, seed=5))
    alone = {1: SamplingParams(temp=2.0, top_k=1, max_pos=5), 2: SamplingParams(top_k=3)}
    for s, params in alone.items():
        assert out[s] == prompt_lists(M.generate(prompts.where(f"seq_id = {s}"), model, params, 1, seed=5))[s]
    assert len(out[3]) == 8


def test_settings_of_a_row_are_checked(spark):
    row = "array(1D, 2D) logits, 0D temp, 1D top_p, 2 top_k, 0D min_p, 1D rep_pen, 9 max_pos"
    df = spark.sql(f"SELECT {row}")
    with pytest.raises(Exception, match="temp must be positive"):
        df.select(survivors_vec("logits", None)).collect()


def test_weights_round_trip(spark, model, tmp_path):
    path = str(tmp_path / "weights")
    narrow = model.weights.withColumn("w", F.col("w").cast("array<float>"))
    save_weights(narrow, path)
    loaded = load_weights(spark, path, SMALL)
    assert np.allclose(loaded.matrix("k", 1).values, model.matrix("k", 1).values, atol=1e-6)
    assert "PartitionFilters: [isnotnull(tensor" in plan(loaded.rows("q", 1))
    assert infer_config(loaded.weights, head_dim=8) == SMALL
    with pytest.raises(ValueError, match="expected shape"):
        check_weights(model.weights.where("not (tensor = 'q' and row = 3)"), SMALL)


@pytest.mark.parametrize("block", [2, 512])
def test_attention_steps_equal_the_fused_form(spark, monkeypatch, block):
    monkeypatch.setattr(L, "ATTENTION_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(s, p, rng.normal(size=48).tolist(), rng.normal(size=16).tolist(), rng.normal(size=16).tolist())
            for s, n in ((1, 5), (2, 7), (3, 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "seq_id int, pos int, q array<double>, k array<double>, v array<double>")
    weights = L.attn_softmax(L.attn_scores(df, SMALL))
    seen = {}
    for r in weights.collect():
        assert {k // block for k in r.kpos} == {r.kblock} and len(r.kpos) <= block
        for k, p in zip(r.kpos, r.prob):
            seen.setdefault((r.seq_id, r.pos, r.head), {})[k] = p
    assert all(list(sorted(x)) == list(range(p + 1)) and sum(x.values()) == pytest.approx(1) for (_, p, _), x in seen.items())
    assert len(seen) == 6 * len(rows)
    steps = {(r.seq_id, r.pos, r.head): r.o for r in L.attn_mix(weights, df, SMALL).collect()}
    blocked = {(r.seq_id, r.pos): r.o for r in L.attend_blocked(df, SMALL).collect()}
    for r in L.attend(df, SMALL).collect():
        parts = np.concatenate([steps[r.seq_id, r.pos, h] for h in range(6)])
        assert np.allclose(r.o, parts, atol=1e-12) and np.allclose(r.o, blocked[r.seq_id, r.pos], atol=1e-12)


def test_partials_of_any_blocks_merge(spark):
    """The softmax of blocks that differ by more than the clamp is that of all their keys."""
    one = [(1, 9, 0, 100.0, 2.0, [2.0] * 8), (1, 9, 0, 98.0, 1.0, [5.0] * 8), (1, 9, 0, -900.0, 3.0, [7.0] * 8)]
    df = spark.createDataFrame(one, "seq_id int, pos int, head int, top double, total double, mixed array<double>")
    fade = np.exp(-2.0)
    assert L.attn_merge(df, SMALL).first().o == pytest.approx([(2 + 5 * fade) / (2 + fade)] * 8)


def test_weights_without_values_are_an_error(spark):
    w = spark.createDataFrame([(1, 3, 0, 0, [0, 2], [0.5, 0.5])], "seq_id int, pos int, head int, kblock int, kpos array<int>, prob array<double>")
    kv = spark.createDataFrame([(1, 0, [1.0] * 16)], "seq_id int, pos int, v array<double>")
    with pytest.raises(Exception, match="has no value"):
        L.attn_mix(w, kv, SMALL).collect()


def test_no_task_holds_a_sequence(spark):
    """The steps form no row of a sequence: nothing is collected but the heads of a query."""
    df = spark.createDataFrame([], "seq_id int, pos int, q array<double>, k array<double>, v array<double>")
    text = plan(L.attn_mix(L.attn_softmax(L.attn_scores(df, SMALL)), df, SMALL))
    assert "collect_list" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_attention_over_a_cache(spark):
    rng = np.random.default_rng(4)
    rows = [(1, p, rng.normal(size=48).tolist(), rng.normal(size=16).tolist(), rng.normal(size=16).tolist()) for p in range(6)]
    df = spark.createDataFrame(rows, "seq_id int, pos int, q array<double>, k array<double>, v array<double>")
    whole = {r.pos: r.o for r in L.attend(df, SMALL).collect()}
    last = L.attend(df.where("pos = 5"), SMALL, df.where("pos < 5").drop("q")).collect()
    assert [r.pos for r in last] == [5] and np.allclose(last[0].o, whole[5], atol=1e-12)


def test_rope_table_and_join(spark):
    table = rope_table(spark, 6, 8)
    rows = {(r.pos, r.h_dim): r for r in table.collect()}
    assert len(rows) == 48 and rows[3, 4].cos_val == pytest.approx(np.cos(3 * 100000.0 ** (-4 / 8)))
    df = spark.createDataFrame([(p, [float(i) for i in range(16)]) for p in range(8)], "pos int, vec array<double>")
    got = {r.pos: r.vec for r in L.rope_join(df, table, 8, 6).collect()}
    assert sorted(got) == list(range(8)) and got.pop(6) is None and got.pop(7) is None
    for p, vec in got.items():
        assert vec == pytest.approx(list(R.rotate(np.arange(16.0), p, 8)))


def test_kv_append(spark):
    cache = spark.createDataFrame([(1, 0, [1.0], [2.0])], "seq_id int, pos int, k array<double>, v array<double>")
    k = spark.createDataFrame([(1, 1, [3.0])], "seq_id int, pos int, k array<double>")
    v = spark.createDataFrame([(1, 1, [4.0])], "seq_id int, pos int, v array<double>")
    out = sorted(map(tuple, M.kv_append(cache, k, v).collect()))
    assert out == [(1, 0, [1.0], [2.0]), (1, 1, [3.0], [4.0])]


def test_layer_operators(spark):
    df = spark.createDataFrame([([1.0, -2.0], [0.5, 3.0], 2.0)], "x array<double>, d array<double>, s double")
    assert L.scale_by(df, "x", "s", [1.0, 10.0]).first().y == [2.0, -40.0]
    assert L.residual_add(df, "x", "d").first().x == [1.5, 1.0]
    g, u = np.array([1.0, -2.0]), np.array([0.5, 3.0])
    assert L.swiglu(df, "x", "d").first().h == pytest.approx(list(g / (1 + np.exp(-g)) * u))
    assert L.rms_norm(df, [1.0, 1.0]).first().x_norm == pytest.approx(list(R.rms(g, np.ones(2))))


def test_scores_cross_no_shuffle(spark, monkeypatch):
    """Scores, softmax and mix of rows that lie in tiles are made where they are, also over several tiles."""
    monkeypatch.setattr(L, "ATTENTION_BLOCK", 2)
    monkeypatch.setattr(L, "TILE_BYTES", 1)
    rng = np.random.default_rng(5)
    rows = [(s, p, rng.normal(size=48).tolist(), rng.normal(size=16).tolist(), rng.normal(size=16).tolist())
            for s, n in ((1, 5), (2, 9), (3, 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "seq_id bigint, pos bigint, q array<double>, k array<double>, v array<double>")
    placed = L.in_tiles(df, SMALL, again=True)
    weights = L.attn_softmax(L.attn_scores(placed, SMALL))
    mixed = L.attn_mix(weights, None, SMALL)
    moved = plan(mixed).count("Exchange hashpartitioning")
    assert moved == plan(placed).count("Exchange hashpartitioning") and "Window" not in plan(mixed)
    steps = {(r.seq_id, r.pos, r.head): r.o for r in mixed.collect()}
    blocked = L.attend_blocked(L.in_tiles(df, SMALL), SMALL)
    assert plan(blocked).count("Exchange hashpartitioning") == plan(L.in_tiles(df, SMALL)).count("Exchange hashpartitioning")
    blocked = {(r.seq_id, r.pos): r.o for r in blocked.collect()}
    lying = {(r.seq_id, r.pos): r.o for r in L.attend(L.in_tiles(df, SMALL), SMALL).collect()}
    assert len(steps) == 6 * len(rows) and len(blocked) == len(lying) == len(rows)
    for r in L.attend(df, SMALL).collect():
        whole = np.concatenate([steps[r.seq_id, r.pos, h] for h in range(6)])
        assert np.allclose(r.o, whole, atol=1e-12) and np.allclose(r.o, blocked[r.seq_id, r.pos], atol=1e-12)
        assert np.allclose(r.o, lying[r.seq_id, r.pos], atol=1e-12)
    with pytest.raises(Exception, match="come twice"):
        L.attn_scores(L.in_tiles(df, SMALL), SMALL).collect()
    with pytest.raises(Exception, match="has no value"):
        L.attn_mix(weights.where("head > 0"), None, SMALL).collect()


def _one_process(df):
    text = plan(df)
    return text.count("MapInArrow") == 1 and "ArrowEvalPython" not in text


def _placed(spark, monkeypatch, again=False):
    """Rows of several tiles, some of them twice, with q, k and v, `in_tiles`."""
    monkeypatch.setattr(L, "ATTENTION_BLOCK", 2)
    monkeypatch.setattr(L, "TILE_BYTES", 1)
    rng = np.random.default_rng(6)
    rows = [(s, p, rng.normal(size=48).tolist(), rng.normal(size=16).tolist(), rng.normal(size=16).tolist())
            for s, n in ((1, 5), (2, 9), (3, 1), (4, 2)) for p in range(n)]
    rows += [r for r in rows if r[0] == 4 or r[:2] == (2, 3)] + [(None, 0, *rows[0][2:])]
    df = spark.createDataFrame(rows, "seq_id bigint, pos bigint, q array<double>, k array<double>, v array<double>")
    return L.in_tiles(df, SMALL, again=again)


def _near(left, right, keys, value):
    left, right = ([(*(r[k] for k in keys), *np.ravel(r[value])) for r in x.collect()] for x in (left, right))
    assert len(left) == len(right) > 0 and np.allclose(sorted(left), sorted(right), atol=1e-12)


def test_partial_results_are_merged_in_the_process_that_makes_them(spark, monkeypatch):
    assert _one_process(catalog.blocked_attention(spark, FOLDER))
    partials = L.attn_partials(_placed(spark, monkeypatch), SMALL, kept=["seq_id", "pos"])
    _near(L.attn_merge(partials, SMALL, kept=["seq_id", "pos"]), L.attn_merge(partials.select("*"), SMALL, kept=["seq_id", "pos"]), ["seq_id", "pos"], "o")


def test_scores_are_mixed_in_the_process_that_makes_them(spark, monkeypatch):
    assert _one_process(catalog.chat_mix(spark, FOLDER))
    weights = L.attn_softmax(L.attn_scores(_placed(spark, monkeypatch, again=True), SMALL))
    _near(L.attn_mix(weights, None, SMALL), L.attn_mix(weights.select("*"), None, SMALL), ["seq_id", "pos", "head"], "o")
    _near(weights.select("seq_id", "pos", "head", "kblock", "prob").where("size(prob) = 1"),
          L.attn_softmax(L.attn_scores(_placed(spark, monkeypatch, again=True), SMALL).select("*")).where("size(prob) = 1"), ["seq_id", "pos", "head", "kblock"], "prob")


def test_scores_are_summed_up_in_the_process_that_makes_them(spark, monkeypatch):
    assert _one_process(catalog.chat_scores(spark, FOLDER))
    weights = L.attn_softmax(L.attn_scores(_placed(spark, monkeypatch, again=True), SMALL))
    whole = [F.array(F.sum("n"), F.max("top"), F.max("prob")).alias("found")]
    here, apart = (L.attn_summary(w).groupBy("seq_id", "pos", "head").agg(*whole) for w in (weights, weights.select("*")))
    _near(here, apart, ["seq_id", "pos", "head"], "found")


def test_attention_of_rows_in_tiles_is_one_process(spark, model, prompts):
    """Embedding, norm, projections, rotation, attention and residual of rows in tiles: the same as step by step."""
    assert _one_process(catalog.long_attention(spark, FOLDER))
    lying = M.attention(M.embedded(L.in_tiles(prompts, SMALL), model), model, 0)
    sent = M.attention(M.embedded(prompts, model), model, 0)
    for column in "xkv":
        _near(lying, sent, ["seq_id", "pos"], column)
    with pytest.raises(Exception, match="no embedding for token 32"):
        M.embedded(L.in_tiles(prompts.withColumn("token", F.lit(32)), SMALL), model).collect()
