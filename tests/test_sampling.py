import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relinfer.config import SamplingParams
from relinfer.operators import sampling as S
from relinfer.operators import skew
from relinfer.sources import text as T
from tests import reference as R
from tests.conftest import FOLDER, plan

P = SamplingParams()


@pytest.fixture(scope="module")
def logits(spark):
    """Uneven groups: one holds most rows; ties included."""
    rng = np.random.default_rng(5)
    rows = [(g, t, float(np.round(rng.normal() * 3, 1))) for g, n in ((1, 300), (2, 20), (3, 1)) for t in range(n)]
    return spark.createDataFrame(rows, "seq_id int, token int, val double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.seq_id, []).append(r)
    return out


def expected_chain(values, params=P):
    t = np.array(values) / params.temp
    p = R.softmax(t)
    keep = [i for i in np.lexsort((np.arange(len(p)), -p)) if p[i] >= p.max() * params.min_p][: params.top_k]
    cdf, out = 0.0, []
    for i in keep:
        if cdf <= params.top_p + 1e-15:
            out.append(int(i))
        cdf += p[i]
    return out, p


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def test_describing_a_filter_chain_starts_no_job(spark, logits):
    log = spark.createDataFrame([(1, 0, 9)], "seq_id int, pos int, token int")
    before = jobs(spark)
    S.filter_logits(logits, P)
    S.next_token(log, logits, P, 0)
    assert jobs(spark) == before


def test_softmax_of_uneven_groups(spark, logits):
    out = S.softmax(logits, "seq_id")
    assert "Window" not in plan(out)
    for rows in groups(out).values():
        rows.sort(key=lambda r: r.token)
        assert [r.prob for r in rows] == pytest.approx(list(R.softmax(np.array([r.val for r in rows]))))


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 3.0)], "seq_id int, val double")
    sums = {r.seq_id: r.s for r in S.softmax(df, "seq_id").groupBy("seq_id").agg(F.sum("prob").alias("s")).collect()}
    assert sums == pytest.approx({None: 1.0, 1: 1.0})


def test_filter_chain_in_both_forms(spark, logits):
    long = groups(S.filter_logits(logits, P))
    vectors = logits.groupBy("seq_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("token", "val"))), lambda r: r.val).alias("x")
    )
    vec = {r.seq_id: r for r in vectors.select("seq_id", "x", S.survivors_vec("x", P).alias("k")).collect()}
    for g, r in vec.items():
        tokens, p = expected_chain(r.x)
        assert [k.token for k in r.k] == tokens
        assert [k.prob for k in r.k] == pytest.approx([p[t] for t in tokens])
        assert sorted(row.token for row in long[g]) == sorted(tokens)
        assert tokens


def test_both_draws_agree(spark, logits):
    params = SamplingParams(top_k=300, min_p=0.0, top_p=1.0)
    kept = S.filter_logits(logits, params)
    long = {r.seq_id: r.token for r in S.gumbel_sample(kept, "seq_id", 9).collect()}
    vectors = logits.groupBy("seq_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("token", "val"))), lambda r: r.val).alias("x")
    ).withColumn("k", S.survivors_vec("x", params))
    assert long == {r.seq_id: r.t for r in vectors.select("seq_id", S.gumbel_vec("k", 9, "seq_id").alias("t")).collect()}


def test_draw_follows_the_probabilities(spark):
    p = [0.6, 0.3, 0.1]
    rows = spark.range(6000).select(F.col("id").alias("seq_id"), F.posexplode(F.array(*[F.lit(float(np.log(x))) for x in p])).alias("token", "t_val"))
    counts = {r.token: r["count"] for r in S.gumbel_sample(rows, "seq_id", 1).groupBy("token").count().collect()}
    assert [counts[i] / 6000 for i in range(3)] == pytest.approx(p, abs=0.03)


def test_top_p_at_any_group_size(spark, logits):
    probs = S.softmax(logits, "seq_id")
    wide = {(r.seq_id, r.token) for r in S.top_p_filter(probs, "seq_id", 0.7).collect()}
    small = {(r.seq_id, r.token) for r in S.top_p_filter(probs, "seq_id", 0.7, bounded=True).collect()}
    assert wide == small
    assert {g for g, _ in S.top_p_filter(probs, "seq_id", 0.0).select("seq_id", "token").collect()} == {1, 2, 3}


def test_running_sum_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLED_ROWS", 64)
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id"), F.lit(1.0).alias("v")).repartition(8)
    out = skew.running_sum(df, "k", [(F.col("id"), True)], "v", "s")
    assert out.where(F.col("s") != 20000 - F.col("id")).count() == 0
    assert out.count() == 20000
    text = plan(out)
    assert "REPARTITION_BY_NUM" in text and "_piece" in text


@pytest.mark.parametrize("descending", [(True, False), (False, True)])
def test_running_sum_equals_a_window(spark, monkeypatch, descending):
    """Nulls, ties and null keys are placed as a window places them."""
    monkeypatch.setattr(skew, "SAMPLED_ROWS", 4)
    rows = [(None if k % 7 == 0 else k % 3, None if k % 5 == 0 else float(k % 11), k, k % 13) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, a double, b int, v int")
    down_a, down_b = descending
    out = skew.running_sum(df, "k", [(F.col("a"), down_a), (F.col("b"), down_b)], "v", "s")
    over = Window.partitionBy("k").orderBy(
        F.col("a").desc() if down_a else F.col("a"), F.col("b").desc() if down_b else F.col("b")
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("s", F.sum("v").over(over))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_sums_run_nothing_while_described(spark, logits):
    """What rests on running sums starts no job before an action."""
    conv = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    context = spark.sparkContext
    context.setJobGroup("described", "plans only")
    try:
        probs = S.softmax(logits, "seq_id")
        S.top_p_filter(probs, "seq_id", 0.9)
        skew.running_sum(probs, "seq_id", [(F.col("prob"), True)], "prob", "s")
        T.encode_chat(conv, T.build_vocab(conv, 64, specials=T.SPECIALS), vocab_size=64)
        assert not context.statusTracker().getJobIdsForGroup("described")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_top_k_is_limited_before_the_shuffle(spark, logits):
    out = S.top_k_filter(S.softmax(logits, "seq_id"), "seq_id", 5)
    assert "WindowGroupLimit" in plan(out)
    assert {g: len(r) for g, r in groups(out).items()} == {1: 5, 2: 5, 3: 1}


def test_lookup_join_is_whole_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    big = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).cast("int").alias("k"), "id")
    table = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.lookup_join(big, table, "k", how).select("k", "id", "v").collect()), key=lambda r: r[1])
        want = sorted(map(tuple, big.join(table, "k", how).select("k", "id", "v").collect()), key=lambda r: r[1])
        assert got == want


def test_temperature_must_be_positive(spark, logits):
    with pytest.raises(ValueError):
        S.temperature(logits, 0)
    with pytest.raises(ValueError):
        SamplingParams(temp=0)
    with pytest.raises(Exception, match="temp must be positive"):
        S.temperature(logits.withColumn("t", F.lit(0.0)), "t").collect()


def test_parameters_per_sequence(spark, logits):
    table = spark.createDataFrame([(1, 0.5), (2, 2.0)], "seq_id int, temp double")
    out = S.temperature(S.with_params(logits, table), "temp")
    assert out.count() == logits.count()
    assert out.where("seq_id = 1 and t_val != val / 0.5").count() == 0
    assert out.where(f"seq_id = 3 and t_val != val / {SamplingParams().temp}").count() == 0
    assert S.with_params(logits, P).first().top_k == 40


def test_penalty_counts_a_token_once_and_protects(spark):
    log = spark.createDataFrame([(1, 0, 20), (1, 1, 20), (1, 2, 5), (1, 70, 21)], "seq_id int, pos int, token int")
    rows = [(1, 5, 3.0), (1, 20, 3.0), (1, 21, -3.0), (1, 22, 3.0), (2, 20, 3.0)]
    scores = spark.createDataFrame(rows, "seq_id int, token int, val double")
    out = {(r.seq_id, r.token): r.val for r in S.repetition_penalty(scores, log, pen=2.0).collect()}
    # Positions 0 and 1 are outside the window of the 65 last positions.
    assert out == {(1, 5): 3.0, (1, 20): 3.0, (1, 21): -6.0, (1, 22): 3.0, (2, 20): 3.0}
    wide = {(r.seq_id, r.token): r.val for r in S.repetition_penalty(scores, log, 100, 2.0).collect()}
    assert wide[1, 20] == 1.5


def test_penalty_at_a_position_sees_no_later_token(spark):
    log = spark.createDataFrame([(1, 0, 20), (1, 3, 21)], "seq_id int, pos int, token int")
    scores = spark.range(5).select(F.lit(1).alias("seq_id"), F.col("id").cast("int").alias("pos"), F.explode(F.array(F.lit(20), F.lit(21))).alias("token"), F.lit(4.0).alias("val"))
    out = {(r.pos, r.token): r.val for r in S.repetition_penalty(scores, log, 2, 2.0, at="pos").collect()}
    assert [out[p, 20] for p in range(5)] == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert [out[p, 21] for p in range(5)] == [4.0, 4.0, 4.0, 2.0, 2.0]


def test_token_rules(spark):
    log = spark.createDataFrame([(1, 0, 9), (1, 1, 2), (2, 0, 2), (2, 1, 9)], "seq_id int, pos int, token int")
    assert {r.seq_id: r.pos for r in S.next_pos(log).collect()} == {1: 2, 2: 2}
    assert {r.seq_id: r.token for r in S.last_token(log).collect()} == {1: 2, 2: 9}
    assert {r.seq_id: r.stopped for r in S.is_stopped(log).collect()} == {1: True, 2: False}
    assert {r.seq_id: r.exhausted for r in S.is_exhausted(log, 2).collect()} == {1: False, 2: False}
    assert {r.seq_id: r.exhausted for r in S.is_exhausted(log, 1).collect()} == {1: True, 2: True}


def test_next_token_respects_stop_limit_and_forcing(spark):
    log = spark.createDataFrame([(1, 0, 9), (2, 0, 2), (3, 0, 9), (3, 1, 9), (4, 0, 9)], "seq_id int, pos int, token int")
    scores = spark.createDataFrame([(s, t, 5.0 if t == 3 else 0.0) for s in (1, 2, 3, 4, 5) for t in range(6)], "seq_id int, token int, val double")
    limit = spark.createDataFrame([(1, 10), (2, 10), (3, 1), (4, 10)], "seq_id int, max_pos int")
    out = S.next_token(log, scores, P.greedy(), 0, max_pos=limit).collect()
    assert {(r.seq_id, r.pos, r.token) for r in out} == {(1, 1, 3), (4, 1, 3)}
    forced = spark.createDataFrame([(4, 1, 5), (4, 7, 1)], "seq_id int, pos int, token int")
    out = S.next_token(log, scores, P.greedy(), 0, max_pos=limit, forced=forced).collect()
    assert {(r.seq_id, r.pos, r.token) for r in out} == {(1, 1, 3), (4, 1, 5)}


def test_top_k_beyond_the_pushed_limit_and_by_row(spark, monkeypatch):
    rows = [(g, t, ((t * 37 + g) % 50) / 50) for g in (1, 2) for t in range(50)]
    df = spark.createDataFrame(rows, "seq_id int, token int, prob double").withColumn("k", F.col("seq_id") * 7)
    expected = {g: sorted(t for _, t, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:7 * g]) for g in (1, 2)}

    def kept(out):
        found = {}
        for r in out.collect():
            found.setdefault(r.seq_id, []).append(r.token)
        return {g: sorted(t) for g, t in found.items()}

    assert kept(S.top_k_filter(df, "seq_id", "k")) == expected
    monkeypatch.setattr(S, "RANKED", 5)
    assert kept(S.top_k_filter(df.where("seq_id = 1"), "seq_id", 7)) == {1: expected[1]}


def test_bounds_are_found_by_bisection(spark):
    """As many bounds stand in front of a row as a count of all of them says, and few of them are looked at."""
    rows = [(i, [None, 0.5, 1.0, 2.0][i % 4], i * 7 % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, b int")
    for down in (False, True):
        row, order = [F.col("a"), F.col("b")], [down, False]
        bounds = sorted({(a, b) for _, a, b in rows}, key=lambda x: (x[0] is not None, (-1 if down else 1) * (x[0] or 0), x[1]))
        bounds = [x for x in bounds if x[0] is not None] + [x for x in bounds if x[0] is None] if down else bounds
        listed = F.array(*(F.struct(F.lit(a).cast("double").alias("_o0"), F.lit(b).alias("_o1")) for a, b in bounds))
        counted = df.withColumn("_b", listed).select(
            skew._count_before(F.col("_b"), row, order).alias("n"), F.size(F.filter("_b", lambda x: skew._not_after(x, row, order))).alias("all")
        )
        assert all(r.n == r["all"] for r in counted.collect()) and counted.agg(F.max("n")).first()[0] == len(bounds)
    summed = skew.running_sum(df, "b", [(F.col("id"), True)], "id", "s")
    assert "filter(_bounds" not in summed._jdf.queryExecution().optimizedPlan().toString()
