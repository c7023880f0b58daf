"""Matching, contrasts, resampling and decisions on small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlab.contracts import ContractViolation, one_row
from effectlab.functions.ordering import average_ranks, first_per_key, quantiles
from effectlab.functions.rng import draw_column, draw_sql, draws, uniform_below
from effectlab.operators import contrast, dedup, describe, match, selection
from effectlab.operators.multiplicity import holm
from effectlab.operators.resample import Resampling, _bootstrap_kernel, _drawn, bootstrap_ci, sign_flip_p
from effectlab.schema import Names, Outcome

LEDGER = Names.ledger()
FEW = Resampling(resamples=2000)


OFFSETS = {11: -0.6, 12: 0.0, 14: 0.9, 17: 0.3}
SCORE = [Outcome("score", 1.0)]


@pytest.fixture(scope="module")
def trial(spark):
    """Four units under two arms; the response is four times the dose plus the unit's offset."""
    rows = [
        (unit, arm, dose, 4 * dose + offset, start + slope * offset)
        for arm, start, slope in (("pulse", 10.0, 1.0), ("steady", 7.0, 0.5))
        for dose in (3.0, 1.5, 0.5, -0.5, -1.5)
        for unit, offset in OFFSETS.items()
    ]
    return spark.createDataFrame(rows, "unit bigint, arm string, dose double, response double, score double")


def test_nearest_dose_is_matched_per_direction(trial):
    rows = match.match_at_target(trial.where("arm = 'pulse'"), [6.5], 0.5).collect()
    assert {(r.direction, r.dose) for r in rows} == {(1, 1.5), (-1, -1.5)}
    within = {d: {r.unit for r in rows if r.direction == d and r.match_complete} for d in (-1, 1)}
    assert within == {1: {12, 14, 17}, -1: {11, 12}}


def test_ties_go_to_the_first_row_in_order(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 4.0, 2), (1, "a", 2.0, 6.0, 1)], "unit int, arm string, dose double, response double, line int")
    assert match.match_at_target(df, [5.0], 1.0, order=["line"]).first().dose == 2.0
    assert match.match_at_target(df, [5.0], 1.0).first().dose == 1.0


def test_tolerance_is_inclusive_and_failures_stay(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 4.0), (2, "a", 1.0, 1.0), (3, "a", 1.0, float("nan"))], "unit int, arm string, dose double, response double")
    rows = {r.unit: r.match_complete for r in match.match_at_target(df, [5.0], 1.0).collect()}
    assert rows == {1: True, 2: False}
    with pytest.raises(ValueError):
        match.match_at_target(df, [0.0], 1.0)


def test_coverage_counts_complete_units(trial):
    rows = {(r.arm, r.direction): r for r in match.coverage(match.match_at_target(trial, [6.5], 0.5)).collect()}
    assert len(rows) == 4
    up, down = rows["steady", 1], rows["steady", -1]
    assert (up.attempted_units, up.complete_units, up.coverage_rate) == (4, 3, 0.75)
    assert (down.attempted_units, down.complete_units, down.coverage_rate) == (4, 2, 0.5)
    assert up.mean_achieved_change == pytest.approx((6.0 + 6.9 + 6.3) / 3)
    assert down.mean_achieved_change == pytest.approx((6.6 + 6.0) / 2)


def test_coverage_against_a_plan_with_an_unseen_unit(spark):
    rows = [(4, "k", 1, 2.5, True, 0.2), (6, "k", 1, 2.5, True, 0.7), (9, "k", 1, 2.5, False, 3.1)]
    df = spark.createDataFrame(rows, "unit int, arm string, direction int, target_change double, match_complete boolean, match_distance double")
    row = match.coverage_expected(df, spark.createDataFrame([(4,), (6,), (9,), (10,), (4,)], "unit int")).first()
    assert (row.expected_units, row.observed_units, row.matched_units, row.coverage_rate) == (4, 3, 2, 0.5)
    assert (row.median_match_distance, row.max_match_distance) == (0.7, 3.1)


def test_contrast_of_two_arms_worked_by_hand(trial):
    matched = match.match_at_target(trial, [6.5], 2.0)
    table = contrast.paired_contrasts(matched, "pulse", SCORE, bootstrap=FEW, flips=FEW).collect()
    assert {(r.comparator, r.direction) for r in table} == {("steady", -1), ("steady", 1)}
    for r in table:  # advantages 3 + offset / 2: 2.7, 3.0, 3.45, 3.15
        assert (r.n_pairs, r.mean_reference_advantage) == (4, pytest.approx(3.075))
        assert 2.7 <= r.ci_low < 3.075 < r.ci_high <= 3.45
        # All four are positive: of 16 flips two reach the observed mean.
        assert 0.1 < r.p_value < 0.15 and r.p_holm == pytest.approx(2 * min(x.p_value for x in table), rel=0.2)


def test_strata_without_pairs_are_listed(spark):
    rows = [(1, "r", 1, 3.0, True, 0.5), (2, "x", 1, 3.0, True, 0.4), (1, "y", 1, 3.0, True, 0.1)]
    df = spark.createDataFrame(rows, "unit int, arm string, direction int, target_change double, match_complete boolean, q double")
    table = contrast.paired_contrasts(df, "r", [Outcome("q", 1.0)], bootstrap=FEW, flips=FEW)
    got = {r.comparator: (r.n_pairs, r.p_value, r.ci_low) for r in table.collect()}
    assert got == {"x": (0, None, None), "y": (1, None, None)}


def test_holm_keeps_missing_values(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None), (4, float("nan"))], "i int, p_value double")
    got = [r.p_holm for r in holm(df).orderBy("i").collect()]
    assert got[:3] == pytest.approx([0.03, 0.06, 0.06]) and got[3:] == [None, None]


# The p-values of a published contrast table and their Holm adjustment.
PUBLISHED_P = [
    0.6264537354626454, 0.03116968830311697, 0.4055059449405506, 0.5615743842561575,
    0.6759732402675973, 0.0025099749002509973, 1.999980000199998e-05, 0.0005599944000559995,
    0.3121568784312157, 0.0010399896001039989, 0.14239857601423986, 0.07500924990750092,
    0.17577824221757782, 0.00012999870001299986, 0.00012999870001299986, 0.34259657403425964,
]
PUBLISHED_HOLM = [
    1.0, 0.3116968830311697, 1.0, 1.0, 1.0, 0.02760972390276097, 0.0003199968000319997, 0.0072799272007279935,
    1.0, 0.012479875201247987, 1.0, 0.6750832491675083, 1.0, 0.0019499805001949979, 0.0019499805001949979, 1.0,
]


def test_holm_reproduces_published_values(spark):
    df = spark.createDataFrame(list(enumerate(PUBLISHED_P)), "i int, p_value double")
    got = [r.p_holm for r in holm(df).orderBy("i").collect()]
    assert got == pytest.approx(PUBLISHED_HOLM, abs=1e-15)


def test_holm_equals_a_plain_loop(spark):
    p = np.round(np.random.default_rng(5).random(400), 2)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(p)], "i int, p_value double")
    got = np.array([r.p_holm for r in holm(df).orderBy("i").collect()])
    want, running = np.zeros(len(p)), 0.0
    for rank, i in enumerate(np.argsort(p, kind="stable")):
        running = max(running, min(1.0, (len(p) - rank) * p[i]))
        want[i] = running
    assert got == pytest.approx(want)


FAMILY = (
    "reference_arm string, comparator string, direction int, target_change double, outcome string, n_pairs bigint,"
    " mean_reference_advantage double, ci_low double, ci_high double, p_value double"
)


def family(spark, down, up):
    """A family of two rows, each (pairs, estimate, lower end, p)."""
    rows = [("pulse", "steady", d, 2.5, "score", n, mean, low, mean + 1.0, p) for d, (n, mean, low, p) in ((-1, down), (1, up))]
    df = spark.createDataFrame(rows, FAMILY)
    return contrast.replication_family(df, "steady", "score", 2.5, reference_arm="pulse")


@pytest.mark.parametrize(
    "down, up, decision",
    [
        ((30, 0.9, 0.3, 0.004), (25, 1.4, 0.8, 0.001), "strict_replication"),
        ((12, 0.9, 0.3, 0.024), (12, 1.4, 0.8, 0.024), "strict_replication"),
        ((30, 0.9, 0.3, 0.026), (25, 1.4, 0.8, 0.6), "directional_replication"),
        ((30, 0.9, 0.0, 0.004), (25, 1.4, 0.8, 0.001), "directional_replication"),
        ((30, 0.9, 0.3, 0.004), (25, 0.0, -0.5, 0.001), "failure_to_replicate"),
        ((30, -2.0, -3.0, 0.004), (4, 1.4, 0.8, 0.001), "inconclusive_coverage"),
        ((30, 0.9, 0.3, None), (25, 1.4, 0.8, 0.001), "invalid_family"),
    ],
)
def test_decision_rule(spark, down, up, decision):
    assert contrast.decide(family(spark, down, up)).first().decision == decision


def test_an_empty_or_half_family_gives_no_verdict(spark):
    whole = family(spark, (30, 0.9, 0.3, 0.004), (25, 1.4, 0.8, 0.001))
    assert contrast.decide(whole.limit(0)).first().decision == "invalid_family"
    assert contrast.decide(whole.where("direction = 1")).first().decision == "invalid_family"
    assert contrast.decide(whole.withColumn("family_valid", F.lit(False))).first().decision == "invalid_family"


def test_family_labels_and_adjustment(spark):
    rows = family(spark, (30, 0.9, 0.3, 0.03), (25, 1.4, 0.8, 0.2)).orderBy("direction").collect()
    assert [r.direction_label for r in rows] == ["lighter", "darker"]
    assert [r.p_holm_family for r in rows] == pytest.approx([0.06, 0.2]) and all(r.family_valid for r in rows)


def test_published_replication_family(spark):
    rows = [
        ("masked", "unmasked", -1, 5.0, "lpips", 8, 0.0238445075228811, 0.0049441782757639, 0.0414636745350436, 0.0555494445055549),
        ("masked", "unmasked", 1, 5.0, "lpips", 10, 0.0409046314656734, 0.0176323029957711, 0.065490671712905, 0.0095899041009589),
    ]
    parent = [("masked", "unmasked", d, 5.0, "lpips", n, mean, 0.01, 0.2, 0.01) for d, n, mean in ((-1, 13, 0.0234707688), (1, 14, 0.0824607212))]
    found = contrast.replication_family(spark.createDataFrame(rows, FAMILY), "unmasked", "lpips", 5.0)
    got = {r.direction: r.p_holm_family for r in found.collect()}
    assert got == pytest.approx({-1: 0.0555494445055549, 1: 0.0191798082019178})
    assert contrast.decide(found).first().decision == "inconclusive_coverage"
    joined = contrast.compare_families(found, spark.createDataFrame(parent, FAMILY)).collect()
    assert all(r.same_sign_as_parent and r.one_to_one for r in joined) and len(joined) == 2


def test_draws_are_the_same_in_numpy_and_spark(spark):
    df = spark.range(50).select("id", draw_column(2026, F.col("id") % 7, F.col("id") * 1_003, F.col("id") % 3).alias("d"))
    got = {r.id: r.d for r in df.collect()}
    ids = np.arange(50)
    assert [got[i] for i in range(50)] == (draws(2026, ids % 7, ids * 1_003, ids % 3) >> np.uint64(2)).astype(int).tolist()


def test_draws_are_the_same_in_sql():
    import duckdb

    rows = duckdb.sql(draw_sql("(select unnest(range(200)) i)", 20260816, "i % 9", "i * 7919", "i % 4")).fetchall()
    i = np.arange(200)
    assert [(hi << 32) + lo for _, hi, lo in sorted(rows)] == draws(20260816, i % 9, i * 7919, i % 4).tolist()


def test_draws_fill_their_range():
    d = draws(5, np.arange(40)[:, None], np.arange(5000)[None, :])
    assert len(np.unique(d)) == d.size
    counts = np.bincount(uniform_below(d, 100).ravel(), minlength=100)
    assert ((counts - 2000) ** 2 / 2000).sum() < 160  # chi square of 99 degrees
    bits = np.unpackbits(d.view(np.uint8)).reshape(-1, 64).mean(axis=0)
    assert abs(bits - 0.5).max() < 0.01


def _hits(n, shards, replicates, block=0):
    """How often each position is drawn by each replicate, over all shards."""
    kernel, levels = _bootstrap_kernel(11), shards.bit_length() - 1
    out = np.zeros((replicates, n))
    for shard in range(shards):
        low, high = (shard * n) >> levels, ((shard + 1) * n - 1) >> levels
        for position in range(low, high + 1):
            x = np.zeros(high + 1 - low)
            x[position - low] = 1.0
            out[:, position] += kernel(np.arange(low, high + 1), np.ones(high + 1 - low, int), x, n, shard, shards, block, np.arange(replicates))
    return out


@pytest.mark.parametrize("n, shards", [(13, 1), (13, 4), (16, 4), (21, 8)])
def test_draws_dealt_over_shards_have_the_law_of_uniform_draws(n, shards):
    hits = _hits(n, shards, 1200)
    assert (hits.sum(axis=1) == n).all()  # every draw falls on one position
    expected = len(hits)
    assert ((hits.sum(axis=0) - expected) ** 2 / expected).sum() < 3 * n
    assert hits.var(axis=0).mean() == pytest.approx(1 - 1 / n, abs=0.08)
    apart = np.cov(hits.T)[np.triu_indices(n, 1)]
    assert apart.mean() == pytest.approx(-1 / n, abs=0.015) and abs(apart + 1 / n).max() < 0.16


def test_a_shard_of_several_draws_by_one_generator_into_the_same_arrays(monkeypatch):
    import time

    monkeypatch.setattr("effectlab.operators.resample.draws", None)  # would cost seven rounds a draw
    x, reps = np.arange(20_000.0), np.arange(100)
    args = (np.arange(20_000, 40_000), np.ones(20_000, int), x, 80_000, 1, 4, 0)
    begin = time.process_time()
    sums = _bootstrap_kernel(3)(*args, reps)
    assert time.process_time() - begin < 2.0
    assert (sums == _bootstrap_kernel(3)(*args, reps)).all() and len(np.unique(sums)) == 100
    assert sums.mean() / 20_000 == pytest.approx(x.mean(), rel=0.01)


def test_a_shard_looks_two_draws_up_at_once():
    import time

    n, reps = 20_000, np.arange(300)
    x, generator = np.random.default_rng(5).normal(size=n), np.random.default_rng(6)
    args = (np.arange(n, 2 * n), np.ones(n, int), x, 4 * n, 1, 4, 0)
    _bootstrap_kernel(3)(*args, reps)
    spent = []
    for work in (lambda: _bootstrap_kernel(3)(*args, reps), lambda: [x.take((generator.random(n) * n).astype(np.intp)).sum() for _ in reps]):
        begin = time.process_time()
        work()
        spent.append(time.process_time() - begin)
    assert spent[0] < 0.7 * spent[1]  # drawn one by one it was as much


@pytest.mark.parametrize("n, begin, end", [(600, 0.3, 599.6), (514, 0.0, 514.0), (257, 0.9, 256.1), (2, 0.5, 1.25), (1, 0.25, 0.5)])
def test_draws_of_pieces_have_the_law_of_uniform_draws(n, begin, end):
    weights = np.minimum(np.arange(1, n + 1), end) - np.maximum(np.arange(n), begin)
    weights /= weights.sum()
    dealt = np.resize([0, 1, 2, 501, 3000], 20_000)
    for x in (np.ones(n), np.arange(n) ** 2 / n, (np.arange(n) % 7 == 0) * 1.0):
        sums = _drawn(np.random.SFC64(8), x, begin, end, dealt)
        mean, spread = weights @ x, math.sqrt(max(0.0, weights @ x**2 - (weights @ x) ** 2))
        for k in (0, 1, 2, 501, 3000):
            own = sums[dealt == k]
            assert own.mean() == pytest.approx(k * mean, abs=5 * spread * math.sqrt(k / len(own)) + 1e-6)
            assert own.std() == pytest.approx(spread * math.sqrt(k), rel=0.07, abs=1e-6)


def test_runs_are_moved_once_for_all_blocks_of_replicates(spark):
    df = spark.range(3000).selectExpr("id as unit", "cast(id % 7 as double) + id div 2000 as x")
    table = bootstrap_ci(df, [], "unit", "x", Resampling(resamples=500, shard_rows=400, block=100))
    plan = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "Generate explode" in line and "_block" in line)
    # What lies below the blocks is a packed shard, not a run.
    assert any("_values" in line for line in plan[dealt + 1 :])


def test_bootstrap_does_not_depend_on_partitioning(spark):
    df = spark.range(300).selectExpr("id as unit", "cast(id % 3 as int) as g", "sin(id) * 3 as x")
    for config in (FEW, Resampling(resamples=500, shard_rows=16)):
        a = bootstrap_ci(df.repartition(1), ["g"], "unit", "x", config).orderBy("g").collect()
        b = bootstrap_ci(df.repartition(64), ["g"], "unit", "x", config).orderBy("g").collect()
        assert [tuple(r)[:2] for r in a] == [tuple(r)[:2] for r in b]
        assert [r.ci_low for r in a] == pytest.approx([r.ci_low for r in b], rel=1e-12)


def test_bootstrap_forms_agree_and_cover_the_mean(spark):
    x = np.random.default_rng(3).normal(5, 2, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "unit bigint, x double")
    drawn = bootstrap_ci(df, [], "unit", "x", FEW).first()
    dealt = bootstrap_ci(df, [], "unit", "x", Resampling(resamples=2000, shard_rows=100)).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    for r in (drawn, dealt):
        assert r.n == 2000
        assert r.ci_low == pytest.approx(x.mean() - half, abs=0.02)
        assert r.ci_high == pytest.approx(x.mean() + half, abs=0.02)


def test_sign_flip_p_matches_enumeration(spark):
    x = [1.0, 2.0, -0.5, 3.0, 1.5, 0.2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "unit bigint, x double")
    sums = [abs(sum(v if m >> i & 1 else -v for i, v in enumerate(x))) for m in range(64)]
    exact = sum(s >= abs(sum(x)) - 1e-12 for s in sums) / 64
    p = sign_flip_p(df, [], "unit", "x", Resampling(resamples=50_000)).first().p_value
    assert p == pytest.approx(exact, abs=0.01)
    assert sign_flip_p(df.repartition(6), [], "unit", "x", Resampling(resamples=50_000)).first().p_value == p
    split = sign_flip_p(df, [], "unit", "x", Resampling(resamples=50_000, shard_rows=2)).first().p_value
    assert split == pytest.approx(exact, abs=0.01)


def test_too_few_values_have_no_interval(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("inf")), (3, None)], "unit bigint, x double")
    assert tuple(bootstrap_ci(df, [], "unit", "x", FEW).first()) == (1, None, None)
    assert tuple(sign_flip_p(df, [], "unit", "x", FEW).first()) == (1, None)


def test_quantiles_are_exact_with_a_hot_group_and_null_keys(spark):
    rng = np.random.default_rng(7)
    groups = {"hot": np.concatenate([rng.normal(100, 1e-7, 3000), np.full(3000, 7.0)]), None: rng.normal(0, 1e6, 500), "one": np.array([4.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r.g: (r.a, r.b, r.c) for r in quantiles(df, ["g"], "v", {"a": 0.025, "b": 0.5, "c": 0.975}).collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0.025, 0.5, 0.975])), rel=1e-12)


def test_average_ranks_equal_pandas(spark):
    import pandas as pd

    frame = pd.DataFrame({"g": ["a", "b"] * 300, "i": range(600), "v": np.random.default_rng(1).integers(-20, 20, 600).astype(float)})
    got = average_ranks(spark.createDataFrame(frame), ["g"], "v", "r").toPandas().sort_values("i")
    assert got["r"].tolist() == frame.groupby("g")["v"].rank(method="average").tolist()


def test_ranks_of_infinities_and_nan(spark):
    values = [3.0, float("inf"), float("nan"), float("-inf"), 1e300, None, 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.r for r in average_ranks(df, [], "v", "r").collect()}
    assert got == {3: 1.0, 0: 2.5, 6: 2.5, 4: 4.0, 1: 5.0}


def test_input_order_does_not_choose_among_repeats(spark):
    rows = [(1, "a", d, y, n) for n, (d, y) in enumerate([(1.0, 2.0), (1.0, 9.0), (2.0, 4.0), (2.0, 1.0), (3.0, 3.0), (3.0, 8.0)])]
    seen, matched = set(), set()
    for turn in range(4):
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "unit int, arm string, dose double, response double, line int").coalesce(1)
        seen.add(describe.spearman_by_unit(df).first().spearman)
        matched.add(tuple(match.match_at_target(df, [5.0], 1.0).first()))
    assert len(seen) == 1 and len(matched) == 1


def test_signs_of_equal_values_are_drawn_apart(spark):
    df = spark.createDataFrame([(u, 1.0) for k in range(1, 9) for u in (k, -k)], "unit bigint, x double")
    for rows in (4096, 3):
        p = sign_flip_p(df, [], "unit", "x", Resampling(resamples=100_000, shard_rows=rows, block=6400)).first().p_value
        assert p < 0.0005  # 2 of 65 536 flips; 2 of 256 if two rows shared their signs


def test_a_value_with_most_rows_is_one_run_over_many_shards(spark):
    df = spark.range(20_000).selectExpr("id as unit", "case when id % 3 = 0 then id / 1000 else 5.0 end as x")
    config = Resampling(resamples=1000, shard_rows=2048)
    x = np.where(np.arange(20_000) % 3 == 0, np.arange(20_000) / 1000, 5.0)
    half = 1.96 * x.std() / math.sqrt(len(x))
    r = bootstrap_ci(df, [], "unit", "x", config).first()
    assert r.ci_low == pytest.approx(x.mean() - half, abs=0.012) and r.ci_high == pytest.approx(x.mean() + half, abs=0.012)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from effectlab.session import work_folder

    unset = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder(session, "x")


def test_spellings_of_a_dose_do_not_double_rows(spark):
    from effectlab.functions.keys import label_for, repeated_levels

    levels = spark.createDataFrame([("2", "two"), ("2.0", "zwei"), ("0.00001", "tiny"), ("1000000", "huge"), ("x", "no")], "level_key string, level string")
    df = spark.createDataFrame([("t", 2.0), ("t", 1e-5), ("t", 1e6), ("t", 5.0), ("o", 2.0)], "arm string, dose double")
    got = {(r.arm, r.dose): (r.label, r.label_missing) for r in label_for(df, levels, base="-", template="<{level}>", target_arm="t").collect()}
    assert got == {("t", 2.0): ("<two>", False), ("t", 1e-5): ("<tiny>", False), ("t", 1e6): ("<huge>", False), ("t", 5.0): (None, True), ("o", 2.0): ("-", False)}
    assert [(float(r.dose), r.spellings, r.levels) for r in repeated_levels(levels).collect()] == [(2.0, 2, 2)]


def test_monotonicity_counts_constant_series(spark):
    rows = [(1, "a", d, float(d)) for d in range(4)] + [(2, "a", d, 1.0) for d in range(4)] + [(3, "a", d, -float(d)) for d in range(2)]
    df = spark.createDataFrame(rows, "unit int, arm string, dose int, response double")
    row = describe.monotonicity(df, resampling=FEW).first()
    assert (row.n_units, row.mean_spearman, row.ci_low) == (2, 1.0, None)


def test_describe_lists_absent_metrics(trial):
    rows = describe.describe(trial, ["score", "nowhere"], resampling=None).where("metric = 'nowhere'").collect()
    assert len(rows) == 10 and all((r.n_units, r.n_missing, r.mean) == (0, 4, None) for r in rows)


def test_missingness_without_flag_columns(trial):
    row = describe.missingness(trial).first()
    assert (row.attempted, row.generated) == (4, 0)


REPEATS = "seed bigint, method string, alpha double, generation_complete boolean, skin_tone_change double, lpips double, line int"


def test_repeats_that_agree_collapse_to_the_first(spark):
    rows = [(31, "k", 2.5, True, 7.0, 0.25, 9), (31, "k", 2.5, True, 7.0 - 2e-10, 0.25, 4), (31, "k", 2.5, True, 7.0, 0.25, 6), (32, "k", 2.5, True, 1.0, None, 5)]
    out = dedup.dedup_verified(spark.createDataFrame(rows, REPEATS), ["line"], names=LEDGER).require_agreement()
    assert sorted((r.seed, r.line) for r in out.rows.collect()) == [(31, 4), (32, 5)]
    assert [tuple(r) for r in out.repeats.collect()] == [(31, "k", 2.5, 3)]


def test_repeats_that_disagree_are_named_by_column(spark):
    rows = [(40, "k", -3.0, True, 6.0, 0.5, 1), (40, "k", -3.0, True, 6.5, 0.5, 2), (41, "k", -3.0, True, 6.0, 0.5, 3), (41, "k", -3.0, None, 6.0, 0.75, 4)]
    out = dedup.dedup_verified(spark.createDataFrame(rows, REPEATS), ["line"], names=LEDGER)
    got = {r["seed"]: r["columns"] for r in out.conflicts.collect()}
    assert got == {40: "skin_tone_change", 41: "generation_complete,lpips"}
    with pytest.raises(ContractViolation, match="disagree"):
        out.require_agreement()


def test_selected_unit_is_the_middle_of_the_most_complete(spark):
    rows = [(u, arm, d, 2.5, not (u == 8 and arm == "q"), base) for u, base in ((2, 61.0), (5, 40.0), (8, 52.0), (9, 47.0)) for arm in ("p", "q") for d in (-1, 1)]
    df = spark.createDataFrame(rows, "unit int, arm string, direction int, target_change double, match_complete boolean, base double")
    row = selection.select_unit(df, "base").first()  # unit 8 is half complete; 47 is the median of 40, 47 and 61
    assert (row.selected_unit, row.max_complete_rows, row.candidates, row.median_baseline) == (9, 4, 3, 47.0)


def test_quantile_summary(spark):
    df = spark.createDataFrame([(8, v) for v in (0.1, 0.2, 0.3, 0.4)], "pair_count int, raw_cosine double")
    row = describe.quantile_summary(df, "pair_count", ["raw_cosine"]).first()
    assert row.n_resamples == 4 and row.median == pytest.approx(0.25) and row.q025 < row.median < row.q975


def test_shards_are_round_robin(spark):
    df = spark.createDataFrame([(i,) for i in range(10, 20)], "u int")
    assert [r.u for r in selection.shard(df, 0, 3, "u").orderBy("u").collect()] == [10, 13, 16, 19]
    with pytest.raises(ValueError):
        selection.shard(df, 3, 3, "u")


def test_top2_gap(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.5), ("b", 2.0), ("b", 2.0), ("c", 1.0)], "g string, s double")
    assert {r.g: r.gap for r in selection.top2_gap(df, "s", ["g"]).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}
    assert selection.top2_gap(df, "s").first().gap == 0.5


def test_first_per_key_follows_the_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (None, 2, "b")], "k int, line int, v string")
    got = {r.k: r.v for r in first_per_key(df, ["k"], ["line"]).collect()}
    assert got == {1: "a", None: "b"}


def test_one_row_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    assert one_row(df, k=1).v == "a"
    with pytest.raises(ContractViolation):
        one_row(df, v="a")
