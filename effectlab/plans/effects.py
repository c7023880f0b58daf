"""Plans: matching, description, resampling and contrasts over the trial ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlab.contracts import matching_rows
from effectlab.functions.keys import with_direction
from effectlab.functions.ordering import average_ranks, first_per_key
from effectlab.operators import contrast, describe, match, selection
from effectlab.operators.multiplicity import holm
from effectlab.operators.resample import bootstrap_ci, sign_flip_p
from effectlab.plans import fixtures as fx
from effectlab.plans.registry import plan, q6, r6, rounded


def matched(spark, sf):
    return match.match_at_target(fx.trial_ledger(spark, sf), [fx.TARGET], fx.TOLERANCE)


COVERAGE_SQL = f"""with {fx.NEAREST}
select arm, direction, target_change, count(distinct unit) attempted_units,
  count(distinct unit) filter (where match_complete) complete_units,
  {q6("count(distinct unit) filter (where match_complete) / count(distinct unit)")} coverage_rate,
  {q6("avg(aligned_change) filter (where match_complete)")} mean_achieved_change,
  {q6("stddev_samp(aligned_change) filter (where match_complete)")} std_achieved_change,
  {q6("avg(match_distance) filter (where match_complete)")} mean_match_distance,
  {q6("median(match_distance) filter (where match_complete)")} median_match_distance
from matched group by all"""


@plan("a4_coverage", COVERAGE_SQL)
def a4_coverage(spark, sf):
    return rounded(
        match.coverage(matched(spark, sf)),
        "coverage_rate", "mean_achieved_change", "std_achieved_change", "mean_match_distance", "median_match_distance",
    )


@plan(
    "j9_match_at_target",
    f"""with {fx.NEAREST} select unit, arm, direction, target_change, dose, {q6("aligned_change")} aligned_change,
    {q6("match_distance")} match_distance, match_complete from matched""",
)
def j9_match_at_target(spark, sf):
    return matched(spark, sf).select(
        "unit", "arm", "direction", "target_change", "dose", r6("aligned_change"), r6("match_distance"), "match_complete"
    )


DOSES = "arm, dose"


@plan(
    "x10_direction",
    f"""with {fx.TRIAL} select unit, arm, dose, sign(dose)::int direction, {q6("sign(dose) * response")} aligned_change from trial""",
)
def x10_direction(spark, sf):
    return with_direction(fx.trial_ledger(spark, sf)).select("unit", "arm", "dose", "direction", r6("aligned_change"))


LONG = fx.TRIAL + """,
long as (select arm, dose, unit, 'response' metric, response x from trial
  union all select arm, dose, unit, 'cost', cost from trial union all select arm, dose, unit, 'tax', tax from trial
  union all select arm, dose, unit, 'quality', quality from trial union all select arm, dose, unit, 'absent', null from trial)"""


@plan(
    "a1_describe",
    f"""with {LONG}, {fx.bootstrap_sql("long", "arm, dose, metric")},
    stats as (select arm, dose, metric, count(x) n_units, count(distinct unit) - count(x) n_missing, avg(x) m,
        stddev_samp(x) s, median(x) md from long group by all)
    select arm, dose, metric, n_units, n_missing, {q6("m")} mean, {q6("s")} std, {q6("md")} median,
        {q6("ci_low")} ci_low, {q6("ci_high")} ci_high
    from stats left join ci using (arm, dose, metric)""",
)
def a1_describe(spark, sf):
    table = describe.describe(fx.trial_ledger(spark, sf), [*fx.METRICS, "absent"])
    return rounded(table, "mean", "std", "median", "ci_low", "ci_high")


@plan(
    "a1_describe_plain",
    f"""with {LONG} select arm, dose, metric, count(x) n_units, count(distinct unit) - count(x) n_missing,
    {q6("avg(x)")} mean, {q6("stddev_samp(x)")} std, {q6("median(x)")} median from long group by all""",
)
def a1_describe_plain(spark, sf):
    table = describe.describe(fx.trial_ledger(spark, sf), [*fx.METRICS, "absent"], resampling=None)
    return rounded(table, "mean", "std", "median")


MISSING = """miss as (select arm, dose, count(*) attempted, count(*) filter (where generated) generated,
  count(*) filter (where complete) evaluation_complete from trial group by all)"""


@plan(
    "a2_missingness",
    f"""with {fx.TRIAL}, {MISSING} select *, {q6("(attempted - generated) / attempted")} generation_failure_rate,
    {q6("(attempted - evaluation_complete) / attempted")} metric_failure_rate from miss""",
)
def a2_missingness(spark, sf):
    return rounded(describe.missingness(fx.trial_ledger(spark, sf)), "generation_failure_rate", "metric_failure_rate")


@plan(
    "a3_completion",
    f"""with {fx.TRIAL}, {MISSING}, s as (select arm, sum(attempted)::BIGINT attempted, sum(generated)::BIGINT generated,
    sum(evaluation_complete)::BIGINT evaluation_complete from miss group by arm)
    select *, {q6("generated / attempted")} generation_rate, {q6("evaluation_complete / attempted")} evaluation_rate from s""",
)
def a3_completion(spark, sf):
    table = describe.completion(describe.missingness(fx.trial_ledger(spark, sf)))
    return rounded(table, "generation_rate", "evaluation_rate")


@plan(
    "a5_coverage_expected",
    f"""with {fx.NEAREST}, planned as (select s_suppkey unit from supplier where s_suppkey % 5 <> 0)
    select arm, direction, target_change, (select count(*) from planned) expected_units,
      count(distinct unit) filter (where unit in (select unit from planned)) observed_units,
      count(distinct unit) filter (where match_complete) matched_units,
      {q6("count(distinct unit) filter (where match_complete) / (select count(*) from planned)")} coverage_rate,
      {q6("median(match_distance)")} median_match_distance, {q6("max(match_distance)")} max_match_distance
    from matched group by all""",
)
def a5_coverage_expected(spark, sf):
    planned = fx.table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("unit"))
    table = match.coverage_expected(matched(spark, sf), planned)
    return rounded(table, "coverage_rate", "median_match_distance", "max_match_distance")


@plan(
    "a6_full_coverage",
    f"""with {fx.NEAREST}, n as (select count(*) n from supplier),
    cov as (select arm, direction, count(distinct unit) filter (where match_complete) m from matched group by all),
    want as (select arm, d direction from (select distinct arm from trial) cross join (select unnest([-1, 1]) d)),
    j as (select w.arm wa, c.arm ca, c.m from want w full join cov c on w.arm = c.arm and w.direction = c.direction)
    select count(wa) expected_strata, count(*) filter (where ca is null) missing_strata,
      count(*) filter (where wa is null) extra_strata, count(*) filter (where m <> (select n from n)) short_strata,
      count(*) filter (where ca is null or wa is null or m <> (select n from n)) = 0 and count(ca) > 0 full_coverage from j""",
)
def a6_full_coverage(spark, sf):
    suppliers = fx.table(spark, sf, "supplier")
    covered = match.coverage_expected(matched(spark, sf), suppliers.select(F.col("s_suppkey").alias("unit")))
    return match.full_coverage(covered, fx.trial_ledger(spark, sf))


SPEARMAN = fx.TRIAL + """,
rk as (select unit, arm, rank() over (partition by unit, arm order by dose)
    + (count(*) over (partition by unit, arm, dose) - 1) / 2.0 x,
  rank() over (partition by unit, arm order by response) + (count(*) over (partition by unit, arm, response) - 1) / 2.0 y
  from trial where response is not null),
sp as (select unit, arm, case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end x from rk group by all having count(*) >= 3)"""


@plan(
    "a7_monotonicity",
    f"""with {SPEARMAN}, {fx.bootstrap_sql("sp", "arm")}
    select arm, n_units, {q6("m")} mean_spearman, {q6("md")} median_spearman, {q6("ci_low")} ci_low, {q6("ci_high")} ci_high
    from (select arm, count(*) n_units, avg(x) m, median(x) md from sp group by arm) left join ci using (arm)""",
)
def a7_monotonicity(spark, sf):
    table = describe.monotonicity(fx.trial_ledger(spark, sf))
    return rounded(table, "mean_spearman", "median_spearman", "ci_low", "ci_high")


@plan(
    "a10_quantile_summary",
    f"""with long as (select l_returnflag arm, 'l_extendedprice' metric, l_extendedprice x from lineitem
      union all select l_returnflag, 'l_quantity', l_quantity from lineitem)
    select arm, metric, count(x) n_resamples, {q6("avg(x)")} mean, {q6("median(x)")} median,
    {q6("quantile_cont(x, 0.025)")} q025, {q6("quantile_cont(x, 0.975)")} q975 from long group by all""",
)
def a10_quantile_summary(spark, sf):
    rows = fx.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "arm")
    table = describe.quantile_summary(rows, "arm", ["l_extendedprice", "l_quantity"])
    return rounded(table, "mean", "median", "q025", "q975")


@plan(
    "a11_summarize_runs",
    f"""with {LONG}, used as (select * from long where metric in ('cost', 'tax')),
    {fx.bootstrap_sql("used", "arm, dose, metric")},
    stats as (select arm, dose, metric, count(x) n, avg(x) m, stddev_samp(x) s from used group by all)
    select arm, dose, metric, stats.n, {q6("m")} mean, {q6("s")} std, {q6("ci_low")} ci95_low, {q6("ci_high")} ci95_high
    from stats left join ci using (arm, dose, metric)""",
)
def a11_summarize_runs(spark, sf):
    table = describe.summarize_runs(fx.trial_ledger(spark, sf), ["cost", "tax"])
    return rounded(table, "mean", "std", "ci95_low", "ci95_high")


@plan(
    "a12_summarize_batch",
    f"""with {LONG} select metric, {q6("(select avg(complete::int) * 100 from trial)")} pct_passed, count(x) n, {q6("avg(x)")} mean,
    {q6("stddev_samp(x)")} std, {q6("median(x)")} median from long where metric <> 'absent' group by metric""",
)
def a12_summarize_batch(spark, sf):
    table = describe.summarize_batch(fx.trial_ledger(spark, sf), fx.METRICS, "complete")
    return rounded(table, "pct_passed", "mean", "std", "median")


@plan(
    "a13_group_means",
    f"""with {fx.TRIAL} select arm, dose, {q6("avg(cost)")} cost, {q6("avg(quality)")} quality,
    {q6("avg(complete::int)")} complete from trial group by all""",
)
def a13_group_means(spark, sf):
    table = describe.group_means(fx.trial_ledger(spark, sf), ["arm", "dose"], ["cost", "quality", "complete"])
    return rounded(table, "cost", "quality", "complete")


PRICE = """val as (select o_orderstatus arm, o_orderkey unit, o_totalprice x from orders)"""


@plan(
    "b1_bootstrap_ci",
    f"""with {fx.TRIAL}, val as (select arm, dose, unit, response x from trial), {fx.bootstrap_sql("val", DOSES)}
    select arm, dose, n, {q6("ci_low")} ci_low, {q6("ci_high")} ci_high from ci""",
)
def b1_bootstrap_ci(spark, sf):
    table = bootstrap_ci(fx.trial_ledger(spark, sf), ["arm", "dose"], "unit", "response")
    return rounded(table, "ci_low", "ci_high")


@plan(
    "b1_bootstrap_ci_large",
    f"""with {PRICE}, {fx.bootstrap_sql("val", "arm")} select arm, n, {q6("ci_low")} ci_low, {q6("ci_high")} ci_high from ci""",
)
def b1_bootstrap_ci_large(spark, sf):
    """Strata of many rows, all orders: several shards from some tens of thousands of rows on."""
    rows = fx.table(spark, sf, "orders").selectExpr("o_orderstatus as arm", "o_orderkey as unit", "o_totalprice as x")
    return rounded(bootstrap_ci(rows, ["arm"], "unit", "x"), "ci_low", "ci_high")


@plan(
    "b2_sign_flip_p",
    f"""with {fx.PAIRS}, val as (select comparator, direction, outcome, unit, advantage x from pairs),
    {fx.sign_flip_sql("val", "comparator, direction, outcome")}
    select comparator, direction, outcome, n, {q6("p_value")} p_value from sf""",
)
def b2_sign_flip_p(spark, sf):
    pairs = contrast.pair_arms(matched(spark, sf), fx.REFERENCE_ARM, fx.OUTCOMES)
    table = sign_flip_p(pairs, ["comparator", "direction", "outcome"], "unit", "advantage")
    return rounded(table, "p_value")


@plan(
    "j1_pair_arms",
    f"""with {fx.PAIRS} select unit, direction, target_change, comparator, outcome, {q6("advantage")} advantage from pairs""",
)
def j1_pair_arms(spark, sf):
    return rounded(contrast.pair_arms(matched(spark, sf), fx.REFERENCE_ARM, fx.OUTCOMES), "advantage")


def strata_sql(extra: str = "") -> str:
    lead = f"{extra}, " if extra else ""
    join = "join" if extra else "cross join"
    using = f"using ({extra})" if extra else ""
    return f"""levels as (select distinct {lead}arm, direction, target_change from matched where match_complete),
    strata as (select {lead}comparator, direction, target_change, outcome from
      (select distinct {lead}arm comparator from levels where arm <> 'N')
      {join} (select distinct {lead}direction from levels) {using}
      {join} (select distinct {lead}target_change from levels) {using}
      cross join (select unnest(['quality', 'cost', 'tax', 'n']) outcome))"""


def contrasts_sql(source: str, extra: str = "") -> str:
    lead = f"{extra}, " if extra else ""
    by = f"{lead}comparator, direction, target_change, outcome"
    return f"""val as (select {by}, unit, advantage x from {source}),
    {fx.bootstrap_sql("val", by)}, {fx.sign_flip_sql("val", by)}, {strata_sql(extra)},
    stats as (select {by}, count(x) n_pairs, avg(x) m, median(x) md from val where x is not null group by all),
    joined as (select {by}, coalesce(n_pairs, 0) n_pairs, m, md, ci_low, ci_high, p_value from strata
      left join stats using ({by}) left join ci using ({by}) left join sf using ({by})),
    con as (select * from {fx.holm_sql("joined", family=extra)})"""


CONTRAST_COLUMNS = f"""comparator, direction, target_change, outcome, n_pairs, {q6("m")} mean_reference_advantage,
    {q6("md")} median_reference_advantage, {q6("ci_low")} ci_low, {q6("ci_high")} ci_high, {q6("p_value")} p_value, {q6("p_holm")} p_holm"""
CONTRAST_NUMBERS = (
    "mean_reference_advantage", "median_reference_advantage", "ci_low", "ci_high", "p_value", "p_holm",
)


def contrasts(spark, sf):
    return contrast.paired_contrasts(matched(spark, sf), fx.REFERENCE_ARM, fx.OUTCOMES)


@plan("b3_paired_contrasts", f"""with {fx.PAIRS}, {contrasts_sql("pairs")} select 'N' reference_arm, {CONTRAST_COLUMNS} from con""")
def b3_paired_contrasts(spark, sf):
    return rounded(contrasts(spark, sf), *CONTRAST_NUMBERS)


TOLERANCES = (0.1, 0.25, 0.5)
SWEEP = fx.NEAREST.split(",\nmatched as")[0] + """,
matched as (select n.*, t.tolerance, match_distance <= t.tolerance match_complete
  from nearest n cross join (select unnest([0.1, 0.25, 0.5]::double[]) tolerance) t),
ref as (select * from matched where match_complete and arm = 'N'),
oth as (select * from matched where match_complete and arm <> 'N'),
wide as (select o.tolerance, o.unit, o.direction, o.target_change, o.arm comparator,
                r.quality - o.quality quality, -(r.cost - o.cost) cost, -(r.tax - o.tax) tax, (r.n - o.n)::double n
         from oth o join ref r on o.unit = r.unit and o.direction = r.direction and o.target_change = r.target_change and o.tolerance = r.tolerance),
pairs as (select tolerance, unit, direction, target_change, comparator, 'quality' outcome, quality advantage from wide
  union all select tolerance, unit, direction, target_change, comparator, 'cost', cost from wide
  union all select tolerance, unit, direction, target_change, comparator, 'tax', tax from wide
  union all select tolerance, unit, direction, target_change, comparator, 'n', n from wide)"""


@plan(
    "b4_tolerance_contrasts",
    f"""with {SWEEP}, {contrasts_sql("pairs", "tolerance")} select tolerance, 'N' reference_arm, {CONTRAST_COLUMNS} from con""",
)
def b4_tolerance_contrasts(spark, sf):
    _, table = contrast.tolerance_sweep(
        fx.trial_ledger(spark, sf), [fx.TARGET], TOLERANCES, fx.REFERENCE_ARM, fx.OUTCOMES
    )
    return rounded(table, *CONTRAST_NUMBERS)


@plan("b4_tolerance_coverage", f"""with {SWEEP}
select tolerance, arm, direction, target_change, count(distinct unit) attempted_units,
  count(distinct unit) filter (where match_complete) complete_units,
  {q6("count(distinct unit) filter (where match_complete) / count(distinct unit)")} coverage_rate,
  {q6("avg(aligned_change) filter (where match_complete)")} mean_achieved_change,
  {q6("stddev_samp(aligned_change) filter (where match_complete)")} std_achieved_change,
  {q6("avg(match_distance) filter (where match_complete)")} mean_match_distance,
  {q6("median(match_distance) filter (where match_complete)")} median_match_distance
from matched group by all""")
def b4_tolerance_coverage(spark, sf):
    table, _ = contrast.tolerance_sweep(
        fx.trial_ledger(spark, sf), [fx.TARGET], TOLERANCES, fx.REFERENCE_ARM, fx.OUTCOMES, bootstrap=None, flips=None
    )
    return rounded(
        table, "coverage_rate", "mean_achieved_change", "std_achieved_change", "mean_match_distance", "median_match_distance"
    )


@plan(
    "a20_pair_count_ranges",
    f"""with {SWEEP}, {strata_sql("tolerance")}, c as (select tolerance, comparator, direction, outcome, count(advantage) n
      from strata left join pairs using (tolerance, comparator, direction, outcome) group by all)
    select tolerance, min(n) min_pairs, max(n) max_pairs from c group by tolerance""",
)
def a20_pair_count_ranges(spark, sf):
    judged = contrast.at_tolerances(match.nearest_to_target(fx.trial_ledger(spark, sf), [fx.TARGET]), TOLERANCES)
    table = contrast.paired_contrasts(
        judged, fx.REFERENCE_ARM, fx.OUTCOMES, bootstrap=None, flips=None, extra=["tolerance"]
    )
    return contrast.pair_count_ranges(table)


FAMILY = f"""fam as (select * from {fx.holm_sql("(select * from con where comparator = 'A' and outcome = 'cost' and target_change = 3)", name="p_holm_family")})"""


def family(spark, sf, comparator="A"):
    return contrast.replication_family(contrasts(spark, sf), comparator, "cost", fx.TARGET)


@plan(
    "b5_replication_family",
    f"""with {fx.PAIRS}, {contrasts_sql("pairs")}, {FAMILY}
    select direction, case direction when -1 then 'lighter' else 'darker' end direction_label, n_pairs,
      {q6("m")} mean_reference_advantage, {q6("p_value")} p_value, {q6("p_holm_family")} p_holm_family, true family_valid from fam""",
)
def b5_replication_family(spark, sf):
    table = family(spark, sf).select(
        "direction", "direction_label", "n_pairs", "mean_reference_advantage", "p_value", "p_holm_family", "family_valid"
    )
    return rounded(table, "mean_reference_advantage", "p_value", "p_holm_family")


@plan(
    "b6_decide",
    f"""with {fx.PAIRS}, {contrasts_sql("pairs")},
    fam as (select * from {fx.holm_sql("con", family="comparator, outcome", name="p_holm_family")})
    select comparator, outcome, count(*) n_rows, case when min(n_pairs) < 12 then 'inconclusive_coverage'
      when min(m) <= 0 then 'failure_to_replicate'
      when min(ci_low) > 0 and max(p_holm_family) < 0.05 then 'strict_replication' else 'directional_replication' end decision
    from fam group by comparator, outcome""",
)
def b6_decide(spark, sf):
    """Every comparator and outcome as a family of its two directions."""
    families = holm(contrasts(spark, sf), "p_value", ["comparator", "outcome"], "p_holm_family")
    return contrast.decide(families, 12, by=["comparator", "outcome"])


@plan(
    "j2_compare_families",
    f"""with {fx.PAIRS}, {contrasts_sql("pairs")}
    select a.direction, a.outcome, a.n_pairs, {q6("a.m")} mean_reference_advantage, b.n_pairs parent_n_pairs,
      {q6("b.m")} parent_mean_reference_advantage, true one_to_one, a.m * b.m > 0 same_sign_as_parent
    from con a join con b on a.direction = b.direction and a.outcome = b.outcome
    where a.comparator = 'A' and b.comparator = 'R'""",
)
def j2_compare_families(spark, sf):
    table = contrasts(spark, sf)
    joined = contrast.compare_families(
        table.where("comparator = 'A'"), table.where("comparator = 'R'"), ["direction", "outcome"]
    )
    return rounded(
        joined.select(
            "direction", "outcome", "n_pairs", "mean_reference_advantage", "parent_n_pairs",
            "parent_mean_reference_advantage", "one_to_one", "same_sign_as_parent",
        ),
        "mean_reference_advantage", "parent_mean_reference_advantage",
    )


@plan(
    "x25_dose_response",
    f"""with {fx.TRIAL}, val as (select arm, dose, unit, response x from trial), {fx.bootstrap_sql("val", DOSES)},
    s as (select arm, dose, avg(x) m from val group by all)
    select arm, dose, {q6("m")} mean, {q6("m - ci_low")} err_low, {q6("ci_high - m")} err_high from s join ci using (arm, dose)""",
)
def x25_dose_response(spark, sf):
    table = describe.describe(fx.trial_ledger(spark, sf), ["response"])
    return rounded(describe.dose_response_table(table, "response"), "mean", "err_low", "err_high")


@plan(
    "x25_contrast_table",
    f"""with {fx.PAIRS}, {contrasts_sql("pairs")}
    select outcome, comparator, direction, {q6("m")} mean, {q6("m - ci_low")} err_low, {q6("ci_high - m")} err_high
    from con where outcome in ('cost', 'tax')""",
)
def x25_contrast_table(spark, sf):
    table = describe.contrast_table(contrasts(spark, sf), ["cost", "tax"], ["A", "R"])
    return rounded(table, "mean", "err_low", "err_high")


@plan(
    "x25_coverage_rows",
    f"""with {fx.NEAREST}, c as (select distinct arm, direction, target_change from matched)
    select count(*) n_rows, count(*) = 6 complete from c""",
)
def x25_coverage_rows(spark, sf):
    return describe.coverage_selection(match.coverage(matched(spark, sf)), fx.TARGET, ["A", "N", "R"])[1]


@plan(
    "w1_avg_rank",
    f"""select l_returnflag arm, l_orderkey, l_linenumber,
    (rank() over (partition by l_returnflag order by l_quantity)
     + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0)::DOUBLE avg_rank from lineitem""",
)
def w1_avg_rank(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr("l_returnflag as arm", "l_orderkey", "l_linenumber", "l_quantity")
    return average_ranks(rows, ["arm"], "l_quantity", "avg_rank").drop("l_quantity")


PVALUES = """pv as (select p_partkey, p_brand,
  case when p_size % 9 <> 0 then (p_size * p_size)::double / 250000 + (p_partkey % 97)::double / 1e6 end p from part)"""


def p_values(spark, sf):
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_brand",
        "case when p_size % 9 <> 0 then cast(p_size * p_size as double) / 250000 + cast(p_partkey % 97 as double) / 1e6 end as p",
    )


@plan("w2_holm", f"""with {PVALUES}
    select p_partkey, {q6("p_holm")} p_holm from {fx.holm_sql("pv", "p")}""")
def w2_holm(spark, sf):
    return rounded(holm(p_values(spark, sf), "p").select("p_partkey", "p_holm"), "p_holm")


@plan("w2_holm_family", f"""with {PVALUES}
    select p_partkey, {q6("p_holm")} p_holm from {fx.holm_sql("pv", "p", "p_brand")}""")
def w2_holm_family(spark, sf):
    return rounded(holm(p_values(spark, sf), "p", ["p_brand"]).select("p_partkey", "p_holm"), "p_holm")


@plan(
    "w3_first_per_key",
    f"""with {fx.EVENTS} select unit, arm, "day", event_id, value from
    (select *, row_number() over (partition by unit, arm, "day" order by event_id) rn from ev) where rn = 1""",
)
def w3_first_per_key(spark, sf):
    first = first_per_key(fx.trial_events(spark, sf), ["unit", "arm", "day"], ["event_id"])
    return first.select("unit", "arm", "day", "event_id", "value")


@plan(
    "w4_argmin_row",
    """select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey
    order by abs(l_quantity - 25.5), l_orderkey, l_linenumber) rn from lineitem) where rn = 1""",
)
def w4_argmin_row(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    distance = F.abs(F.col("l_quantity") - 25.5)
    return first_per_key(rows, ["l_suppkey"], [distance, "l_orderkey", "l_linenumber"]).drop("l_quantity")


@plan(
    "w5_shard",
    """select s_suppkey, s_name from (select *, row_number() over (order by s_suppkey) - 1 pos from supplier) where pos % 4 = 1""",
)
def w5_shard(spark, sf):
    return selection.shard(fx.table(spark, sf, "supplier").select("s_suppkey", "s_name"), 1, 4, "s_suppkey")


@plan(
    "a18_split_eligible",
    f"with {fx.TRIAL} select arm, generated and complete eligible, count(*) n_rows from trial group by all",
)
def a18_split_eligible(spark, sf):
    eligible, incomplete = selection.split_eligible(fx.trial_ledger(spark, sf))
    both = eligible.withColumn("eligible", F.lit(True)).unionByName(incomplete.withColumn("eligible", F.lit(False)))
    return both.groupBy("arm", "eligible").agg(F.count(F.lit(1)).alias("n_rows"))


@plan(
    "a19_select_unit",
    f"""with {fx.NEAREST}, m as (select *, dose + cost / 1000 baseline from matched),
    cov as (select unit, count(*) n from m where match_complete group by unit),
    best as (select unit from cov where n = (select max(n) from cov)),
    med as (select unit, median(baseline) b from m where unit in (select unit from best) group by unit)
    select unit selected_unit, {q6("b")} unit_baseline, {q6("(select median(b) from med)")} median_baseline,
      (select max(n) from cov) max_complete_rows, (select count(*) from best) candidates
    from med order by abs(b - (select median(b) from med)), unit limit 1""",
)
def a19_select_unit(spark, sf):
    rows = matched(spark, sf).withColumn("baseline", F.col("dose") + F.col("cost") / 1000)
    return rounded(selection.select_unit(rows, "baseline"), "unit_baseline", "median_baseline")


@plan("a21_one_row", "select count(*) n_rows, count(*) = 1 exactly_one from nation where n_name = 'NATION_7' and n_regionkey = 2")
def a21_one_row(spark, sf):
    return matching_rows(fx.table(spark, sf, "nation"), {"n_name": "NATION_7", "n_regionkey": 2})


@plan(
    "k1_preview",
    f"""with {fx.EVENTS} select unit, arm, "day", count(*) n from ev group by all having count(*) > 1 order by unit, arm, "day" limit 5""",
)
def k1_preview(spark, sf):
    counted = fx.trial_events(spark, sf).groupBy("unit", "arm", "day").agg(F.count(F.lit(1)).alias("n"))
    return selection.preview(counted.where("n > 1"), ["unit", "arm", "day"])


@plan(
    "k2_top2_gap",
    f"""select l_returnflag arm, {q6("max(l_extendedprice) - max(l_extendedprice) filter (where rn = 2)")} gap from
    (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc) rn from lineitem) group by 1""",
)
def k2_top2_gap(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), "l_extendedprice")
    return rounded(selection.top2_gap(rows, "l_extendedprice", ["arm"]), "gap")


@plan(
    "k4_union_ledgers",
    f"""with {fx.TRIAL} select 'a' run, unit, arm, dose, {q6("cost")} cost, null::double tax from trial where arm = 'A'
    union all select 'b', unit, arm, dose, null, {q6("tax")} from trial where arm <> 'A'""",
)
def k4_union_ledgers(spark, sf):
    trial = fx.trial_ledger(spark, sf)
    a = trial.where("arm = 'A'").select(F.lit("a").alias("run"), "unit", "arm", "dose", r6("cost"))
    b = trial.where("arm <> 'A'").select(F.lit("b").alias("run"), "unit", "arm", "dose", r6("tax"))
    return selection.union_ledgers(a, b)


@plan(
    "k5_key_sets",
    """with a as (select distinct o_custkey k from orders), b as (select c_custkey k from customer where c_acctbal > 0)
    select 'both' part, k from (select k from a intersect select k from b) union all
    select 'minus' part, k from (select k from a except select k from b)""",
)
def k5_key_sets(spark, sf):
    a = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = fx.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    both = selection.key_intersect(a, b, ["k"]).withColumn("part", F.lit("both"))
    return both.unionByName(selection.key_minus(a, b, ["k"]).withColumn("part", F.lit("minus")))
