"""Plans: keys, attestations, hashes, de-duplication, evidence and design contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlab.functions import keys as k
from effectlab.functions.numeric import finite, json_safe, missing_required
from effectlab.operators import attest, audit, dedup, design, evidence
from effectlab.operators.contrast import paired_contrasts
from effectlab.plans import effects
from effectlab.plans import fixtures as fx
from effectlab.plans.registry import plan, q6, r6
from effectlab.schema import Names
from effectlab.sources.manifest import explode_pairs


@plan(
    "x1_finite",
    """select event_id, case when event_id % 5 = 0 then null else value end finite_value from events""",
)
def x1_finite(spark, sf):
    text = "case event_id % 5 when 0 then element_at(array('NaN', 'inf', 'n/a', '-Infinity'), cast(event_id % 4 as int) + 1) else cast(value as string) end"
    rows = fx.table(spark, sf, "events").select("event_id", F.expr(text).alias("raw"))
    return rows.select("event_id", finite("raw").alias("finite_value"))


@plan(
    "x2_json_safe",
    """select event_id, case when event_id % 3 = 0 then null else value end v,
    case when event_id % 4 = 0 then null else value end first_value, value second_value,
    case when event_id % 5 = 0 then null else value end inner_value from events""",
)
def x2_json_safe(spark, sf):
    raw = fx.table(spark, sf, "events").selectExpr(
        "event_id", "if(event_id % 3 = 0, double('NaN'), value) as v",
        "array(if(event_id % 4 = 0, double('inf'), value), value) as a",
        "named_struct('x', if(event_id % 5 = 0, double('-inf'), value)) as s",
    )
    return json_safe(raw).selectExpr("event_id", "v", "a[0] as first_value", "a[1] as second_value", "s.x as inner_value")


@plan(
    "x3_missing_required",
    f"""with {fx.TRIAL} select unit, arm, dose, concat_ws(',', case when response is null then 'response' end,
    case when quality <= 0.4 then 'pose_difference' end, 'absent') missing, false evaluation_complete from trial""",
)
def x3_missing_required(spark, sf):
    rows = fx.trial_ledger(spark, sf).withColumn("total_pose_diff", F.when(F.col("quality") > 0.4, F.col("quality")))
    out = missing_required(rows, ["response", "cost", "pose_difference", "absent"])
    return out.select("unit", "arm", "dose", F.array_join("missing_required_metrics", ",").alias("missing"), "evaluation_complete")


SLUG = "(case when {d} >= 0 then 'p' else 'm' end || replace(printf('%.3f', abs({d})), '.', 'p'))"


@plan(
    "x4_condition_path",
    f"""with {fx.TRIAL} select unit, arm, dose, {SLUG.format(d="(dose * 0.125)::DOUBLE")} slug,
    'images/seed_' || unit || '/' || arm || '/alpha_' || {SLUG.format(d="(dose * 0.125)::DOUBLE")} || '.png' path from trial""",
)
def x4_condition_path(spark, sf):
    level = F.col("dose") * F.lit(0.125)
    return fx.trial_ledger(spark, sf).select(
        "unit", "arm", "dose", k.dose_slug(level).alias("slug"), k.condition_path("unit", "arm", level).alias("path")
    )


LEVELS = [("-5", "lowest"), ("-2.0", "low"), ("1.00", "slightly up"), ("3", "high"), ("5.0", "highest")]


@plan(
    "x5_label_for",
    f"""with {fx.TRIAL}, lv(k, level) as (values {", ".join(f"('{a}', '{b}')" for a, b in LEVELS)})
    select unit, arm, dose, case when arm <> 'A' or dose = 0 then 'plain' else replace('with {{level}} setting', '{{level}}', level) end as "label",
      arm = 'A' and dose <> 0 and level is null label_missing
    from trial left join lv on arm = 'A' and dose <> 0 and dose = k::decimal(9,4)""",
)
def x5_label_for(spark, sf):
    levels = spark.createDataFrame(LEVELS, "level_key string, level string")
    rows = fx.trial_ledger(spark, sf).select("unit", "arm", "dose")
    return k.label_for(rows, levels, base="plain", template="with {level} setting", target_arm="A")


@plan(
    "x6_fingerprint",
    """select l_orderkey, l_linenumber, substr(sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey
    || ',"l_returnflag":"' || l_returnflag || '"}'), 1, 16) fingerprint from lineitem""",
)
def x6_fingerprint(spark, sf):
    columns = ["l_returnflag", "l_orderkey", "l_linenumber"]
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k.fingerprint(columns, 16).alias("fingerprint"))


BASE_UNITS = [42, 137, 256, 911]


@plan(
    "x7_extend_units",
    """select o_orderkey, ([42, 137, 256, 911])[(o_orderkey % 4)::int + 1] + (o_orderkey // 4) * 10000 unit from orders""",
)
def x7_extend_units(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", k.extend_units("o_orderkey", BASE_UNITS).alias("unit"))


@plan("x8_content_sha256", "select doc_id, sha256(text) sha256 from documents")
def x8_content_sha256(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", k.content_sha256("text").alias("sha256"))


@plan("x9_normalize_ws", r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) digest from documents")
def x9_normalize_ws(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(k.normalize_ws("text")).alias("digest"))


@plan(
    "j3_key_audit",
    f"""with {fx.TRIAL}, {fx.DESIGN}, obs as (select unit, arm, dose from trial where generated
      union all select unit, arm, dose from trial where generated and n % 7 = 0
      union all select unit, arm, 9 from trial where dose = 1 and n % 5 = 0),
    c as (select unit, arm, dose, count(*) n_rows from obs group by all),
    j as (select coalesce(c.unit, d.unit) unit, coalesce(c.arm, d.arm) arm, coalesce(c.dose, d.dose) dose, c.n_rows, d.unit du, c.unit cu
      from c full join design d on c.unit = d.unit and c.arm = d.arm and c.dose = d.dose)
    select unit, arm, dose, coalesce(n_rows, 0) n_rows, problem from (
      select *, 'missing' problem from j where cu is null union all select *, 'extra' from j where du is null
      union all select *, 'duplicate' from j where n_rows > 1)""",
)
def j3_key_audit(spark, sf):
    trial = fx.trial_ledger(spark, sf).where("generated")
    observed = (
        trial.select("unit", "arm", "dose")
        .unionAll(trial.where("n % 7 = 0").select("unit", "arm", "dose"))
        .unionAll(fx.trial_ledger(spark, sf).where("dose = 1 and n % 5 = 0").select("unit", "arm", F.lit(9)))
    )
    return audit.key_audit(observed, fx.design(spark, sf), ["unit", "arm", "dose"])


def attestations(spark, sf):
    """Two versions for every third document (the later one counts), and an altered hash
    for every eleventh."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "lang", "source")
    right = docs.withColumn("sha256", F.when(F.col("path") % 11 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    older = docs.where("path % 3 = 0").withColumn("sha256", F.lit("superseded"))
    return older.withColumn("seq", F.col("path")).unionByName(right.withColumn("seq", F.col("path") + 10_000_000))


ATTEST = """docs as (select doc_id path, sha256(text) sha256, lang, source from documents),
att as (select path, 'superseded' sha256, lang, source, path seq from docs where path % 3 = 0
  union all select path, case when path % 11 = 0 then reverse(sha256) else sha256 end, lang, source, path + 10000000 from docs),
latest as (select * from (select *, row_number() over (partition by path order by seq desc) rn from att) where rn = 1)"""


@plan("s6_latest_attestation", f"with {ATTEST} select path, sha256, seq from latest")
def s6_latest_attestation(spark, sf):
    return attest.latest_attestation(attestations(spark, sf), ["seq"]).select("path", "sha256", "seq")


def checked_attestations(spark, sf):
    items = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "lang")
    return attest.attestation_check(items, attest.latest_attestation(attestations(spark, sf), ["seq"]), ["sha256", "lang"])


@plan(
    "j4_attestation_check",
    f"with {ATTEST} select d.path, d.sha256, d.lang, d.sha256 = l.sha256 and d.lang = l.lang valid from docs d left join latest l on d.path = l.path",
)
def j4_attestation_check(spark, sf):
    return checked_attestations(spark, sf)


@plan(
    "j4_campaign",
    f"""with {ATTEST}, v as (select d.sha256 = l.sha256 valid from docs d left join latest l on d.path = l.path)
    select count(*) n_items, count(*) filter (where valid) n_valid, bool_and(valid) campaign_complete from v""",
)
def j4_campaign(spark, sf):
    return attest.campaign_complete(checked_attestations(spark, sf))


@plan(
    "j5_hash_mismatches",
    """select doc_id, case when doc_id % 13 = 0 then 'no_recorded_hash' when doc_id % 7 = 0 then 'object_missing' else 'hash_mismatch' end reason
    from documents where doc_id % 13 = 0 or doc_id % 7 = 0 or doc_id % 11 = 0""",
)
def j5_hash_mismatches(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    recorded = docs.withColumn(
        "sha256", F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 11 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))
    )
    return audit.hash_mismatches(recorded, docs.where("doc_id % 7 <> 0"), "doc_id")


@plan(
    "j6_metadata_mismatches",
    """select p_partkey, 'p_size' field, p_size::varchar observed, (p_size + 1)::varchar expected from part where p_partkey % 5 = 0
    union all select p_partkey, 'p_brand', null, p_brand from part where p_partkey % 7 = 0""",
)
def j6_metadata_mismatches(spark, sf):
    part = fx.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    observed = part.withColumn("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")))
    expected = part.withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return audit.metadata_mismatches(observed, expected, "p_partkey", ["p_brand", "p_type", "p_size"])


@plan(
    "j7_overlap",
    """with e as (select distinct ([3, 5, 8])[(c_custkey % 3)::int + 1] + (c_custkey // 3) * 10000 unit from customer)
    select unit from e intersect select o_orderkey from orders""",
)
def j7_overlap(spark, sf):
    data = fx.table(spark, sf, "customer").select(k.extend_units("c_custkey", [3, 5, 8]).alias("unit"))
    return audit.overlap(data, fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit")), "unit")


@plan(
    "j8_missing_refs",
    f"""with {fx.TRIAL} select distinct 'images/seed_' || unit || '/' || arm || '/alpha_' || {SLUG.format(d="dose::DOUBLE")} || '.png' image_path
    from trial where not generated""",
)
def j8_missing_refs(spark, sf):
    ledger = fx.trial_ledger(spark, sf).withColumn("image_path", k.condition_path("unit", "arm", "dose"))
    return audit.missing_refs(ledger, ledger.where("generated").select("image_path"), "image_path")


@plan(
    "j10_remaining",
    f"with {fx.TRIAL}, {fx.DESIGN} select unit, arm, dose from design except select unit, arm, dose from trial where generated",
)
def j10_remaining(spark, sf):
    return audit.remaining(fx.design(spark, sf), fx.trial_ledger(spark, sf).where("generated"), ["unit", "arm", "dose"])


ARM_DOSES = {"A": [-1.5, -0.5, 0.0, 0.5, 1.5], "N": [-1.0, 0.0, 0.5], "R": [-2.0, 0.0, 0.2]}


@plan(
    "j11_condition_matrix",
    f"""with d(arm, dose) as (values {", ".join(f"('{a}', {x}::DOUBLE)" for a, g in ARM_DOSES.items() for x in g)})
    select s_suppkey unit, arm, dose from supplier cross join d""",
)
def j11_condition_matrix(spark, sf):
    return audit.condition_matrix(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit")), ARM_DOSES)


@plan(
    "j12_evidence_presence",
    r"""with s as (select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) s from benchmark),
    d as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents),
    f as (select item_id, count(*) n from s join d on contains(t, s) group by item_id)
    select item_id, (select count(*) from d) n_required, coalesce(n, 0) n_present, (select count(*) from d) - coalesce(n, 0) n_missing,
      coalesce(n, 0) = (select count(*) from d) present_in_all from s left join f using (item_id)""",
)
def j12_evidence_presence(spark, sf):
    return evidence.evidence_presence(fx.table(spark, sf, "benchmark"), fx.table(spark, sf, "documents"), "item_id", "doc_id")


@plan(
    "j12_common_anchors",
    r"""with b as (select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from benchmark),
    s as (select item_id * 2 sid, regexp_extract(t, '^[^ ]+') s from b union all select item_id * 2 + 1, regexp_extract(t, '^[^ ]+ [^ ]+ [^ ]+') from b),
    d as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents),
    f as (select sid, count(*) n from s join d on contains(t, s) group by sid)
    select sid, (select count(*) from d) n_required, coalesce(n, 0) n_present, (select count(*) from d) - coalesce(n, 0) n_missing,
      coalesce(n, 0) = (select count(*) from d) present_in_all from s left join f using (sid)""",
)
def j12_common_anchors(spark, sf):
    """The first word and the first three words of every item: words that most documents hold."""
    text = k.normalize_ws("text")
    first = F.regexp_extract(text, "^[^ ]+", 0)
    three = F.regexp_extract(text, "^[^ ]+ [^ ]+ [^ ]+", 0)
    parts = F.array(F.struct((F.col("item_id") * 2).alias("sid"), first.alias("text")), F.struct((F.col("item_id") * 2 + 1).alias("sid"), three.alias("text")))
    snippets = fx.table(spark, sf, "benchmark").select(F.inline(parts))
    return evidence.evidence_presence(snippets, fx.table(spark, sf, "documents"), "sid", "doc_id")


@plan(
    "j13_with_baseline",
    f"""with {fx.TRIAL} select t.unit, t.arm, t.dose, {q6("t.cost - b.cost")} cost_change, {q6("b.quality")} baseline_quality
    from trial t join trial b on t.unit = b.unit and t.arm = b.arm and b.dose = 0 where t.dose <> 0""",
)
def j13_with_baseline(spark, sf):
    out = audit.with_baseline(fx.trial_ledger(spark, sf), ["cost", "quality"], ["unit", "arm"])
    return out.select("unit", "arm", "dose", r6(F.col("cost") - F.col("baseline_cost"), "cost_change"), r6("baseline_quality"))


A14_FACTS = f"""{fx.TRIAL}, {fx.DESIGN}, led as (select *, case when n % 17 = 0 then 'other' else 'fp' end fp, unit || '/' || arm || '/' || dose k,
    'images/seed_' || unit || '/' || arm || '/alpha_' || {SLUG.format(d="dose::DOUBLE")} || '.png' path from trial),
    lost as (from design select unit, arm, dose except from led select unit, arm, dose), n as (select (select count(*) from led) l, (select count(*) from design) d),
    off as (select 'exact_condition_keys' "check", unit || '/' || arm || '/' || dose "key", 'missing' detail, 1 n from lost
    union all select 'row_count', 'ledger', l || ' of ' || d, abs(l - d) from n where l <> d
    union all select 'result_fingerprint', k, fp, 1 from led where fp <> 'fp'
    union all select 'all_generations_complete', k, null, 1 from led where not generated
    union all select 'manifest_rows', 'manifest', '3', 2
    union all select 'manifest_fingerprint', 'manifest', 'fp2', 1
    union all select 'manifest_study_status', 'manifest', 'planned', 2
    union all select 'manifest_condition_count', 'manifest', (d + 2)::varchar, 1 from n
    union all select 'manifest_seed_set', unit::varchar, 'not in the manifest', 1 from (select distinct unit from design where unit % 10 = 0)
    union all select distinct 'all_referenced_images_present', path, 'absent', 1 from led where not generated
    union all select 'direction_tensors_present', 'directions', (select count(*) from region)::varchar, abs((select count(*) from region) - 2)
    union all select 'archived_config_fingerprint', 'archived', 'older', 1)"""


def a14_offenders(spark, sf):
    """A run with faults of every kind: three manifest rows, two of which are wrong."""
    ledger = fx.trial_ledger(spark, sf).select(
        "*", F.when(F.col("n") % 17 == 0, "other").otherwise("fp").alias("config_fingerprint"),
        F.lit("study").alias("study_id"), k.condition_path("unit", "arm", "dose").alias("image_path"),
    )
    planned = fx.design(spark, sf)
    wrong = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    manifest = planned.agg(F.count(F.lit(1)).alias("conditions")).select("conditions", wrong).select(
        F.expr("conditions + if(i = 2, 2, 0)").alias("condition_count"), F.expr("if(i = 1, 'fp2', 'fp')").alias("config_fingerprint"),
        F.lit("study").alias("study_id"), F.expr("if(i = 0, 'preregistered', 'planned')").alias("study_status"), F.lit("confirmatory").alias("execution_mode"),
    )
    expected = {"config_fingerprint": "fp", "study_id": "study", "study_status": "preregistered"}
    directions = fx.table(spark, sf, "region").select(F.col("r_name").alias("path"))
    units = planned.where("unit % 10 <> 0").select("unit")
    listing = ledger.where("generated").select("image_path")
    return audit.run_offenders(ledger, planned, manifest, units, expected, listing, directions, "older")


@plan("a14_run_offenders", f"""with {A14_FACTS} select "check", "key", detail, n::BIGINT n from off""")
def a14_run_offenders(spark, sf):
    return a14_offenders(spark, sf)


@plan(
    "a14_run_audit",
    f"""with {A14_FACTS}, c as (select unnest([{", ".join(f"'{c}'" for c in audit.RUN_CHECKS)}]) "check")
    select "check", coalesce(sum(n), 0)::BIGINT n_violations, min(case when "check" in ('result_fingerprint', 'manifest_rows', 'manifest_fingerprint',
      'manifest_study_status', 'manifest_condition_count', 'direction_tensors_present') then detail else "key" end) sample
    from c left join off using ("check") group by "check\"""",
)
def a14_run_audit(spark, sf):
    return audit.checks_of(a14_offenders(spark, sf)).select("check", "n_violations", "sample")


@plan(
    "a15_fingerprint_audit",
    """select count(distinct l_returnflag) n_fingerprints, count(*) filter (where l_returnflag <> 'N') foreign_rows,
    count(*) filter (where l_returnflag <> 'N') = 0 passed from lineitem""",
)
def a15_fingerprint_audit(spark, sf):
    return audit.fingerprint_audit(fx.table(spark, sf, "lineitem"), "N", "l_returnflag")


@plan(
    "a16_analysis_audit",
    f"""with {fx.NEAREST}, {fx.DESIGN}, {effects.strata_sql()}
    select (select count(*) from trial) input_rows, (select count(distinct unit) from trial) unique_units,
      (select count(*) from design) expected_conditions, (select count(*) from matched) matched_rows, (select count(*) from strata) contrast_rows""",
)
def a16_analysis_audit(spark, sf):
    matched = effects.matched(spark, sf)
    contrasts = paired_contrasts(matched, fx.REFERENCE_ARM, fx.OUTCOMES, bootstrap=None, flips=None)
    return audit.analysis_audit(fx.trial_ledger(spark, sf), fx.design(spark, sf), matched, contrasts)


DAYS = Names(unit="unit", arm="arm", dose="day")
DEDUP = fx.EVENTS + """, g as (select unit, arm, "day", min_by(event_id, event_id) event_id, min_by(value, event_id) value, count(*) n_repeats,
  max(value) - min_by(value, event_id) > 40 or min_by(value, event_id) - min(value) > 40 far, min(props) <> max(props) mixed from ev group by all)"""


def deduplicated(spark, sf):
    return dedup.dedup_verified(fx.trial_events(spark, sf), ["event_id"], ["value", "props"], 40.0, DAYS)


@plan("a17_dedup_rows", f"""with {DEDUP} select unit, arm, "day", event_id, value from g""")
def a17_dedup_rows(spark, sf):
    return deduplicated(spark, sf).rows.select("unit", "arm", "day", "event_id", "value")


@plan("a17_dedup_repeats", f"""with {DEDUP} select unit, arm, "day", n_repeats from g where n_repeats > 1""")
def a17_dedup_repeats(spark, sf):
    return deduplicated(spark, sf).repeats


@plan(
    "a17_dedup_conflicts",
    f"""with {DEDUP} select unit, arm, "day", concat_ws(',', case when far then 'value' end, case when mixed then 'props' end) as "columns"
    from g where far or mixed""",
)
def a17_dedup_conflicts(spark, sf):
    return deduplicated(spark, sf).conflicts


@plan(
    "s4_source_profile",
    """select source source_path, sha256(arg_min(text, doc_id)) sha256, count(*) as "rows", count(distinct lang) n_fingerprints from documents group by source""",
)
def s4_source_profile(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("source").alias("source_path"), F.col("lang").alias("config_fingerprint"), "doc_id", "text")
    contents = rows.groupBy("source_path").agg(F.min_by("text", "doc_id").alias("content"))
    return audit.source_profile(rows, contents)


@plan(
    "s4_source_fingerprints",
    """select source source_path, lang config_fingerprint, count(*) as "rows" from documents where lang is not null group by all""",
)
def s4_source_fingerprints(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("source").alias("source_path"), F.col("lang").alias("config_fingerprint"))
    return audit.source_fingerprints(rows)


@plan(
    "s5_explode_pairs",
    """with p as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 position, l_partkey, l_linenumber,
      l_returnflag, l_linestatus from lineitem)
    select l_orderkey, position::int position, l_linenumber::varchar pair_id, l_partkey seed, 'l/' || l_returnflag light_path, 'd/' || l_linestatus dark_path,
      case when position < 2 then 'train' else 'holdout' end split from p where position < 3""",
)
def s5_explode_pairs(spark, sf):
    ref = "named_struct('descriptor', '{g}', 'path', concat('{g}/', {c}), 'sha256', md5({c}))"
    pair = (
        "struct(l_linenumber as o1, l_partkey as o2, l_suppkey as o3, l_extendedprice as o4, cast(l_linenumber as string) as pair_id, l_partkey as seed, "
        f"{ref.format(g='l', c='l_returnflag')} as light, {ref.format(g='d', c='l_linestatus')} as dark)"
    )
    # An order has a handful of lines: one manifest per order.
    manifests = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.expr(f"array_sort(array_agg({pair})) as pairs"))
    out = explode_pairs(manifests, 2, 1)
    return out.select("l_orderkey", "position", "pair_id", "seed", "light_path", "dark_path", "split")


C1_ARMS = ("A", "N", "R")


def design_tables(spark, sf):
    """Suppliers as studies, their line items as units, doses and roles."""
    li = fx.table(spark, sf, "lineitem").withColumn("study", F.col("l_suppkey"))
    studies = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey as study",
        "element_at(array('planned', 'calibration', 'draft', 'pilot'), cast(s_suppkey % 4 as int) + 1) as status",
        "cast(512 + s_suppkey % 9 as int) as height", "512 as width", "cast(s_suppkey % 30 as int) as inference_steps",
        "cast(s_suppkey % 5 as int) + 1 as train_pairs", "cast(s_suppkey % 3 as int) as held_out_pairs",
        "cast(900 + s_suppkey * 7 % 200 as int) as resamples", "0.45 + s_suppkey % 10 * 0.06 as confidence",
        "s_acctbal as tolerance", "element_at(array('A', 'N', 'Z'), cast(s_suppkey % 3 as int) + 1) as reference_arm",
    )
    doses = li.where("l_quantity > 44").selectExpr("study", "l_returnflag as arm", "cast(round(l_discount * 100) - 5 as int) as dose")
    roles = li.where("l_quantity > 40").selectExpr(
        "study", "l_returnflag as arm", "if(l_linenumber % 3 = 0, 'feasibility', 'matched') as role"
    ).distinct()
    return design.DesignTables(
        studies=studies,
        units=li.where("l_linenumber = 1").selectExpr("study", "l_orderkey as unit"),
        data_units=li.where("l_linenumber = 2 and l_quantity < 10").groupBy("study").agg(F.min("l_orderkey").alias("unit")).selectExpr("study", "0 as position", "unit"),
        doses=doses,
        roles=roles,
        levels=li.where("l_quantity = 50").selectExpr("study", "cast(round(l_discount * 100) - 5 as string) as level_key"),
        metrics=li.selectExpr("study", "if(l_tax > 0.07, 'face_similarity', 'skin_tone_change') as metric").distinct(),
        gates=li.selectExpr("study", "element_at(array('min_detection_rate', 'min_pair_order_accuracy', 'min_median_pair_gap_ita', 'max_median_abs_ita_shift', 'max_p95_abs_ita_shift'), l_linenumber % 5 + 1) as gate", "l_quantity - 2 as value"),
        perturbations=li.where("l_quantity = 1").selectExpr("study", "l_returnflag as name"),
    )


C1_SQL = """with li as (select *, l_suppkey study from lineitem),
st as (select s_suppkey study, (['planned', 'calibration', 'draft', 'pilot'])[(s_suppkey % 4)::int + 1] status, 512 + s_suppkey % 9 height,
  s_suppkey % 30 steps, s_suppkey % 5 + 1 tp, s_suppkey % 3 hp, 900 + s_suppkey * 7 % 200 resamples, 0.45 + s_suppkey % 10 * 0.06 confidence,
  s_acctbal tolerance, (['A', 'N', 'Z'])[(s_suppkey % 3)::int + 1] reference_arm from supplier),
un as (select study, l_orderkey unit from li where l_linenumber = 1),
du as (select study, min(l_orderkey) unit from li where l_linenumber = 2 and l_quantity < 10 group by study),
dz as (select study, l_returnflag arm, cast(round(l_discount * 100) - 5 as int) dose from li where l_quantity > 44),
ro as (select distinct study, l_returnflag arm, case when l_linenumber % 3 = 0 then 'feasibility' else 'matched' end role from li where l_quantity > 40),
lv as (select distinct study, cast(round(l_discount * 100) - 5 as int) l from li where l_quantity = 50),
me as (select distinct study, case when l_tax > 0.07 then 'face_similarity' else 'skin_tone_change' end metric from li),
ga as (select study, (['min_detection_rate', 'min_pair_order_accuracy', 'min_median_pair_gap_ita', 'max_median_abs_ita_shift', 'max_p95_abs_ita_shift'])[l_linenumber % 5 + 1] gate, l_quantity - 2 v from li),
pe as (select distinct study from li where l_quantity = 1),
arms as (select study, a arm from st cross join (select unnest(['A', 'N', 'R']) a)),
ex as (select du.study, du.unit + i * 10000 unit from du join st on du.study = st.study cross join (select unnest(range(10)) i) where i < tp + hp),
gr as (select dz.study, arm, status, count(*) - count(distinct dose) rep, bool_or(dose = 0) z, bool_or(dose < 0) b, bool_or(dose > 0) a from dz join st on dz.study = st.study group by all),
r as (
  select study, 'status_unknown' rule from st where status = 'draft'
  union all select study, 'sides_not_divisible_by_8' from st where height % 8 <> 0
  union all select study, 'inference_steps_below_1' from st where steps < 1
  union all select study, 'pair_split_too_small' from st where tp < 2 or hp < 1
  union all select study, 'resamples_below_1000' from st where resamples < 1000
  union all select study, 'confidence_out_of_range' from st where not (confidence > 0.5 and confidence < 1)
  union all select study, 'tolerance_not_positive' from st where not tolerance > 0
  union all select study, 'units_empty' from st where study not in (select study from un)
  union all select study, 'units_repeated' from (select study, unit from un group by all having count(*) > 1)
  union all select study, 'units_overlap_data' from (select study, unit from un intersect select study, unit from ex)
  union all select study, 'arm_without_doses' from (select study, arm from arms except select study, arm from dz)
  union all select study, 'doses_without_zero' from gr where not z
  union all select study, 'doses_one_sided' from gr where status <> 'calibration' and not (a and b)
  union all select study, 'doses_repeated' from gr where rep > 0
  union all select study, 'roles_empty' from st where study not in (select study from ro where role = 'matched')
  union all select study, 'roles_overlap' from (select study, arm from ro group by all having count(*) > 1)
  union all select study, 'roles_incomplete' from (select study, arm from arms except select study, arm from ro)
  union all select study, 'reference_not_matched' from (select study, reference_arm from st except select study, arm from ro where role = 'matched')
  union all select study, 'label_missing' from (select study, dose from dz where arm = 'A' and dose <> 0 and (study, dose) not in (select (study, l) from lv))
  union all select study, 'metric_not_required' from (select study, m from st cross join (select unnest(['skin_tone_change', 'face_similarity']) m) except select study, metric from me)
  union all select study, 'gate_missing' from (select study, g from st cross join (select unnest(['min_detection_rate', 'min_pair_order_accuracy', 'min_median_pair_gap_ita', 'max_median_abs_ita_shift', 'max_p95_abs_ita_shift']) g) except select study, gate from ga)
  union all select study, 'gate_negative' from ga where v < 0
  union all select study, 'perturbations_empty' from st where study not in (select study from pe))
select study, rule, count(*) violations from r group by all"""


@plan("c1_design_report", C1_SQL)
def c1_design_report(spark, sf):
    return design.design_report(design_tables(spark, sf), C1_ARMS, "A")


@plan(
    "c2_readiness_report",
    """with s as (select c_custkey study, c_mktsegment status, c_nationkey % 4 n_targets, case c_custkey % 5 when 0 then 'Main' when 1 then null else md5(c_name) end revision,
      case when c_custkey % 3 = 0 then md5(c_name) else sha256(c_name) end rh, case when c_custkey % 7 = 0 then null else sha256(c_name) end mh from customer)
    select study, 'status_not_preregistered' rule from s where status <> 'BUILDING' or status = 'BUILDING' union all select study, 'no_matched_targets' from s where n_targets = 0
    union all select study, 'revision_mutable' from s where revision is null or revision = 'Main'
    union all select study, 'report_hash_not_frozen' from s where length(rh) <> 64 union all select study, 'manifest_hash_not_frozen' from s where mh is null""",
)
def c2_readiness_report(spark, sf):
    studies = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey as study", "c_mktsegment as status", "c_nationkey % 4 as n_targets",
        "case c_custkey % 5 when 0 then 'Main' when 1 then null else md5(c_name) end as revision",
        "if(c_custkey % 3 = 0, md5(c_name), sha2(c_name, 256)) as report_sha256",
        "if(c_custkey % 7 = 0, null, sha2(c_name, 256)) as manifest_sha256",
    )
    return design.readiness_report(studies)


@plan(
    "c3_freeze_report",
    """with s as (select o_orderkey k, o_custkey from orders),
    r as (select k study, 'status_not_planned' rule from s where k % 4 = 1 union all select k, 'pair_count_differs' from s where k % 6 = 0
    union all select k, 'generation_not_attested' from s where k % 9 = 0 union all select k, 'ledger_missing' from s where k % 5 = 0
    union all select k, 'ledger_hash_differs' from s where k % 5 = 0 or k % 8 = 0 union all select k, 'report_not_passed' from s where k % 10 = 0
    union all select k, 'report_study_differs' from s where k % 12 = 0 union all select k, 'report_metric_differs' from s where k % 15 = 0
    union all select k, 'report_split_wrong' from s where k % 14 = 0 union all select k, 'metadata_height_differs' from s where k % 16 = 0
    union all select k, 'metadata_model_id_differs' from s where k % 18 = 0)
    select study, rule from r""",
)
def c3_freeze_report(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("study", F.col("o_orderkey"))
    meta = "'rev' as model_revision, 25 as inference_steps, 7.5D as guidance_scale, 512 as width"
    designs = o.selectExpr(
        "study", "if(study % 4 = 1, 'pilot', 'planned') as status", "64 as train_pairs", "32 as held_out_pairs", "'ita' as metric",
        "'m' as model_id", "512 as height", *meta.split(", "),
    )
    manifests = o.selectExpr(
        "study", "if(study % 6 = 0, 95, 96) as n_pairs", "true as observed_in_campaign", "study % 9 <> 0 as observed_in_run",
        "concat('ledger/', study) as ledger_path", "if(study % 8 = 0, 'stale', md5(cast(study as string))) as ledger_sha256",
        "if(study % 18 = 0, null, 'm') as model_id", "if(study % 16 = 0, 256, 512) as height", *meta.split(", "),
    )
    reports = o.selectExpr(
        "study", "study % 10 <> 0 as passed", "if(study % 15 = 0, 'other', 'ita') as metric",
        "if(study % 14 = 0, 'train', 'held_out_direction_pairs') as split", "cast(if(study % 12 = 0, -1, study) as string) as study_id",
    )
    ledgers = o.where("study % 5 <> 0").selectExpr("concat('ledger/', study) as path", "md5(cast(study as string)) as sha256")
    return design.freeze_report(designs, manifests, reports, ledgers)
