"""Plans: ledgers, manifests, sinks and streams over files that Spark writes from the
driver tables into the work folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlab.functions.keys import condition_path
from effectlab.operators.attest import latest_attestation
from effectlab.operators.describe import missingness
from effectlab.plans import fixtures as fx
from effectlab.plans.effects import MISSING
from effectlab.plans.registry import plan, q6, r6, rounded
from effectlab.session import work_folder
from effectlab.sources import images, ledger, manifest, sinks
from effectlab.streaming import ledger as live


def ledger_rows(spark, sf):
    """The trial in the columns of a ledger file."""
    return fx.trial_ledger(spark, sf).select(
        F.lit("study").alias("study_id"), F.col("unit").alias("seed"), F.col("arm").alias("method"),
        F.col("dose").cast("double").alias("alpha"), F.col("generated").alias("generation_complete"),
        F.col("complete").alias("evaluation_complete"), condition_path("unit", "arm", "dose").alias("image_path"),
        F.col("response").alias("skin_tone_change"), F.col("quality").alias("face_similarity"),
    )


LEDGER_SQL = f"""select unit seed, arm method, dose::DOUBLE alpha, generated generation_complete, complete evaluation_complete,
    {q6("response")} skin_tone_change, {q6("quality")} face_similarity from trial"""


@plan("s1_read_ledger", f"with {fx.TRIAL} {LEDGER_SQL}")
def s1_read_ledger(spark, sf):
    root = work_folder(spark, "s1")
    ledger_rows(spark, sf).write.json(f"{root}/run")
    rows = ledger.read_ledger(spark, root, pattern="*.json")
    return rounded(
        rows.select("seed", "method", "alpha", "generation_complete", "evaluation_complete", "skin_tone_change", "face_similarity"),
        "skin_tone_change", "face_similarity",
    )


@plan("s2_malformed_lines", f"with {fx.TRIAL} select arm, count(*) n, false is_tail_fragment from trial where n % 3 = 0 group by arm")
def s2_malformed_lines(spark, sf):
    root = work_folder(spark, "s2")
    rows = ledger_rows(spark, sf).withColumn("_cut", F.lit(False))
    n = fx.trial_ledger(spark, sf).select(F.col("unit").alias("seed"), F.col("arm").alias("method"), F.col("dose").cast("double").alias("alpha"), "n")
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "_cut"]))
    text = rows.join(n, ["seed", "method", "alpha"]).select(
        F.when(F.col("n") % 3 == 0, F.concat(F.lit('{"seed": '), F.col("method"))).otherwise(line).alias("value")
    )
    text.write.text(root)
    bad = ledger.malformed_lines(spark, root, "*.txt")
    return bad.groupBy(F.right(F.trim("value"), F.lit(1)).alias("arm"), "is_tail_fragment").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "s3_read_run_metadata",
    f"""with {fx.TRIAL} select unit seed, case when arm <> 'A' then arm else 'run method' end method, dose::DOUBLE alpha,
    complete evaluation_complete, {q6("quality")} face_similarity from trial""",
)
def s3_read_run_metadata(spark, sf):
    root = work_folder(spark, "s3")
    result = F.struct(
        F.when(F.col("arm") != "A", F.col("arm")).alias("method"), F.col("dose").cast("double").alias("alpha"),
        F.when(F.col("complete"), True).alias("evaluation_complete"), F.col("quality").alias("face_similarity"),
    )
    # One run per unit: a unit has as many results as the design has arms and doses.
    runs = fx.trial_ledger(spark, sf).groupBy("unit").agg(F.array_agg(result).alias("results"))
    runs = runs.select("unit", F.col("unit").alias("seed"), F.lit("run method").alias("method"), "results")
    runs.write.partitionBy("unit").json(root)
    out = manifest.read_run_metadata(spark, root, pattern="*.json")
    return out.select("seed", "method", "alpha", "evaluation_complete", r6("face_similarity"))


MISSING_SQL = f"""with {fx.TRIAL}, {MISSING} select *, {q6("(attempted - generated) / attempted")} generation_failure_rate,
    {q6("(attempted - evaluation_complete) / attempted")} metric_failure_rate from miss"""


@plan("s7_read_table", MISSING_SQL)
def s7_read_table(spark, sf):
    table = missingness(fx.trial_ledger(spark, sf))
    out = work_folder(spark, "s7")
    paths = sinks.write_analysis({"missingness": table}, table.agg(F.count(F.lit(1)).alias("rows")), out)
    back = sinks.read_table(spark, paths["missingness"], table.schema)
    return rounded(back, "generation_failure_rate", "metric_failure_rate")


@plan(
    "s8_pixels",
    f"""with {fx.PIXELS_A} select image_id, count(*) n, sum(r * (x + 1))::BIGINT r, sum(g * (y + 1))::BIGINT g, sum(b * (x + y))::BIGINT b
    from pixels_a group by image_id""",
)
def s8_pixels(spark, sf):
    files = images.images_of(fx.pixels_a(spark, sf), fx.SIDE, fx.SIDE)
    return images.pixels_of(files).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * (F.col("x") + 1)).alias("r"),
        F.sum(F.col("g") * (F.col("y") + 1)).alias("g"), F.sum(F.col("b") * (F.col("x") + F.col("y"))).alias("b"),
    )


@plan(
    "s9_write_analysis",
    f"""with {fx.TRIAL} select count(*) input_rows, count(response) with_response, null::DOUBLE undefined_share from trial""",
)
def s9_write_analysis(spark, sf):
    trial = fx.trial_ledger(spark, sf)
    audit = trial.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count("response").alias("with_response"), F.lit(float("nan")).alias("undefined_share")
    )
    paths = sinks.write_analysis({"missingness": missingness(trial)}, audit, work_folder(spark, "s9"), "parquet")
    return spark.read.schema(audit.schema).json(paths["audit"])


@plan(
    "s10_attest",
    "select doc_id path, sha256(case when doc_id % 2 = 0 then text else text || '!' end) sha256, '1.0' schema_version from documents",
)
def s10_attest(spark, sf):
    path = work_folder(spark, "s10")
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    sinks.attest(docs.withColumn("round", F.lit(1)), path)
    later = docs.where("path % 2 = 1").withColumn("content", F.concat("content", F.lit("!")))
    sinks.attest(later.withColumn("round", F.lit(2)), path)
    records = spark.read.schema("path bigint, round int, sha256 string, schema_version string, generated_at_utc string").json(path)
    return latest_attestation(records, ["round"]).select("path", "sha256", "schema_version")


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

EVENT_COLUMNS = ("event_id", "user_id as unit", "event_type as arm", "cast(cast(ts as date) as string) as dose", "value")


def event_stream(spark, sf):
    rows = live.stream_ledger(spark, sf, EVENT_SCHEMA, "parquet", "events.parquet")
    return rows.selectExpr(*EVENT_COLUMNS)


@plan(
    "t1_ingest_ledger",
    """with ev as (select *, min(least(event_id % 3, 2)) over (partition by user_id, event_type, cast(ts as date)) first_part, least(event_id % 3, 2) part from events)
    select user_id unit, event_type arm, cast(cast(ts as date) as varchar) dose, min(event_id) event_id, arg_min(value, event_id) value
    from ev where part = first_part group by all""",
)
def t1_ingest_ledger(spark, sf):
    """Three deliveries of the events, one after the other, with a restart before each: a key
    keeps the least event of the delivery that brought it first."""
    out = work_folder(spark, "t1")
    events = fx.table(spark, sf, "events")
    for part in range(3):
        events.where(f"least(event_id % 3, 2) = {part}").write.parquet(f"{out}/in/delivery-{part}")
        rows = live.stream_ledger(spark, f"{out}/in", EVENT_SCHEMA, "parquet", "*.parquet").selectExpr(*EVENT_COLUMNS)
        live.ingest(rows, f"{out}/table", f"{out}/checkpoint", ["unit", "arm", "dose"], ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{out}/table").select("unit", "arm", "dose", "event_id", "value")


@plan(
    "t2_live_missingness",
    f"""with {fx.EVENTS}, m as (select arm, "day" dose, count(*) attempted, count(*) filter (where value > 5) generated, count(*) filter (where value > 20) evaluation_complete from ev group by all)
    select *, {q6("(attempted - generated) / attempted")} generation_failure_rate, {q6("(attempted - evaluation_complete) / attempted")} metric_failure_rate from m""",
)
def t2_live_missingness(spark, sf):
    out = work_folder(spark, "t2")
    rows = event_stream(spark, sf).selectExpr("*", "value > 5 as generated", "value > 20 as complete")
    live.live_missingness(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return rounded(live.latest_version(spark, f"{out}/table"), "generation_failure_rate", "metric_failure_rate")


@plan(
    "t3_live_remaining",
    f"""with {fx.EVENTS}, u as (select distinct unit from ev), a as (select distinct arm from ev), d as (select distinct "day" dose from ev)
    select unit, arm, dose from (select unit, arm, dose from u cross join a cross join d) p where (unit, arm, dose) not in (select (unit, arm, "day") from ev)""",
)
def t3_live_remaining(spark, sf):
    out = work_folder(spark, "t3")
    events = fx.trial_events(spark, sf)
    # Event types and days are short lists; the plan is every unit at each of them.
    levels = events.agg(F.struct(F.collect_set("arm").alias("arms"), F.collect_set("day").alias("days")))
    units = events.select("unit").distinct().withColumn("_levels", levels.scalar())
    planned = units.select("unit", "_levels", F.explode("_levels.arms").alias("arm")).select("unit", "arm", F.explode("_levels.days").alias("dose"))
    rows = event_stream(spark, sf)
    live.live_remaining(rows, planned, f"{out}/remaining", f"{out}/checkpoint", ["unit", "arm", "dose"]).awaitTermination()
    return live.still_open(spark, f"{out}/remaining", ["unit", "arm", "dose"])
