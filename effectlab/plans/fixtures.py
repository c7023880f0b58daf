"""Trial, vector and pixel views over the driver tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from effectlab.functions.ordering import row_positions
from effectlab.schema import Outcome


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Images that a task makes pixels of.
IMAGES = 4_096


def dealt(images: DataFrame, key: str) -> DataFrame:
    """``images`` dealt to tasks by ``key`` before pixels are made of them: a small file is read
    by few tasks, whatever becomes of its rows. The tasks get more, not larger, with the input."""
    spark = images.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return images.repartition(max(least, images.count() // IMAGES), key)


REFERENCE_ARM = "N"
TARGET, TOLERANCE = 3.0, 0.25
METRICS = ("response", "cost", "tax", "quality")
OUTCOMES = (Outcome("quality", 1.0), Outcome("cost", -1.0), Outcome("tax", -1.0), Outcome("n", 1.0))


def trial_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier (unit), return flag (arm) and discount step (dose)."""
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")) / F.lit(100.0) / F.count(F.lit(1))
    cells = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("unit"),
            F.col("l_returnflag").alias("arm"),
            F.expr("cast(round(l_discount * 100) - 5 as int)").alias("dose"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr("sum(cast(l_quantity as int))").alias("qi"),
            # Sums of whole hundredths are exact in any order.
            hundredths("l_quantity").alias("q"),
            hundredths("l_tax").alias("tax"),
            hundredths("l_extendedprice").alias("cost"),
        )
    )
    # A unit and arm has one row per dose here, eleven at most.
    per_arm = W.Window.partitionBy("unit", "arm")
    based = cells.withColumn("q0", F.max(F.when(F.col("dose") == 0, F.col("q"))).over(per_arm))
    return based.where("q0 is not null").selectExpr(
        "unit", "arm", "dose", "n", "tax", "cost", "q / 50 as quality",
        "(n * 7 + qi) % 13 <> 0 as generated",
        "(n * 7 + qi) % 13 <> 0 and qi % 11 <> 0 as complete",
        "case when (n * 7 + qi) % 13 <> 0 and qi % 11 <> 0 then dose + (q - q0) / 10 end as response",
    )


TRIAL = """cells as (
  select l_suppkey unit, l_returnflag arm, cast(round(l_discount*100)-5 as int) dose, count(*) n,
         sum(cast(l_quantity as int))::BIGINT qi,
         cast(sum(cast(l_quantity as decimal(18,2))) as double)/count(*) q,
         cast(sum(cast(l_tax as decimal(18,2))) as double)/count(*) tax,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double)/count(*) cost
  from lineitem group by 1,2,3),
base as (select unit, arm, q q0 from cells where dose = 0),
trial as (
  select c.unit, c.arm, c.dose, c.n, c.tax, c.cost, c.q/50 as quality,
         (c.n*7 + c.qi) % 13 <> 0 as generated,
         (c.n*7 + c.qi) % 13 <> 0 and c.qi % 11 <> 0 as complete,
         case when (c.n*7 + c.qi) % 13 <> 0 and c.qi % 11 <> 0 then c.dose + (c.q - b.q0)/10 end as response
  from cells c join base b on c.unit = b.unit and c.arm = b.arm)"""

NEAREST = TRIAL + f""",
nearest as (
  select * exclude (rn) from (
    select t.*, sign(dose)::int direction, sign(dose) * response aligned_change, {TARGET}::double target_change,
           abs(sign(dose) * response - {TARGET}) match_distance,
           row_number() over (partition by unit, arm, sign(dose) order by abs(sign(dose) * response - {TARGET}), dose) rn
    from trial t where dose <> 0 and response is not null) where rn = 1),
matched as (select *, match_distance <= {TOLERANCE} match_complete from nearest)"""

PAIRS = NEAREST + """,
ref as (select * from matched where match_complete and arm = 'N'),
oth as (select * from matched where match_complete and arm <> 'N'),
wide as (select o.unit, o.direction, o.target_change, o.arm comparator,
                r.quality - o.quality quality, -(r.cost - o.cost) cost, -(r.tax - o.tax) tax, (r.n - o.n)::double n
         from oth o join ref r on o.unit = r.unit and o.direction = r.direction and o.target_change = r.target_change),
pairs as (select unit, direction, target_change, comparator, 'quality' outcome, quality advantage from wide
  union all select unit, direction, target_change, comparator, 'cost', cost from wide
  union all select unit, direction, target_change, comparator, 'tax', tax from wide
  union all select unit, direction, target_change, comparator, 'n', n from wide)"""


def trial_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows with repeated (unit, arm, day) keys; ``event_id`` is the ledger order."""
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id as unit", "event_type as arm", "cast(cast(ts as date) as string) as day", "value", "props"
    )


EVENTS = """ev as (select event_id, user_id unit, event_type arm, cast(cast(ts as date) as varchar) as "day", value, props
  from events)"""


def design(spark: SparkSession, sf: str) -> DataFrame:
    """The planned conditions: every unit and arm at the eleven doses."""
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("arm")
    ).distinct()
    return pairs.select("*", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("dose"))


DESIGN = """design as (select unit, arm, d.dose from (select distinct l_suppkey unit, l_returnflag arm from lineitem)
  cross join (select unnest(range(-5, 6))::int dose) d)"""


def vec_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with even labels paired by rank with vectors with odd labels."""
    vectors = table(spark, sf, "embeddings").withColumn("parity", F.col("label") % 2)
    ranked = row_positions(vectors, ["parity"], "vec_id", "i")
    even = ranked.where("parity = 0").select("i", F.col("embedding").alias("a"))
    odd = ranked.where("parity = 1").select("i", F.col("embedding").alias("b"))
    return even.join(odd, "i")


VEC_PAIRS = """vp as (select e.i, e.embedding a, o.embedding b
  from (select embedding, row_number() over (order by vec_id) - 1 i from embeddings where label % 2 = 0) e
  join (select embedding, row_number() over (order by vec_id) - 1 i from embeddings where label % 2 = 1) o on e.i = o.i)"""


def vec_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr("vec_id", "embedding", "label % 2 as y")


SIDE = 32


def pixels_a(spark: SparkSession, sf: str) -> DataFrame:
    """A 32 x 32 picture per part: bright neutral border, coloured inside."""
    axis = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = (
        dealt(table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), "p_size"), "image_id")
        .select("image_id", "p_size", F.explode(axis).alias("x"))
        .select("*", F.explode(axis).alias("y"))
    )
    border = "(x < 6 or x >= 26 or y < 6 or y >= 26)"
    return grid.selectExpr(
        "image_id", "x", "y",
        f"case when {border} then 225 + (x + y + p_size) % 10 else 110 + p_size + (x * 3 + y * 5) % 20 end as r",
        f"case when {border} then 225 + (x * 2 + y + p_size) % 10 else 80 + p_size + (x * 5 + y * 3) % 20 end as g",
        f"case when {border} then 225 + (x + y * 2 + p_size) % 10 else 60 + p_size + (x + y) % 20 end as b",
    )


PIXELS_A = """gx as (select unnest(range(32))::int x), gy as (select unnest(range(32))::int y),
pixels_a as (
  select p_partkey image_id, x, y,
       case when bg then 225+(x+y+p_size)%10   else 110+p_size+(x*3+y*5)%20 end r,
       case when bg then 225+(x*2+y+p_size)%10 else  80+p_size+(x*5+y*3)%20 end g,
       case when bg then 225+(x+y*2+p_size)%10 else  60+p_size+(x+y)%20     end b
  from (select p_partkey, p_size, x, y, (x<6 or x>=26 or y<6 or y>=26) bg from part cross join gx cross join gy))"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The face box of each picture; every seventh picture has none."""
    return table(spark, sf, "part").where("p_partkey % 7 <> 0").selectExpr(
        "p_partkey as image_id", "6 as x", "6 as y", "20 as w", "20 as h"
    )


BOXES = "boxes as (select p_partkey image_id, 6 bx, 6 by_, 20 w, 20 h from part where p_partkey % 7 <> 0)"


def bootstrap_sql(values: str, by: str, resamples: int = 10_000, seed: int = 2026, confidence: float = 0.95, name: str = "ci") -> str:
    """CTEs ending in ``ci(by..., n, ci_low, ci_high)`` over ``values(by..., unit, x)``: the
    draws of strata that fit into one shard."""
    from effectlab.functions.rng import below_sql, draw_sql

    tail = (1 - confidence) / 2
    return f"""{name}_v as materialized (select {by}, x, row_number() over (partition by {by} order by x) - 1 pos,
    count(*) over (partition by {by}) n from {values} where x is not null),
{name}_d as (select {by}, rep, {below_sql("n")} idx from
    ({draw_sql(f"(select {by}, n, pos, rep from {name}_v cross join (select unnest(range({resamples})) rep) where n >= 2)", seed, "rep", "pos")})),
{name}_m as (select {by}, d.rep, sum(v.x) / count(*) m
    from {name}_d d join (select {by}, pos idx, x from {name}_v) v using ({by}, idx) group by {by}, d.rep),
{name}_e as (select {by}, quantile_cont(m, {tail}) ci_low, quantile_cont(m, {1 - tail}) ci_high from {name}_m group by {by}),
{name} as (select s.*, ci_low, ci_high from (select {by}, count(*) n from {name}_v group by {by}) s left join {name}_e using ({by}))"""


def sign_flip_sql(values: str, by: str, resamples: int = 100_000, shard_rows: int = 4_096, seed: int = 2026, name: str = "sf") -> str:
    """CTEs ending in ``sf(by..., n, p_value)`` over ``values(by..., unit, x)``."""
    from effectlab.functions.rng import draw_sql

    words = f"(select unnest(range({-(-resamples // 64)})) word)"
    return f"""{name}_v as materialized (select {by}, x, row_number() over (partition by {by} order by x) - 1 pos, count(*) over (partition by {by}) n,
    abs(sum(x) over (partition by {by})) obs from {values} where x is not null),
{name}_h as ({draw_sql(f"(select * from {name}_v cross join {words} where n >= 2)", seed, "word", f"pos % {shard_rows}", f"pos // {shard_rows}")}),
{name}_s as (select {by}, word, t.bit, abs(sum(case when ((case when bit < 32 then lo else hi end) >> (bit % 32)) & 1 = 1 then -x else x end)) flip, any_value(obs) obs
    from {name}_h cross join (select unnest(range(64))::UBIGINT bit) t where word * 64 + t.bit < {resamples} group by {by}, word, t.bit),
{name}_p as (select {by}, (count(*) filter (where flip >= obs * (1 - 1e-12)) + 1) / {resamples + 1}.0 p_value
    from {name}_s group by {by}),
{name} as (select s.*, p_value from (select {by}, count(*) n from {name}_v group by {by}) s left join {name}_p using ({by}))"""


def holm_sql(source: str, p: str = "p_value", family: str = "", name: str = "p_holm") -> str:
    """A select over ``source`` with the Holm adjustment of ``p`` added."""
    part = f"partition by {family}" if family else ""
    return f"""(select * exclude (hk, hm), case when {p} is not null then
    max(least(1.0, (hm - hk + 1) * {p})) over ({part} order by {p}, hk rows unbounded preceding) end {name}
  from (select *, row_number() over ({part} order by {p} nulls last) hk, count({p}) over ({part}) hm from {source}))"""
