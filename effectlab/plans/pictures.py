"""Plans: colour, masks, similarity, geometry and scores over the pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlab.functions import geometry as geo
from effectlab.functions import scoring
from effectlab.functions.colour import SRGB_TO_XYZ, WHITE, ita, with_lab
from effectlab.functions.keys import hashed
from effectlab.operators import images, validation
from effectlab.plans import fixtures as fx
from effectlab.plans.registry import plan, q6, r6, rounded
from effectlab.session import written

SIDE = fx.SIDE
MIN_PIXELS = 16


def boxes(spark, sf):
    return fx.boxes(spark, sf).selectExpr("image_id", "x as box_x", "y as box_y", "w as box_w", "h as box_h")


def pixels_b(spark, sf):
    """The edited picture: the inside of the frame at nine tenths."""
    inside = "(x >= 6 and x < 26 and y >= 6 and y < 26)"
    # One pass over the pixels: each under both gains, of which one holds where it lies.
    both = images.apply_gain(fx.pixels_a(spark, sf), {"edit": (0.9, 0.9, 0.9), "kept": (1.0, 1.0, 1.0)})
    return both.where(f"(perturbation = 'edit') = {inside}").drop("perturbation")


PIXELS = fx.PIXELS_A + """, pixels_b as (select image_id, x, y, case when ins then floor(r * 0.9::DOUBLE)::int else r end r,
  case when ins then floor(g * 0.9::DOUBLE)::int else g end g, case when ins then floor(b * 0.9::DOUBLE)::int else b end b
  from (select *, x >= 6 and x < 26 and y >= 6 and y < 26 ins from pixels_a)), """ + fx.BOXES


def lab_sql(source: str, out: str, keep: str = "image_id") -> str:
    def linear(c: str) -> str:
        s = f"least(greatest({c} / 255.0::DOUBLE, 0), 1)"
        return f"case when {s} <= 0.04045 then {s} / 12.92::DOUBLE else pow(({s} + 0.055) / 1.055::DOUBLE, 2.4) end"

    def axis(row, white) -> str:
        t = f"(({row[0]} * lr + {row[1]} * lg + {row[2]} * lb) / {white}::DOUBLE)"
        return f"case when {t} > {(6 / 29) ** 3} then cbrt({t}) else {t} / {3 * (6 / 29) ** 2} + {4 / 29} end"

    x, y, z = (axis(r, w) for r, w in zip(SRGB_TO_XYZ, WHITE))
    return f"""{out}_l as (select *, {linear("r")} lr, {linear("g")} lg, {linear("b")} lb from {source}),
{out}_x as (select *, {x} fx, {y} fy, {z} fz from {out}_l),
{out} as (select * exclude (lr, lg, lb, fx, fy, fz), 116 * fy - 16 lab_l, 500 * (fx - fy) lab_a, 200 * (fy - fz) lab_b from {out}_x)"""


CHEEK = """(pow((x - (bx + 0.31 * w)) / greatest(1, 0.115 * w), 2) + pow((y - (by_ + 0.6 * h)) / greatest(1, 0.09 * h), 2) <= 1
  or pow((x - (bx + 0.69 * w)) / greatest(1, 0.115 * w), 2) + pow((y - (by_ + 0.6 * h)) / greatest(1, 0.09 * h), 2) <= 1)"""


def measure_sql(px: str, out: str, key: str = "image_id") -> str:
    """CTEs ending in ``out(key..., pixel_count, normalized, lab_l, lab_a, lab_b, ita)``."""
    gains = ", ".join(f"least(greatest(235.0 / greatest(median({c}), 1), 0.5), 2.0) k{c}, median({c}) w{c}" for c in "rgb")
    floors = ", ".join(f"case when k{c} is not null then floor(least(greatest({c} * k{c}, 0), 255))::int else {c} end {c}" for c in "rgb")
    return f"""{out}_j as (select p.*, b.bx, b.by_, b.w, b.h from {px} p join boxes b on p.image_id = b.image_id),
{out}_g as (select {key}, count(*) white_pixels, {gains} from {out}_j
  where not (x >= bx - floor(0.15 * w) and x < bx + w + floor(0.15 * w) and y >= by_ - floor(0.15 * h) and y < by_ + h + floor(0.15 * h))
    and least(r, g, b) >= 160 and greatest(r, g, b) - least(r, g, b) <= 35 group by {key} having count(*) >= 256),
{out}_n as (select {key}, {floors}, kr is not null normalized from {out}_j left join {out}_g using ({key}) where {CHEEK}),
{lab_sql(f"{out}_n", f"{out}_b")},
{out}_m as (select {key}, count(*) pixel_count, bool_or(normalized) normalized, median(lab_l) lab_l, median(lab_a) lab_a, median(lab_b) lab_b
  from {out}_b where lab_l > 2 and lab_l < 98 group by {key} having count(*) >= {MIN_PIXELS}),
{out} as (select *, degrees(atan2(lab_l - 50, lab_b)) ita from {out}_m)"""


@plan(
    "x11_srgb_to_lab",
    f"""with {fx.PIXELS_A}, {lab_sql("pixels_a", "lab")}
    select image_id, {q6("avg(lab_l)")} lab_l, {q6("avg(lab_a)")} lab_a, {q6("avg(lab_b)")} lab_b from lab group by image_id""",
)
def x11_srgb_to_lab(spark, sf):
    out = with_lab(fx.pixels_a(spark, sf)).groupBy("image_id").agg(*[F.avg(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")])
    return rounded(out, "lab_l", "lab_a", "lab_b")


@plan("x12_ita", f"select l_orderkey, l_linenumber, {q6('degrees(atan2(l_quantity + 20 - 50, l_tax * 100 - 4))')} ita from lineitem")
def x12_ita(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(ita(F.col("l_quantity") + 20, F.col("l_tax") * 100 - 4), "ita")
    )


GAINS = {"darker": (0.9, 0.9, 0.9), "warm": (1.05, 1.0, 0.95)}


@plan(
    "x14_apply_gain",
    f"""with {fx.PIXELS_A}, gn(perturbation, a, b_, c) as (values ('darker', 0.9::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE), ('warm', 1.05::DOUBLE, 1.0::DOUBLE, 0.95::DOUBLE))
    select image_id, perturbation, sum(floor(least(greatest(r * a, 0), 255)))::BIGINT r, sum(floor(least(greatest(g * b_, 0), 255)))::BIGINT g,
      sum(floor(least(greatest(b * c, 0), 255)))::BIGINT b from pixels_a cross join gn group by all""",
)
def x14_apply_gain(spark, sf):
    out = images.apply_gain(fx.pixels_a(spark, sf), GAINS)
    return out.groupBy("image_id", "perturbation").agg(*[F.sum(c).alias(c) for c in "rgb"])


ODD_BOXES = "p_partkey as image_id", "p_size - 12 as box_x", "cast(p_partkey % 40 as int) - 6 as box_y", "p_size % 30 - 2 as box_w", "cast(p_partkey % 25 as int) - 2 as box_h"
ODD_SQL = "ob as (select p_partkey image_id, p_size - 12 x, (p_partkey % 40)::int - 6 y, p_size % 30 - 2 w, (p_partkey % 25)::int - 2 h from part)"


@plan(
    "x15_clip_box",
    f"""with {ODD_SQL}, c as (select image_id, w, h, greatest(x, 0) x0, greatest(y, 0) y0, least(x + w, 32) x1, least(y + h, 32) y1 from ob),
    p as (select *, case when w <= 0 or h <= 0 then 'not_positive' when x1 <= x0 or y1 <= y0 then 'outside_image' end box_problem from c)
    select image_id, case when box_problem is null then x0 end box_x, case when box_problem is null then y0 end box_y,
      case when box_problem is null then x1 - x0 end box_w, case when box_problem is null then y1 - y0 end box_h, box_problem from p""",
)
def x15_clip_box(spark, sf):
    return geo.clip_box(fx.table(spark, sf, "part").selectExpr(*ODD_BOXES), SIDE, SIDE)


def grown_sql(ratio: float, source: str = "ob") -> str:
    return f"""gs as (select *, floor(w * {ratio})::int nw, floor(h * {ratio})::int nh from {source} where w > 0 and h > 0),
    gc as (select *, greatest(x + w // 2 - nw // 2, 0) grown_x0, greatest(y + h // 2 - nh // 2, 0) grown_y0 from gs),
    grown as (select image_id, grown_x0, grown_y0, least(grown_x0 + nw, 32) grown_x1, least(grown_y0 + nh, 32) grown_y1 from gc)"""


def odd_grown(spark, sf, ratio):
    table = fx.table(spark, sf, "part").selectExpr(*ODD_BOXES).where("box_w > 0 and box_h > 0")
    return geo.expand_box(table, ratio, SIDE, SIDE).select("image_id", "grown_x0", "grown_y0", "grown_x1", "grown_y1")


@plan("x16_expand_box_mask", f"with {ODD_SQL}, {grown_sql(1.5)} select * from grown")
def x16_expand_box_mask(spark, sf):
    return odd_grown(spark, sf, 1.5)


@plan("x16_expand_box_crop", f"with {ODD_SQL}, {grown_sql(1.3)} select * from grown")
def x16_expand_box_crop(spark, sf):
    return odd_grown(spark, sf, 1.3)


@plan(
    "x17_ellipse_mask",
    f"""with {fx.PIXELS_A}, {ODD_SQL}, {grown_sql(1.5)},
    e as (select *, (grown_x0 + grown_x1) // 2 cx, (grown_y0 + grown_y1) // 2 cy, (grown_x1 - grown_x0) // 2 rx, (grown_y1 - grown_y0) // 2 ry from grown)
    select image_id, count(*) n, sum(x)::BIGINT sx, sum(y)::BIGINT sy from pixels_a join e using (image_id)
    where rx > 0 and ry > 0 and pow((x - cx) / rx::DOUBLE, 2) + pow((y - cy) / ry::DOUBLE, 2) <= 1 group by image_id""",
)
def x17_ellipse_mask(spark, sf):
    px = fx.pixels_a(spark, sf).select("image_id", "x", "y").join(hashed(odd_grown(spark, sf, 1.5)), "image_id").where(geo.in_ellipse())
    return px.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@plan(
    "x18_cheek_mask",
    f"""with {fx.PIXELS_A}, {fx.BOXES} select image_id, count(*) n, sum(x)::BIGINT sx, sum(y)::BIGINT sy from pixels_a join boxes using (image_id)
    where {CHEEK} group by image_id""",
)
def x18_cheek_mask(spark, sf):
    px = fx.pixels_a(spark, sf).select("image_id", "x", "y").join(hashed(boxes(spark, sf)), "image_id").where(geo.in_cheeks())
    return px.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@plan(
    "d1_white_normalize",
    f"""with {PIXELS}, {measure_sql("pixels_a", "m")}
    select image_id, m_g.white_pixels, wr white_r, wg white_g, wb white_b, {q6("kr")} gain_r, {q6("kg")} gain_g, {q6("kb")} gain_b,
      sum(case when kr is not null then floor(least(r * kr, 255))::int else r end)::BIGINT sum_r, kr is not null normalized
    from pixels_a left join m_g using (image_id) group by all""",
)
def d1_white_normalize(spark, sf):
    px = fx.pixels_a(spark, sf)
    gains = written(images.white_gains(px, boxes(spark, sf)), "gains")
    sums = images.white_normalize(px, gains).groupBy("image_id", "normalized").agg(F.sum("r").alias("sum_r"))
    return rounded(sums.join(hashed(gains), "image_id", "left"), "gain_r", "gain_g", "gain_b")


@plan(
    "d2_measure_colour",
    f"""with {PIXELS}, {measure_sql("pixels_a", "m")} select image_id, pixel_count, normalized, {q6("lab_l")} lab_l, {q6("lab_a")} lab_a,
    {q6("lab_b")} lab_b, {q6("ita")} ita from m""",
)
def d2_measure_colour(spark, sf):
    out = images.measure_colour(fx.pixels_a(spark, sf), boxes(spark, sf), SIDE, SIDE, MIN_PIXELS)
    return rounded(out, "lab_l", "lab_a", "lab_b", "ita")


@plan(
    "x13_colour_change",
    f"""with {PIXELS}, {measure_sql("pixels_a", "m")}, {measure_sql("pixels_b", "n")},
    e as (select * from n where image_id % 11 <> 0)
    select p_partkey image_id, m.ita is not null and e.ita is not null skin_tone_complete,
      case when m.ita is null then 'original_face_or_skin_region_missing' when e.ita is null then 'edited_face_or_skin_region_missing' end skin_tone_failure,
      {q6("m.ita")} original_ita, {q6("e.ita")} edited_ita, {q6("m.ita - e.ita")} skin_tone_change, {q6("e.lab_l - m.lab_l")} lightness_change,
      coalesce(m.pixel_count, 0)::int original_skin_pixels, coalesce(e.pixel_count, 0)::int edited_skin_pixels,
      coalesce(m.normalized, false) original_white_normalized, coalesce(e.normalized, false) edited_white_normalized
    from part left join m on p_partkey = m.image_id left join e on p_partkey = e.image_id""",
)
def x13_colour_change(spark, sf):
    box = boxes(spark, sf)
    before = images.measure_colour(fx.pixels_a(spark, sf), box, SIDE, SIDE, MIN_PIXELS)
    after = images.measure_colour(pixels_b(spark, sf), box.where("image_id % 11 <> 0"), SIDE, SIDE, MIN_PIXELS)
    ids = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"))
    return rounded(
        images.colour_change(ids, before, after), "original_ita", "edited_ita", "skin_tone_change", "lightness_change"
    )


LUMA = "((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)"
GREY = f"""ga as (select image_id, x, y, {LUMA} a from pixels_a), gb as (select image_id, x, y, {LUMA} b from pixels_b),
gp as (select ga.*, gb.b from ga join gb using (image_id, x, y))"""


def ssim_sql(source: str) -> str:
    wx = "over (partition by image_id, y order by x rows between 3 preceding and 3 following)"
    wy = "over (partition by image_id, x order by y rows between 3 preceding and 3 following)"
    cols = {"a": "a", "b": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}
    c1, c2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2
    return f"""s1 as (select image_id, x, y, count(*) {wx} k, {", ".join(f"sum({e}) {wx} {n}" for n, e in cols.items())} from {source}),
s2 as (select image_id, x, y, sum(k) {wy} k, {", ".join(f"sum({n}) {wy} {n}" for n in cols)} from s1),
s3 as (select image_id, a / 49::DOUBLE ua, b / 49::DOUBLE ub, aa / 49::DOUBLE uaa, bb / 49::DOUBLE ubb, ab / 49::DOUBLE uab from s2 where k = 49),
ss as (select image_id, avg(((2 * ua * ub + {c1}) * (2 * (49 / 48::DOUBLE * (uab - ua * ub)) + {c2}))
  / ((ua * ua + ub * ub + {c1}) * (49 / 48::DOUBLE * (uaa - ua * ua) + 49 / 48::DOUBLE * (ubb - ub * ub) + {c2}))) v from s3 group by image_id)"""


@plan("d3_ssim", f"with {PIXELS}, {GREY}, {ssim_sql('gp')} select image_id, {q6('v')} ssim from ss")
def d3_ssim(spark, sf):
    return rounded(images.ssim(fx.pixels_a(spark, sf), pixels_b(spark, sf)), "ssim")


@plan(
    "d4_background_ssim",
    f"""with {PIXELS}, {GREY}, ob as (select image_id, case when image_id % 5 = 0 then 0 else bx end x, case when image_id % 5 = 0 then 0 else by_ end y,
      case when image_id % 5 = 0 then 32 else w end w, case when image_id % 5 = 0 then 32 else h - 8 end h from boxes), {grown_sql(1.5)},
    hid as (select gp.image_id, x, y, case when hit then 0 else a end a, case when hit then 0 else b end b, hit from (
      select gp.*, x >= grown_x0 and x < grown_x1 and y >= grown_y0 and y < grown_y1 hit from gp join grown using (image_id)) gp), {ssim_sql("hid")},
    al as (select image_id, bool_and(hit) covered from hid group by image_id)
    select p_partkey image_id, case when covered then 0.0 else {q6("v")} end background_ssim
    from part left join al on p_partkey = al.image_id left join ss on p_partkey = ss.image_id""",
)
def d4_background_ssim(spark, sf):
    big = F.col("image_id") % 5 == 0
    mixed = boxes(spark, sf).withColumns({
        "box_x": F.when(big, 0).otherwise(F.col("box_x")), "box_y": F.when(big, 0).otherwise(F.col("box_y")),
        "box_w": F.when(big, SIDE).otherwise(F.col("box_w")), "box_h": F.when(big, SIDE).otherwise(F.col("box_h") - 8),
    })
    return rounded(images.background_ssim(fx.pixels_a(spark, sf), pixels_b(spark, sf), mixed, SIDE, SIDE), "background_ssim")


@plan(
    "w7_uniform_window",
    f"""with {fx.PIXELS_A}, s1 as (select image_id, x, y, count(*) over w k, sum(r) over w r from pixels_a
      window w as (partition by image_id, y order by x rows between 3 preceding and 3 following)),
    s2 as (select image_id, x, y, sum(k) over w k, sum(r) over w r from s1 window w as (partition by image_id, x order by y rows between 3 preceding and 3 following))
    select image_id, sum(k)::BIGINT window_n, max(r)::BIGINT max_r, min(r)::BIGINT min_r from s2 group by image_id""",
)
def w7_uniform_window(spark, sf):
    out = images.uniform_window(fx.pixels_a(spark, sf), ["r"])
    return out.groupBy("image_id").agg(F.sum("window_n").alias("window_n"), F.max("r").alias("max_r"), F.min("r").alias("min_r"))


CENTRE = "x >= 8 and x < 24 and y >= 8 and y < 24"


@plan(
    "d5_center_mean",
    f"with {fx.PIXELS_A} select image_id, {q6('avg((r + g + b) / 3.0::DOUBLE)')} brightness from pixels_a where {CENTRE} group by image_id",
)
def d5_center_mean(spark, sf):
    return rounded(images.center_mean(fx.pixels_a(spark, sf), SIDE, SIDE), "brightness")


def picture_groups(spark, sf):
    return fx.table(spark, sf, "part").selectExpr("p_partkey as image_id", "if(p_size > 30, 'light', 'dark') as `group`")


GROUPED = fx.PIXELS_A + f""", im as (select image_id, avg(r) r, avg(g) g, avg(b) b, avg((r + g + b) / 3.0::DOUBLE) v from pixels_a where {CENTRE} group by image_id),
gr as (select im.*, case when p_size > 30 then 'light' else 'dark' end as "group" from im join part on p_partkey = image_id)"""


@plan(
    "d6_channel_means",
    f"""with {GROUPED} select "group", count(*) n_images, {q6("avg(r)")} mean_r, {q6("avg(g)")} mean_g, {q6("avg(b)")} mean_b from gr group by "group" """,
)
def d6_channel_means(spark, sf):
    out = images.channel_means(fx.pixels_a(spark, sf), picture_groups(spark, sf), SIDE, SIDE)
    return rounded(out, "mean_r", "mean_g", "mean_b")


@plan(
    "a22_contrast_check",
    f"""with {GROUPED}, m as (select avg(v) filter (where "group" = 'light') l, avg(v) filter (where "group" = 'dark') d from gr)
    select {q6("l")} light_brightness, {q6("d")} dark_brightness, {q6("abs(l - d)")} gap,
      case when abs(l - d) < 20 then 'low' when abs(l - d) < 40 then 'moderate' else 'good' end band from m""",
)
def a22_contrast_check(spark, sf):
    out = images.contrast_check(fx.pixels_a(spark, sf), picture_groups(spark, sf), SIDE, SIDE)
    return rounded(out, "light_brightness", "dark_brightness", "gap")


def measured(spark, sf):
    """Pictures 2k (light) and 2k + 1 (dark) form pair k."""
    out = images.measure_colour(fx.pixels_a(spark, sf), boxes(spark, sf), SIDE, SIDE, MIN_PIXELS)
    return out.selectExpr("image_id div 2 as pair_id", "if(image_id % 2 = 0, 'light', 'dark') as `group`", "ita")


def perturbed(spark, sf):
    """The same pictures under each gain, measured inside the box found before it."""
    px = images.apply_gain(fx.pixels_a(spark, sf), GAINS)
    out = images.measure_colour(px, boxes(spark, sf), SIDE, SIDE, MIN_PIXELS, by=("image_id", "perturbation"))
    return out.selectExpr("image_id div 2 as pair_id", "if(image_id % 2 = 0, 'light', 'dark') as `group`", "perturbation", "ita")


PAIRED = f"""{PIXELS}, {measure_sql("pixels_a", "m")},
ms as (select image_id // 2 pair_id, case when image_id % 2 = 0 then 'light' else 'dark' end grp, ita from m),
pm as (select pair_id, max(ita) filter (where grp = 'light') l, max(ita) filter (where grp = 'dark') d from ms group by pair_id),
pr as (select pid pair_id, l, d, l - d gap from (select distinct p_partkey // 2 pid from part) left join pm on pid = pair_id)"""


@plan(
    "a9_pair_measures",
    f"""with {PAIRED} select pair_id, l is not null light_detected, d is not null dark_detected, gap is not null pair_complete, {q6("l")} light_ita,
    {q6("d")} dark_ita, {q6("gap")} ita_gap, coalesce(gap > 0, false) ordered_light_above_dark from pr""",
)
def a9_pair_measures(spark, sf):
    return rounded(pair_table(spark, sf), "light_ita", "dark_ita", "ita_gap")


def pair_table(spark, sf):
    pairs = fx.table(spark, sf, "part").selectExpr("p_partkey div 2 as pair_id")
    return validation.pair_measures(pairs, measured(spark, sf))


SHIFTED = PAIRED + """, gn(perturbation, a, b_, c) as (values ('darker', 0.9::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE), ('warm', 1.05::DOUBLE, 1.0::DOUBLE, 0.95::DOUBLE)),
pg as (select image_id, x, y, perturbation, floor(least(greatest(r * gn.a, 0), 255))::int r, floor(least(greatest(g * gn.b_, 0), 255))::int g,
  floor(least(greatest(pixels_a.b * gn.c, 0), 255))::int b from pixels_a cross join gn), """ + measure_sql("pg", "q", "image_id, perturbation") + """,
sh as (select m.image_id // 2 pair_id, case when m.image_id % 2 = 0 then 'light' else 'dark' end grp, gn.perturbation, m.ita base, q.ita moved, abs(q.ita - m.ita) shift
  from m cross join gn left join q on q.image_id = m.image_id and q.perturbation = gn.perturbation)"""


def shift_table(spark, sf):
    base = measured(spark, sf)
    planned = base.select("pair_id", "group", F.explode(F.array(*[F.lit(n) for n in GAINS])).alias("perturbation"))
    return validation.perturb_shifts(base, perturbed(spark, sf), planned)


@plan(
    "a9_perturb_shifts",
    f"""with {SHIFTED} select pair_id, grp as "group", perturbation, {q6("base")} baseline_ita, {q6("moved")} perturbed_ita, {q6("shift")} abs_ita_shift from sh""",
)
def a9_perturb_shifts(spark, sf):
    return rounded(shift_table(spark, sf), "baseline_ita", "perturbed_ita", "abs_ita_shift")


GATES = {
    "min_detection_rate": 0.95, "min_pair_order_accuracy": 0.90, "min_median_pair_gap_ita": 8.0,
    "max_median_abs_ita_shift": 2.0, "max_p95_abs_ita_shift": 5.0,
}


@plan(
    "a8_validation_summary",
    f"""with {SHIFTED}, f as (select count(*) pair_count, count(gap) complete_pair_count, (count(l) + count(d)) / (2.0 * count(*)) detection_rate,
      avg(case when gap is not null then (gap > 0)::int end) acc, median(gap) gap from pr), s as (select median(shift) med, quantile_cont(shift, 0.95) p95 from sh)
    select pair_count, complete_pair_count, {q6("detection_rate")} detection_rate, {q6("acc")} pair_order_accuracy, {q6("gap")} median_pair_gap_ita,
      {q6("med")} median_abs_ita_shift, {q6("p95")} p95_abs_ita_shift, detection_rate >= 0.95 detection_rate_ok, acc >= 0.9 pair_order_accuracy_ok,
      gap >= 8 median_pair_gap_ita_ok, med <= 2 median_abs_ita_shift_ok, p95 <= 5 p95_abs_ita_shift_ok,
      detection_rate >= 0.95 and acc >= 0.9 and gap >= 8 and med <= 2 and p95 <= 5 passed from f, s""",
)
def a8_validation_summary(spark, sf):
    out = validation.validation_summary(pair_table(spark, sf), shift_table(spark, sf), GATES)
    return rounded(
        out, "detection_rate", "pair_order_accuracy", "median_pair_gap_ita", "median_abs_ita_shift", "p95_abs_ita_shift"
    )


CANON = (10.0, 10.0, 30.0, 10.0, 20.0, 20.0, 14.0, 30.0, 26.0, 30.0)


def landmarks(spark, sf):
    """Five points per vector, moved a little; every thirteenth vector is degenerate."""
    moved = [F.lit(c) + F.get("embedding", F.lit(i)).cast("double") * 10 for i, c in enumerate(CANON)]
    points = F.array(*[F.array(moved[2 * i], moved[2 * i + 1]) for i in range(5)])
    flat = F.array(*[F.array(F.lit(5.0), F.lit(5.0)) for _ in range(5)])
    return fx.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 13 == 0, flat).otherwise(points).alias("points"))


PTS = "lm as (select vec_id, " + ", ".join(
    f"case when vec_id % 13 = 0 then 5.0 else {c} + embedding[{i + 1}]::DOUBLE * 10 end c{i}" for i, c in enumerate(CANON)
) + """ from embeddings),
ps as (select *, sqrt(pow(c2 - c0, 2) + pow(c3 - c1, 2)) ed, (c0 + c2) / 2 mx, (c1 + c3) / 2 my, (c7 + c9) / 2 - (c1 + c3) / 2 dr from lm),
po as (select *, case when ed >= 1e-6 and abs(dr) >= 1e-6 then degrees(atan2(c4 - mx, ed)) end yaw,
  case when ed >= 1e-6 and abs(dr) >= 1e-6 then degrees(atan((c5 - my) / dr - 0.5)) end pitch,
  case when ed >= 1e-6 and abs(dr) >= 1e-6 then degrees(atan2(c3 - c1, c2 - c0)) end roll from ps)"""


@plan("x19_pose_from_landmarks", f"with {PTS} select vec_id, {q6('yaw')} yaw, {q6('pitch')} pitch, {q6('roll')} roll from po")
def x19_pose_from_landmarks(spark, sf):
    out = landmarks(spark, sf).select("vec_id", geo.pose_from_landmarks("points").alias("p"))
    return out.select("vec_id", r6("p.yaw", "yaw"), r6("p.pitch", "pitch"), r6("p.roll", "roll"))


def neighbours(spark, sf):
    a = landmarks(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("points").alias("other"))
    return a.join(b, "vec_id")


@plan(
    "x20_pose_difference",
    f"""with {PTS} select a.vec_id, {q6("abs(a.yaw - b.yaw)")} yaw_diff, {q6("abs(a.pitch - b.pitch)")} pitch_diff, {q6("abs(a.roll - b.roll)")} roll_diff,
    {q6("sqrt(pow(a.yaw - b.yaw, 2) + pow(a.pitch - b.pitch, 2) + pow(a.roll - b.roll, 2))")} total_pose_diff from po a join po b on a.vec_id = b.vec_id - 1""",
)
def x20_pose_difference(spark, sf):
    out = neighbours(spark, sf).select("vec_id", geo.pose_from_landmarks("points").alias("p"), geo.pose_from_landmarks("other").alias("q"))
    out = out.select("vec_id", geo.pose_difference("p", "q").alias("d")).select("vec_id", "d.*")
    return rounded(out, "yaw_diff", "pitch_diff", "roll_diff", "total_pose_diff")


@plan(
    "x21_landmark_rmse",
    f"""with {PTS} select a.vec_id, {q6("sqrt((" + " + ".join(f"pow(a.c{i} - b.c{i}, 2)" for i in range(10)) + ") / 10)")} landmark_rmse
    from po a join po b on a.vec_id = b.vec_id - 1""",
)
def x21_landmark_rmse(spark, sf):
    return neighbours(spark, sf).select("vec_id", r6(geo.landmark_rmse("points", "other"), "landmark_rmse"))


SCORED = (
    "l_orderkey", "l_linenumber", "if(l_linenumber % 5 = 0, null, l_quantity / 50) as face_similarity",
    "if(l_partkey % 6 = 0, null, l_extendedprice / 12000) as landmark_rmse", "l_discount * 4 as lpips",
    "if(l_suppkey % 9 = 0, null, 1 - l_tax * 4) as background_ssim", "if(l_partkey % 4 = 0, null, l_quantity / 6) as total_pose_diff",
)
SCORES = """sc as (select l_orderkey, l_linenumber, case when l_linenumber % 5 <> 0 then l_quantity / 50 end fs, case when l_partkey % 6 <> 0 then l_extendedprice / 12000 end rm,
  l_discount * 4 lp, case when l_suppkey % 9 <> 0 then 1 - l_tax * 4 end bg, case when l_partkey % 4 <> 0 then l_quantity / 6 end po from lineitem),
ck as (select *, coalesce((fs >= 0.85)::int, 0) + coalesce((rm <= 5)::int, 0) + (lp <= 0.3)::int + coalesce((bg >= 0.75)::int, 0) + coalesce((po <= 5)::int, 0) np,
  (fs is not null)::int + (rm is not null)::int + 1 + (bg is not null)::int + (po is not null)::int nt from sc)"""


def scored(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(*SCORED)


@plan(
    "x22_gate",
    f"""with {SCORES} select l_orderkey, l_linenumber, np pass_count, nt total_count, concat_ws(',', case when fs is null then 'face_similarity' end,
      case when bg is null then 'background_ssim' end) missing, fs is not null and bg is not null and np >= 0.8 * nt is_disentangled from ck""",
)
def x22_gate(spark, sf):
    out = scoring.gate(scored(spark, sf))
    return out.select(
        "l_orderkey", "l_linenumber", "pass_count", "total_count", F.array_join("missing_required_metrics", ",").alias("missing"), "is_disentangled"
    )


@plan(
    "x23_overall_score",
    f"""with {SCORES} select l_orderkey, l_linenumber, {q6('''1e-9 + (coalesce(fs * 0.3, 0) + coalesce(case when rm is not null then greatest(0, 1 - rm / 5) * 0.2 end, 0) + greatest(0, 1 - lp / 0.3::DOUBLE) * 0.2
      + coalesce(bg * 0.2, 0) + coalesce(case when po is not null then greatest(0, 1 - po / 5) * 0.1 end, 0)) / (0.2::DOUBLE + case when fs is not null then 0.3::DOUBLE else 0 end
      + case when rm is not null then 0.2::DOUBLE else 0 end + case when bg is not null then 0.2::DOUBLE else 0 end + case when po is not null then 0.1::DOUBLE else 0 end)''')} overall_score from sc""",
)
def x23_overall_score(spark, sf):
    # Many scores end in an exact half at the seventh digit; a nudge settles their rounding.
    score = r6(F.col("overall_score") + 1e-9, "overall_score")
    return scoring.overall_score(scored(spark, sf)).select("l_orderkey", "l_linenumber", score)


@plan(
    "x24_is_same",
    f"""with {fx.VEC_PAIRS} select i, list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]) >= 0.1 same from vp""",
)
def x24_is_same(spark, sf):
    from effectlab.functions.vector import cosine

    return fx.vec_pairs(spark, sf).select("i", scoring.is_same(cosine("a", "b"), 0.1).alias("same"))


@plan(
    "k3_largest_box",
    """with d as (select l_orderkey, l_linenumber, l_quantity x0, l_quantity / 2 y0, l_quantity + l_partkey % 37 - 3.5 x1, l_quantity / 2 + l_suppkey % 23 y1, 0.3 + l_tax * 12 confidence from lineitem),
    r as (select *, row_number() over (partition by l_orderkey order by greatest(x1 - x0, 0) * greatest(y1 - y0, 0) desc, l_linenumber, x0, x1, y1) rn from d where confidence >= 0.9)
    select l_orderkey, round_even(x0, 0)::int box_x, round_even(y0, 0)::int box_y, greatest(round_even(x1, 0) - round_even(x0, 0), 0)::int box_w,
      greatest(round_even(y1, 0) - round_even(y0, 0), 0)::int box_h from r where rn = 1""",
)
def k3_largest_box(spark, sf):
    detections = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber * 1000000D + l_quantity * 1000 + l_partkey % 37 + l_suppkey % 23 / 100D as seq",
        "l_quantity as x0", "l_quantity / 2 as y0", "l_quantity + l_partkey % 37 - 3.5D as x1", "l_quantity / 2 + l_suppkey % 23 as y1", "0.3D + l_tax * 12 as confidence",
    )
    return geo.largest_box(detections, "l_orderkey").drop("confidence")
