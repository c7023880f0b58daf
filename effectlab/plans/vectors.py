"""Plans: directions, steering, stability and disentanglement over the vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlab.functions import vector as v
from effectlab.functions.rng import draw_sql
from effectlab.operators import directions as d
from effectlab.operators import disentangle, steering
from effectlab.operators.stability import split_half
from effectlab.plans import fixtures as fx
from effectlab.plans.registry import plan, q6, r6, rounded

SHAPE = (4, 4, 4)
GRID = SHAPE[1:]
MASK = {"center": 1.0, "edge": 0.3, "radius": 1.0}


def vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "embedding")


def direction(spark, sf):
    return d.paired_direction(fx.vec_pairs(spark, sf))


def long(df, *by, column="vector"):
    out = d.positions_of(df, by, column)
    return rounded(out, "value")


UN = "unnest(range(64))"
EM = "em as (select vec_id, embedding::DOUBLE[] e, label % 2 y from embeddings)"
DIRECTION = fx.VEC_PAIRS + """, pos as (select unnest(range(64)) pos), dif as (select i, pos, b[pos + 1]::DOUBLE - a[pos + 1]::DOUBLE d from vp cross join pos),
dirn as (select pos, avg(d) v from dif group by pos), dv as (select list(v order by pos) v from dirn)"""
YX = "((pos % 16) // 4)", "(pos % 4)"
WEIGHT = f"(0.3 + 0.7 * exp(-3 * (pow(-1 + {YX[0]} * 2.0 / 3, 2) + pow(-1 + {YX[1]} * 2.0 / 3, 2))))"


def per_position(rows: str, value: str, keys: str = "vec_id") -> str:
    return f"select {keys}, pos::int pos, {q6(value)} value from {rows} cross join pos"


@plan("v1_paired_direction", f"with {DIRECTION} select pos::int pos, {q6('v')} value from dirn")
def v1_paired_direction(spark, sf):
    return long(d.paired_direction(d.require_pairs(fx.vec_pairs(spark, sf))))


@plan(
    "v1_paired_direction_masked",
    f"""with {DIRECTION}, m as (select pos, v * {WEIGHT} v from dirn)
    select pos::int pos, {q6("v / ((select sqrt(sum(v * v)) from m) + 1e-8)")} value from m""",
)
def v1_paired_direction_masked(spark, sf):
    return long(d.paired_direction(fx.vec_pairs(spark, sf), grid=GRID, mask=MASK, normalize=True))


@plan(
    "v2_group_direction",
    f"""with {EM}, pos as (select unnest(range(64)) pos), m as (select pos, avg(e[pos + 1]) filter (where y = 1) - avg(e[pos + 1]) filter (where y = 0) v from em cross join pos group by pos)
    select pos::int pos, {q6("v / ((select sqrt(sum(v * v)) from m) + 1e-8)")} value from m""",
)
def v2_group_direction(spark, sf):
    return long(d.group_direction(fx.vec_labelled(spark, sf), "embedding", "y"))


@plan(
    "v3_agreement",
    f"""with {fx.VEC_PAIRS}, p as (select i, a::DOUBLE[] a, b::DOUBLE[] b from vp),
    n as (select *, sqrt(list_dot_product(a, a)) na, sqrt(list_dot_product(b, b)) nb from p)
    select i, {q6("list_dot_product(a, b) / (na * nb)")} cosine, {q6("na")} norm_a, {q6("nb")} norm_b, {q6("nb / na")} norm_ratio,
      {q6("least(na, nb) / greatest(na, nb)")} norm_agreement,
      {q6("list_max(list_transform(range(1, 65), lambda k: abs(a[k] - b[k])))")} max_abs_diff from n""",
)
def v3_agreement(spark, sf):
    out = fx.vec_pairs(spark, sf).select("i", v.agreement("a", "b").alias("s")).select("i", "s.*")
    return rounded(out, *[c for c in out.columns if c != "i"])


@plan("v4_center_mask", f"with {EM}, pos as (select unnest(range(64)) pos) {per_position('em', f'e[pos + 1] * {WEIGHT}')}")
def v4_center_mask(spark, sf):
    return long(vectors(spark, sf).select("vec_id", v.masked("embedding", *GRID, **MASK).alias("vector")), "vec_id")


@plan(
    "v5_apply_mask",
    f"""with {EM}, pos as (select unnest(range(64)) pos)
    {per_position('em', f'e[pos + 1] * (0.2 + 0.6 * (1 - least(sqrt(pow(-1 + {YX[0]} * 2.0 / 3, 2) + pow(-1 + {YX[1]} * 2.0 / 3, 2)) / 0.8, 1)))')}""",
)
def v5_apply_mask(spark, sf):
    df = vectors(spark, sf)
    weights = d.center_mask(df, *GRID, center=0.8, edge=0.2, falloff="linear", radius=0.8)
    return rounded(d.apply_mask(df, "vec_id", "embedding", weights, *GRID), "value")


@plan(
    "v6_sweep",
    f"""with {DIRECTION}, {EM}, al as (select unnest([-2.0, 0.0, 1.5]::DOUBLE[]) alpha), m as (select vec_id, alpha, e, v from em cross join al cross join dv)
    select vec_id, alpha, {q6("sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(e[k] + alpha * v[k], 2))))")} norm,
      {q6("e[1] + alpha * v[1]")} first_value, {q6("e[64] + alpha * v[64]")} last_value from m""",
)
def v6_sweep(spark, sf):
    out = steering.sweep(vectors(spark, sf), "embedding", direction(spark, sf), [-2.0, 0.0, 1.5])
    return out.select(
        "vec_id", "alpha", r6(v.norm("embedding"), "norm"),
        r6(F.get("embedding", F.lit(0)), "first_value"), r6(F.get("embedding", F.lit(63)), "last_value"),
    )


def _src(t: str, size: int, new: int) -> str:
    return f"greatest(({t} + 0.5) * ({size} / {new}::DOUBLE) - 0.5, 0)"


@plan(
    "v7_resize_grid",
    f"""with {EM}, g as (select unnest(range(4 * 6 * 5)) k), t as (select k, k // 30 c, {_src("((k % 30) // 5)", 4, 6)} sy, {_src("(k % 5)", 4, 5)} sx from g),
    w as (select k, c, floor(sy)::int y0, least(floor(sy)::int + 1, 3) y1, sy - floor(sy) fy, floor(sx)::int x0, least(floor(sx)::int + 1, 3) x1, sx - floor(sx) fx from t)
    select vec_id, k::int pos, {q6("(e[c*16 + y0*4 + x0 + 1] * (1 - fx) + e[c*16 + y0*4 + x1 + 1] * fx) * (1 - fy) + (e[c*16 + y1*4 + x0 + 1] * (1 - fx) + e[c*16 + y1*4 + x1 + 1] * fx) * fy")} value
    from em cross join w""",
)
def v7_resize_grid(spark, sf):
    return long(vectors(spark, sf).select("vec_id", v.resize_grid("embedding", *SHAPE, 6, 5).alias("vector")), "vec_id")


@plan(
    "v8_apply_vectors",
    f"""with {EM}, pos as (select unnest(range(64)) pos), gm as (select label, pos, avg(embedding[pos + 1]::DOUBLE) v from embeddings cross join pos group by all),
    c as (select pos, sum(v * case label when 0 then 0.5 when 1 then -2 else 1 end) v from gm group by pos)
    select vec_id, pos::int pos, {q6("e[pos + 1] + v")} value from em cross join c""",
)
def v8_apply_vectors(spark, sf):
    table = fx.table(spark, sf, "embeddings")
    means = d.positions_of(table, ["label"], "embedding").groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    named = d.as_vector(means, ["label"]).select(F.concat(F.lit("g"), "label").alias("name"), "vector")
    out = steering.apply_vectors(vectors(spark, sf), "embedding", named, {"g0": 0.5, "g1": -2.0})
    return long(out, "vec_id", column="embedding")


@plan(
    "v9_constrained",
    f"""with {DIRECTION}, {EM}, st as (select unnest(range(50)) i), m as (select vec_id, i,
      list_sum(list_transform(range(1, 65), lambda k: pow(e[k] + 3 * pow(0.9, i) * v[k], 2))) n2, list_dot_product(e, e) z2 from em cross join st cross join dv),
    s as (select vec_id, coalesce(min(i) filter (where n2 <= z2 * 1.02), 50) step from m group by vec_id)
    select vec_id, step::int step, {q6("3 * pow(0.9, step)")} alpha from s""",
)
def v9_constrained(spark, sf):
    out = steering.constrained(
        vectors(spark, sf), "embedding", direction(spark, sf), 3.0, lambda z, moved: v.dot(moved, moved) <= v.dot(z, z) * 1.02
    )
    return out.select("vec_id", "step", r6("alpha"))


@plan(
    "v10_best_alpha",
    f"""with {DIRECTION}, {EM}, g as (select i, -3 + i * 6.0 / 19 alpha from (select unnest(range(20)) i)), m as (select vec_id, i, alpha,
      -abs(list_sum(list_transform(range(1, 65), lambda k: pow(e[k] + alpha * v[k], 2))) - 1.05) s from em cross join g cross join dv)
    select vec_id, {q6("alpha")} best_alpha, {q6("s")} best_score from (select *, row_number() over (partition by vec_id order by s desc, i) rn from m) where rn = 1""",
)
def v10_best_alpha(spark, sf):
    out = steering.best_alpha(
        vectors(spark, sf), "embedding", direction(spark, sf), lambda moved: -F.abs(v.dot(moved, moved) - 1.05)
    )
    return out.select("vec_id", r6("best_alpha"), r6("best_score"))


def project_sql(labels: int = 10) -> str:
    """Gram-Schmidt over the labels' mean vectors, one step a label, and the projection."""
    names = [f"a{i}" for i in range(labels)]
    steps = [f"""{EM}, pos as (select unnest(range(64)) pos), gm as (select label, pos, avg(embedding[pos + 1]::DOUBLE) v from embeddings cross join pos group by all),
    w0 as materialized (select pos, {", ".join(f"max(v) filter (where label = {i}) a{i}" for i in range(labels))} from gm group by pos)"""]
    for i, name in enumerate(names):
        unit = [f"{n} / ((select sqrt(sum({n} * {n})) from w{i}) + 1e-8) {n}" if n == name else n for n in names]
        steps.append(f"u{i} as materialized (select pos, {', '.join(unit)} from w{i})")
        rest = [f"{n} - (select sum({n} * {name}) from u{i}) * {name} {n}" if j > i else n for j, n in enumerate(names)]
        steps.append(f"w{i + 1} as materialized (select pos, {', '.join(rest)} from u{i})")
    sums = ", ".join(f"sum(e[pos + 1] * {n}) k{n}" for n in names)
    whole = " + ".join(f"k{n} * {n}" for n in names)
    return "with " + ",\n".join(steps) + f""", k as (select vec_id, {sums} from em cross join w{labels} group by vec_id)
    select vec_id, pos::int pos, {q6(whole)} value from k cross join w{labels}"""


@plan("v11_project", project_sql())
def v11_project(spark, sf):
    table = fx.table(spark, sf, "embeddings")
    means = d.positions_of(table, ["label"], "embedding").groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    basis = steering.orthonormal(d.as_vector(means, ["label"]).withColumnRenamed("label", "name"))
    return long(steering.project(vectors(spark, sf), "embedding", basis), "vec_id", column="embedding")


INTER = fx.VEC_PAIRS + """, p as (select i, a::DOUBLE[] a, b::DOUBLE[] b, s.step, s.step / 4.0 t, acos(greatest(-1, least(1, list_dot_product(a::DOUBLE[], b::DOUBLE[])
  / ((sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) + 1e-8) * (sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])) + 1e-8))))) th
  from vp cross join (select unnest(range(5)) step) s)"""


@plan(
    "v12_interpolate_linear",
    f"with {INTER} select i, step::int step, {q6('(1 - t) * a[1] + t * b[1]')} first_value, {q6('(1 - t) * a[64] + t * b[64]')} last_value from p",
)
def v12_interpolate_linear(spark, sf):
    out = steering.interpolate(fx.vec_pairs(spark, sf), "a", "b", 5)
    return out.select("i", "step", r6(F.get("vector", F.lit(0)), "first_value"), r6(F.get("vector", F.lit(63)), "last_value"))


@plan(
    "v12_interpolate_spherical",
    f"""with {INTER}, w as (select *, case when sin(th) < 1e-6 then 1 - t else sin((1 - t) * th) / sin(th) end wa, case when sin(th) < 1e-6 then t else sin(t * th) / sin(th) end wb from p)
    select i, step::int step, {q6('wa * a[1] + wb * b[1]')} first_value, {q6('wa * a[64] + wb * b[64]')} last_value from w""",
)
def v12_interpolate_spherical(spark, sf):
    out = steering.interpolate(fx.vec_pairs(spark, sf), "a", "b", 5, "spherical")
    return out.select("i", "step", r6(F.get("vector", F.lit(0)), "first_value"), r6(F.get("vector", F.lit(63)), "last_value"))


@plan(
    "v13_rescale",
    f"""with {EM}, pos as (select unnest(range(64)) pos), n as (select vec_id, e, sqrt(list_dot_product(e, e)) n from em) {per_position("n", "e[pos + 1] * 2.5 / n")}""",
)
def v13_rescale(spark, sf):
    return long(vectors(spark, sf).select("vec_id", v.rescale("embedding", 2.5).alias("vector")), "vec_id")


STATS = EM + """, pos as (select unnest(range(64)) pos), st as (select pos, avg(e[pos + 1]) m, stddev_samp(e[pos + 1]) s, min(e[pos + 1]) lo, max(e[pos + 1]) hi from em cross join pos group by pos)"""


@plan("v14_latent_stats", f'with {STATS} select pos::int pos, {q6("m")} mean, {q6("s")} std, {q6("lo")} min, {q6("hi")} max from st')
def v14_latent_stats(spark, sf):
    return rounded(d.latent_stats(vectors(spark, sf), "embedding"), "mean", "std", "min", "max")


@plan(
    "v15_clip_range",
    f"with {STATS} select vec_id, pos::int pos, {q6('least(greatest(e[pos + 1], m - 1.2 * s), m + 1.2 * s)')} value from em cross join st",
)
def v15_clip_range(spark, sf):
    df = vectors(spark, sf)
    return long(d.clip_range(df, "embedding", d.latent_stats(df, "embedding"), 1.2), "vec_id", column="embedding")


@plan(
    "v16_spatial_pattern",
    f"""with {EM}, pos as (select unnest(range(64)) pos), l as (select vec_id, pos // 16 c, (pos % 16) // 4 y, pos % 4 x, e[pos + 1] * e[pos + 1] q from em cross join pos)
    select vec_id, 'channel' part, c i, null::BIGINT j, {q6("sum(q)")} value from l group by vec_id, c
    union all select vec_id, 'cell', y, x, {q6("avg(q)")} from l group by vec_id, y, x
    union all select vec_id, 'norm', null, null, {q6("sqrt(sum(q))")} from l group by vec_id""",
)
def v16_spatial_pattern(spark, sf):
    return rounded(d.spatial_pattern(vectors(spark, sf), "vec_id", "embedding", *GRID), "value")


def pca_sql(k: int, squarings: int = 15) -> str:
    """The leading components of the covariance, one after the other: the matrix is squared
    until one direction is left, which is then taken out of it."""
    steps = [f"""{EM}, pos as (select unnest(range(64)) pos), l as (select vec_id, y, pos, e[pos + 1] x from em cross join pos),
ce as (select vec_id, y, pos, x - avg(x) over (partition by pos) x from l),
m0 as materialized (select a.pos i, b.pos j, sum(a.x * b.x) / ((select count(*) from em) - 1) v from ce a join ce b using (vec_id) group by all)"""]
    for c in range(k):
        last = f"m{c}"
        for i in range(squarings):
            name = f"p{c}_{i}"
            steps.append(f"""{name}_r as materialized (select a.i, b.j, sum(a.v * b.v) v from {last} a join {last} b on a.j = b.i group by a.i, b.j),
{name} as materialized (select i, j, v / (select sum(v) from {name}_r where i = j) v from {name}_r)""")
            last = name
        steps.append(f"""c{c}_r as materialized (select i, v from {last} where j = (select arg_max(i, v) from {last} where i = j)),
c{c} as materialized (select i, v * (select sign(arg_max(v, abs(v))) from c{c}_r) / (select sqrt(sum(v * v)) from c{c}_r) v from c{c}_r),
e{c} as materialized (select sum(a.v * m.v * b.v) v from m{c} m join c{c} a on m.i = a.i join c{c} b on m.j = b.i),
m{c + 1} as materialized (select m.i, m.j, m.v - (select v from e{c}) * a.v * b.v v from m{c} m join c{c} a on m.i = a.i join c{c} b on m.j = b.i)""")
    union = " union all ".join(f"select {c} component, i pos, v from c{c}" for c in range(k))
    return ",\n".join(steps) + f""",
cs as materialized ({union}),
sc as (select component, abs(corr(s, y)) r from (select component, vec_id, any_value(y) y, sum(ce.x * cs.v) s from ce join cs using (pos) group by component, vec_id) group by component),
best as (select component, r from sc order by r desc, component limit 1)"""


@plan(
    "v17_pca_direction",
    f"""with {pca_sql(10)} select component::int component, {q6("r")} correlation, true converged, {q6("1.0")} length, pos::int pos, {q6("v")} value
    from cs join best using (component)""",
)
def v17_pca_direction(spark, sf):
    out = d.pca_direction(fx.vec_labelled(spark, sf), "embedding", "y", 10)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    return out.select("component", r6("correlation"), (F.col("residual") < 1e-8).alias("converged"), r6(length, "length"), F.posexplode("vector").alias("pos", "value")).withColumn("value", r6("value"))


@plan("v18_decompose", f"with {EM}, pos as (select unnest(range(64)) pos) {per_position('em', 'e[pos + 1]')}")
def v18_decompose(spark, sf):
    """The parts of a full decomposition add up to the vector again."""
    parts = d.decompose(vectors(spark, sf), "vec_id", "embedding", SHAPE, 4)
    cells = d.positions_of(parts, ["vec_id"], "vector")
    return rounded(cells.groupBy("vec_id", "pos").agg(F.sum("value").alias("value")), "value")


@plan(
    "v18_decompose_energy",
    f"with {EM} select vec_id, 4 n_parts, {q6('list_dot_product(e, e)')} energy, true ordered from em",
)
def v18_decompose_energy(spark, sf):
    parts = d.decompose(vectors(spark, sf), "vec_id", "embedding", SHAPE, 4)
    s = F.array_sort(F.array_agg(F.struct("part", "singular_value")))  # four parts per vector
    rows = parts.groupBy("vec_id").agg(F.count(F.lit(1)).cast("int").alias("n_parts"), F.sum(F.col("singular_value") * F.col("singular_value")).alias("energy"), s.alias("s"))
    falling = F.forall(F.sequence(F.lit(1), F.lit(3)), lambda i: F.get("s", i)["singular_value"] <= F.get("s", i - 1)["singular_value"])
    return rows.select("vec_id", "n_parts", r6("energy"), falling.alias("ordered"))


def parts_sql(parts: int = 4, squarings: int = 14) -> str:
    """The rank-one parts of each vector as a 4 x 16 matrix M: u u' M for the leading
    directions u of M M', which is squared until one direction is left."""
    steps = [f"""{EM}, c as (select vec_id, pos // 16 i, pos % 16 h, e[pos + 1] x from em cross join (select unnest(range(64)) pos)),
m0 as materialized (select a.vec_id, a.i, b.i j, sum(a.x * b.x) v from c a join c b using (vec_id, h) group by all)"""]
    for p in range(parts):
        last = f"m{p}"
        for k in range(squarings):
            name = f"q{p}_{k}"
            steps.append(f"""{name}_r as materialized (select a.vec_id, a.i, b.j, sum(a.v * b.v) v from {last} a join {last} b on a.vec_id = b.vec_id and a.j = b.i group by all),
{name} as materialized (select vec_id, i, j, v / t v from {name}_r join (select vec_id, sum(v) t from {name}_r where i = j group by vec_id) using (vec_id))""")
            last = name
        steps.append(f"""e{p} as materialized (select vec_id, sum(m.v * w.v) v from m{p} m join {last} w using (vec_id, i, j) group by vec_id),
w{p} as materialized (select * from {last}),
m{p + 1} as materialized (select vec_id, i, j, m.v - e.v * w.v v from m{p} m join w{p} w using (vec_id, i, j) join e{p} e using (vec_id))""")
    each = " union all ".join(
        f"select w.vec_id, {p} part, sqrt(e.v) s, w.i * 16 + c.h pos, sum(w.v * c.x) v from w{p} w join c on w.vec_id = c.vec_id and w.j = c.i join e{p} e on e.vec_id = w.vec_id group by all" for p in range(parts)
    )
    return ",\n".join(steps) + f", ps as ({each})"


@plan("v18_parts", f"with {parts_sql(3)} select vec_id, part::int part, {q6('s')} singular_value, pos::int pos, {q6('v')} value from ps")
def v18_parts(spark, sf):
    """Every part with its strength: orthogonal to the others and of rank one, or the SQL differs."""
    parts = d.decompose(vectors(spark, sf), "vec_id", "embedding", SHAPE, 3)
    return parts.select("vec_id", "part", r6("singular_value"), F.posexplode("vector").alias("pos", "value")).withColumn("value", r6("value"))


def sap_sql(rounds: int = 10) -> str:
    """Newton rounds for one logistic regression per position, written out."""
    steps = [f"""{EM}, pos as (select unnest(range(64)) pos), l as (select pos, y, e[pos + 1] x from em cross join pos),
s0 as (select pos, 0.0::DOUBLE w, (select ln(avg(y) / (1 - avg(y))) from em) b from pos)"""]
    for i in range(rounds):
        steps.append(f"""g{i} as (select pos, any_value(w) w, any_value(b) b, sum((p - y) * x) + any_value(w) gw, sum(p - y) gb,
  sum(p * (1 - p) * x * x) + 1 a, sum(p * (1 - p) * x) c, sum(p * (1 - p)) d
  from (select l.*, w, b, 1 / (1 + exp(-(w * x + b))) p from l join s{i} using (pos)) group by pos),
s{i + 1} as (select pos, w - (d * gw - c * gb) / (a * d - c * c) w, b - (a * gb - c * gw) / (a * d - c * c) b from g{i})""")
    return ",\n".join(steps) + f""",
ac as (select pos, avg(((w * x + b > 0)::int = y)::int) acc from l join s{rounds} using (pos) group by pos),
rk as (select acc, row_number() over (order by acc desc) rn from ac)"""


@plan("v19_sap", f"with {sap_sql()} select {q6('(select acc from rk where rn = 1) - (select acc from rk where rn = 2)')} sap")
def v19_sap(spark, sf):
    return rounded(disentangle.sap(fx.vec_labelled(spark, sf), "embedding", "y"), "sap")


@plan("v19_sap_classes")
def v19_sap_classes(spark, sf):
    """The label with all its values, against every position by itself."""
    out = disentangle.softmax_by_position(fx.table(spark, sf, "embeddings"), "embedding", "label")
    return out.select("pos", r6("accuracy"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


@plan(
    "v19_logistic",
    f"with {sap_sql()} select pos::int pos, {q6('w')} weight, {q6('b')} bias, {q6('acc')} accuracy from s10 join ac using (pos)",
)
def v19_logistic(spark, sf):
    out = disentangle.logistic_by_position(fx.vec_labelled(spark, sf), "embedding", "y")
    return rounded(out, "weight", "bias", "accuracy")


MI = EM + """, pos as (select unnest(range(64)) pos), l as (select pos, y, e[pos + 1] x from em cross join pos),
sp as (select pos, min(x) lo, max(x) hi from l group by pos),
bn as (select l.pos, y, case when hi > lo then least(floor((x - lo) / (hi - lo) * 19)::int + 1, 20) else 20 end bin from l join sp on l.pos = sp.pos),
ct as (select pos, bin, y, count(*) n from bn group by all)"""
RG = """, f as (select pos, count(distinct bin) u, min(bin) a, max(bin) b, count(distinct y) v from ct group by pos),
cr as (select ct.pos, case when b > a then least(floor((bin - a) * u / (b - a)::DOUBLE)::int, u - 1) else 0 end bin, y, sum(n)::DOUBLE n
  from ct join f on ct.pos = f.pos group by all),
cm as (select *, sum(n) over (partition by pos) t, sum(n) over (partition by pos, bin) nb, sum(n) over (partition by pos, y) ny from cr),
mi as (select pos, sum(n / t * ln(n * t / (nb * ny))) mi from cm group by pos)"""


@plan("v20_mutual_information", f"with {MI}{RG} select pos::int pos, {q6('mi')} mi from mi")
def v20_mutual_information(spark, sf):
    return rounded(disentangle.mutual_information(fx.vec_labelled(spark, sf), "embedding", "y"), "mi")


@plan(
    "v20_mig",
    f"""with {MI}{RG}, r as (select mi, row_number() over (order by mi desc) rn from mi), p as (select count(*) / sum(count(*)) over () p from em group by y)
    select {q6("((select mi from r where rn = 1) - (select mi from r where rn = 2)) / (select -sum(p * ln(p)) from p)")} mig""",
)
def v20_mig(spark, sf):
    return rounded(disentangle.mig(fx.vec_labelled(spark, sf), "embedding", "y"), "mig")


@plan("v21_dci")
def v21_dci(spark, sf):
    return rounded(disentangle.dci(fx.vec_labelled(spark, sf), "embedding", "y"), "disentanglement", "completeness", "informativeness")


@plan(
    "v21_dci_scores",
    f"""with {EM}, pos as (select unnest(range(64)) pos), i as (select pos, sum(pow(e[pos + 1], 8)) imp from em cross join pos group by pos),
    c as (select imp / sum(imp) over () p, sum(imp) over (order by imp desc, pos rows unbounded preceding) u, sum(imp) over () t from i)
    select {q6("1 + sum(p * ln(p)) / ln(64 + 1e-8)")} disentanglement, {q6("1 - (count(*) filter (where u < 0.99 * t) + 1) / 64")} completeness from c""",
)
def v21_dci_scores(spark, sf):
    value = F.col("value").cast("double")
    table = d.positions_of(vectors(spark, sf), [], "embedding").groupBy("pos").agg(F.sum(F.pow(value, F.lit(8.0))).alias("importance"))
    return rounded(disentangle.dci_scores(table), "disentanglement", "completeness")


@plan("v22_disentanglement")
def v22_disentanglement(spark, sf):
    return rounded(disentangle.disentanglement(fx.vec_labelled(spark, sf), "embedding", "y"), "value")


@plan(
    "v23_latent_diagnostic",
    f"""with {EM}, pos as (select unnest(range(64)) pos), m as (select pos, avg(e[pos + 1]) filter (where y = 0) a, avg(e[pos + 1]) filter (where y = 1) b from em cross join pos group by pos)
    select {q6("avg(a)")} mean_a, {q6("stddev_samp(a)")} std_a, {q6("avg(b)")} mean_b, {q6("stddev_samp(b)")} std_b, {q6("avg(b - a)")} mean_diff,
      {q6("stddev_samp(b - a)")} std_diff, {q6("sqrt(sum((b - a) * (b - a)))")} norm_diff, sqrt(sum((b - a) * (b - a))) < 10 too_similar from m""",
)
def v23_latent_diagnostic(spark, sf):
    out = d.latent_diagnostic(fx.vec_labelled(spark, sf), "embedding", "y")
    return rounded(out, *[c for c in out.columns if c != "too_similar"])


@plan(
    "w6_components_needed",
    f"""with {EM}, pos as (select unnest(range(64)) pos), i as (select pos, sum(pow(e[pos + 1], 4)) imp from em cross join pos group by pos),
    c as (select sum(imp) over (order by imp desc, pos rows unbounded preceding) u, sum(imp) over () t from i)
    select count(*) n_components, count(*) filter (where u < 0.9 * t) + 1 n_needed from c""",
)
def w6_components_needed(spark, sf):
    value = F.col("value").cast("double")
    table = d.positions_of(vectors(spark, sf), [], "embedding").groupBy("pos").agg(F.sum(F.pow(value, F.lit(4.0))).alias("importance"))
    return disentangle.components_needed(table, share=0.9)


COUNTS = (8, 16, 32)


@plan(
    "b7_split_half",
    f"""with {DIRECTION}, c as (select unnest([8, 16, 32]) pair_count), r as (select unnest(range(200)) resample),
    dr as (select pair_count, resample, i, row_number() over (partition by pair_count, resample order by hi, lo >> 2, i) rk
      from ({draw_sql("(select i, pair_count, resample from vp cross join c cross join r)", 20260816, "resample", "i", "pair_count")})),
    h as (select pair_count, resample, pos, avg(d) filter (where rk <= pair_count) l, avg(d) filter (where rk > pair_count) q
      from dr join dif using (i) where rk <= 2 * pair_count group by all),
    w as (select h.*, {WEIGHT} w, v f from h join dirn using (pos))
    select pair_count, resample::int resample, {q6("sum(l * q) / sqrt(sum(l * l) * sum(q * q))")} raw_cosine,
      {q6("sum(l * q * w * w) / sqrt(sum(l * l * w * w) * sum(q * q * w * w))")} masked_cosine,
      {q6("least(sqrt(sum(l * l)), sqrt(sum(q * q))) / greatest(sqrt(sum(l * l)), sqrt(sum(q * q)))")} norm_agreement,
      {q6("sum(l * f) / sqrt(sum(l * l) * sum(f * f))")} left_to_full_cosine, {q6("sum(q * f) / sqrt(sum(q * q) * sum(f * f))")} right_to_full_cosine
    from w group by pair_count, resample""",
)
def b7_split_half(spark, sf):
    out = split_half(fx.vec_pairs(spark, sf), COUNTS, grid=GRID)
    return rounded(out, *[c for c in out.columns if c not in ("pair_count", "resample")])
