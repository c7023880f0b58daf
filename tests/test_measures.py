"""Colour, geometry, scores, vectors and disentanglement on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlab.contracts import ContractViolation
from effectlab.functions import geometry as geo
from effectlab.functions import scoring
from effectlab.functions import vector as v
from effectlab.functions.colour import ita, with_lab
from effectlab.operators import directions as d
from effectlab.operators import disentangle, images, steering, validation
from effectlab.operators.stability import split_half


def solid(spark, image_id, side, colour, border=None, inner=None):
    axis = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    px = spark.range(1).select(F.lit(image_id).alias("image_id"), axis.alias("x")).select("*", axis.alias("y"))
    inside = F.lit(True) if inner is None else (F.col("x").between(*inner) & F.col("y").between(*inner))
    cells = {c: F.when(inside, F.lit(colour[i])).otherwise(F.lit((border or colour)[i])) for i, c in enumerate("rgb")}
    return px.withColumns(cells)


def box(spark, image_id, *values):
    return spark.createDataFrame([(image_id, *values)], "image_id int, box_x int, box_y int, box_w int, box_h int")


def test_lightness_of_greys_and_the_angle_of_a_known_point(spark):
    greys = spark.createDataFrame([(g, g, g) for g in (0, 119, 255)], "r int, g int, b int")
    rows = {r.r: r for r in with_lab(greys).collect()}
    assert [rows[g].lab_l for g in (0, 119, 255)] == pytest.approx([0.0, 50.0, 100.0], abs=0.2)
    assert all(abs(r.lab_a) < 0.02 and abs(r.lab_b) < 0.02 for r in rows.values())
    tilted = spark.range(1).select(ita(F.lit(50 + 12 * 3**0.5), F.lit(12.0)), ita(F.lit(38.0), F.lit(12.0))).first()
    assert tuple(tilted) == pytest.approx((60.0, -45.0))


def test_colour_change_has_the_sign_of_the_shade(spark):
    face = box(spark, 7, 12, 6, 90, 100)
    light, dark = ((210, 160, 130), (140, 95, 80))
    measured = {c: images.measure_colour(solid(spark, 7, 118, c), face, 118, 118, 80) for c in (light, dark)}
    darker = images.colour_change(face, measured[light], measured[dark]).first()
    lighter = images.colour_change(face, measured[dark], measured[light]).first()
    assert darker.skin_tone_complete and darker.skin_tone_change > 0 > darker.lightness_change
    assert lighter.skin_tone_change == pytest.approx(-darker.skin_tone_change)
    lost = images.colour_change(face, measured[light].limit(0), measured[dark]).first()
    assert not lost.skin_tone_complete and lost.skin_tone_change is None


def test_a_white_border_cancels_an_even_dimming(spark):
    face = box(spark, 3, 40, 44, 120, 112)
    px = solid(spark, 3, 200, (165, 118, 92), (228, 224, 220), (36, 163))
    made = [images.measure_colour(images.apply_gain(px, {"g": (k, k, k)}), face, 200, 200, 80).first() for k in (1.0, 0.8)]
    assert all(r.normalized for r in made)
    assert made[0].ita == pytest.approx(made[1].ita, abs=1.0)


def test_gain_is_clipped(spark):
    row = images.apply_gain(solid(spark, 1, 1, (120, 60, 250)), {"g": (1.5, 0.5, 1.2)}).first()
    assert (row.r, row.g, row.b) == (180, 30, 255)
    for bad in (0.0, -1.0):
        with pytest.raises(ValueError):
            images.apply_gain(solid(spark, 1, 1, (5, 6, 7)), {"g": (1.0, bad, 1.0)})


def test_similarity_equals_a_direct_computation(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (40, 25)), rng.integers(0, 256, (40, 25))
    rows = lambda m: [(1, x, y, int(m[y, x]), int(m[y, x]), int(m[y, x])) for y in range(40) for x in range(25)]
    schema = "image_id int, x int, y int, r int, g int, b int"
    one, two = spark.createDataFrame(rows(a), schema), spark.createDataFrame(rows(b), schema)
    values = []
    for y in range(34):
        for x in range(19):
            p, q = a[y : y + 7, x : x + 7].ravel().astype(float), b[y : y + 7, x : x + 7].ravel().astype(float)
            c = np.cov(p, q)
            values.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225)
                          / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    assert images.ssim(one, two).first().ssim == pytest.approx(np.mean(values))
    assert images.ssim(one, two, strip_rows=8).first().ssim == pytest.approx(np.mean(values))
    assert images.ssim(one, one).first().ssim == pytest.approx(1.0)


def test_background_needs_a_box(spark):
    px = solid(spark, 1, 16, (90, 90, 90)).unionByName(solid(spark, 2, 16, (90, 90, 90))).unionByName(solid(spark, 3, 16, (9, 9, 9)))
    faces = box(spark, 1, 4, 4, 4, 4).unionByName(box(spark, 2, 0, 0, 16, 16))
    got = {r.image_id: r.background_ssim for r in images.background_ssim(px, px, faces, 16, 16).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: None}


def pose(spark, points):
    df = spark.createDataFrame([(points,)], "p array<array<double>>")
    return df.select(geo.pose_from_landmarks("p").alias("s")).first().s


def test_pose_angles_worked_by_hand(spark):
    # Eyes 40 apart at height 50, mouth at 96, the nose half way down.
    face = [[40.0, 50.0], [80.0, 50.0], [60.0, 73.0], [46.0, 96.0], [74.0, 96.0]]
    assert tuple(pose(spark, face)) == pytest.approx((0.0, 0.0, 0.0))
    moved = lambda i, dx, dy: [[x + dx * (k == i), y + dy * (k == i)] for k, (x, y) in enumerate(face)]
    assert pose(spark, moved(2, -9.0, 0.0)).yaw == pytest.approx(np.degrees(np.arctan2(-9, 40)))
    assert pose(spark, moved(2, 0.0, 4.6)).pitch == pytest.approx(np.degrees(np.arctan(0.1)))
    assert pose(spark, moved(1, 0.0, 8.0)).roll == pytest.approx(np.degrees(np.arctan2(8, 40)))


@pytest.mark.parametrize("points", [[[3.0, 4.0]] * 5, [[0.0, 0.0], [9.0, 0.0]], [[0.0, 0.0], [9.0, 0.0], [4.0, None], [1.0, 9.0], [8.0, 9.0]], []])
def test_no_pose_without_five_distinct_finite_points(spark, points):
    assert pose(spark, points) is None


def test_gate_counts_checks_and_needs_the_core_metrics(spark):
    rows = [(1, 0.95, 0.15, 0.9, 2.0), (2, 0.95, 0.15, None, 2.0), (3, 0.8, 0.15, 0.9, 9.0), (4, 0.85, 0.3, 0.75, None)]
    df = spark.createDataFrame(rows, "i int, face_similarity double, lpips double, background_ssim double, total_pose_diff double")
    got = {r.i: r for r in scoring.overall_score(scoring.gate(df)).collect()}
    assert {i: r.is_disentangled for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert {i: (r.pass_count, r.total_count) for i, r in got.items()} == {1: (4, 4), 2: (3, 3), 3: (2, 4), 4: (3, 3)}
    assert got[2].missing_required_metrics == ["background_ssim"]
    assert got[1].overall_score == pytest.approx((0.3 * 0.95 + 0.2 * 0.5 + 0.2 * 0.9 + 0.1 * 0.6) / 0.8)


# Published gaps of 32 validation pairs and their summary.
GAPS = [
    16.93113449153, 12.15057786072, 7.362466939972, 43.226282145847, 15.310190999396, 36.333931874831, 9.107960391038,
    21.301434393483, 32.595607073081, 10.079346074783, 16.407282830692, 13.087089743982, 15.954943158923, 40.661832404461,
    -2.541871664764, 38.178733614115, 29.329412809843, 8.703173588757, 11.862278038207, 50.907710982827, 18.159799936746,
    8.656602768009, 13.917982935819, 19.391130233612, 17.289314337431, 9.716387692582, 10.484845334613, 45.075362336677,
    26.900979186253, 38.997784172536, 7.624562981672, 21.65956867419,
]


def test_validation_reproduces_published_accuracy(spark):
    measures = [(i, "light", g + 40.0) for i, g in enumerate(GAPS)] + [(i, "dark", 40.0) for i in range(32)]
    m = spark.createDataFrame(measures, "pair_id int, group string, ita double")
    pairs = validation.pair_measures(m, m)
    shifts = spark.createDataFrame([(x / 8,) for x in range(12)], "abs_ita_shift double")
    gates = {"min_detection_rate": 0.95, "min_pair_order_accuracy": 0.9, "min_median_pair_gap_ita": 8.0, "max_median_abs_ita_shift": 2.0, "max_p95_abs_ita_shift": 5.0}
    row = validation.validation_summary(pairs, shifts, gates).first()
    # 31 of the 32 published gaps are positive; their published median.
    assert row.pair_order_accuracy == 0.96875 and row.median_pair_gap_ita == pytest.approx(16.66920866111137)
    assert row.passed and row.detection_rate == 1.0
    strict = validation.validation_summary(pairs, shifts, gates | {"min_pair_order_accuracy": 0.98}).first()
    assert not strict.passed and not strict.pair_order_accuracy_ok


def vectors(spark, rows, schema="a array<double>, b array<double>"):
    return spark.createDataFrame(rows, schema)


def test_paired_direction_and_its_contracts(spark):
    pairs = vectors(spark, [([1.0] * 16, [3.0] * 16), ([5.0] * 16, [7.0] * 16)])
    assert d.paired_direction(d.require_pairs(pairs)).first().vector == [2.0] * 16
    assert np.linalg.norm(d.paired_direction(pairs, normalize=True).first().vector) == pytest.approx(1.0)
    for bad in ([([1.0], None)], [([1.0], [1.0, 2.0])], [([1.0], [float("nan")])], []):
        with pytest.raises(ContractViolation):
            d.require_pairs(vectors(spark, bad))


def test_mask_is_one_in_the_middle(spark):
    rows = d.center_mask(spark.range(1), 5, 5, edge=0.1).collect()
    weight = {(r.y, r.x): r.weight for r in rows}
    assert weight[(2, 2)] == pytest.approx(1.0) and 0.1 <= weight[(0, 0)] < 0.12
    assert max(weight.values()) == weight[(2, 2)]


def test_resize_keeps_a_constant_and_matches_bilinear(spark):
    df = vectors(spark, [([3.0] * 8, [float(i) for i in range(4)])])
    same, ramp = df.select(v.resize_grid("a", 2, 2, 2, 3, 5), v.resize_grid("b", 1, 2, 2, 4, 4)).first()
    assert same == pytest.approx([3.0] * 30)
    edge = [0.0, 0.25, 0.75, 1.0]
    assert ramp == pytest.approx([2 * y + x for y in edge for x in edge])


def test_slerp_falls_back_to_a_line(spark):
    df = vectors(spark, [([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])])
    rows = steering.interpolate(df, "a", "b", 3, "spherical").where("step = 1").collect()
    assert rows[0].vector == pytest.approx([np.sqrt(0.5)] * 2) and rows[1].vector == pytest.approx([1.5, 1.5])


def test_constrained_takes_the_last_step_unchecked(spark):
    df = vectors(spark, [([0.0], [0.0])])
    direction = vectors(spark, [([1.0], None)]).select(F.col("a").alias("vector"))
    never = steering.constrained(df, "a", direction, 2.0, lambda z, m: F.lit(False)).first()
    assert never.step == 50 and never.a[0] == pytest.approx(2.0 * 0.9**50)
    once = steering.constrained(df, "a", direction, 2.0, lambda z, m: F.get(m, F.lit(0)) < 1.7).first()
    assert once.step == 2


def test_best_alpha_default_and_ties(spark):
    df = vectors(spark, [([0.0], [0.0])])
    direction = vectors(spark, [([1.0], None)]).select(F.col("a").alias("vector"))
    nothing = steering.best_alpha(df, "a", direction, lambda m: F.lit(float("nan"))).first()
    assert nothing.best_alpha == 0.0
    first = steering.best_alpha(df, "a", direction, lambda m: F.lit(1.0)).first()
    assert first.best_alpha == -3.0


def test_rescale_leaves_a_null_vector(spark):
    df = vectors(spark, [([0.0, 0.0], [3.0, 4.0])])
    zero, long = df.select(v.rescale("a", 2.0), v.rescale("b", 10.0)).first()
    assert zero == [0.0, 0.0] and long == pytest.approx([6.0, 8.0])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 5))
    x[:, 2] += 2.5 * y
    x[:, 4] += 0.8 * y
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "e array<double>, y int")
    return df, x, y


def test_logistic_per_position_is_the_optimum(labelled):
    df, x, y = labelled
    rows = {r.pos: r for r in disentangle.logistic_by_position(df, "e", "y").collect()}
    for j in range(5):
        w, b = rows[j].weight, rows[j].bias
        p = 1 / (1 + np.exp(-(w * x[:, j] + b)))
        assert abs(((p - y) * x[:, j]).sum() + w) < 1e-6 and abs((p - y).sum()) < 1e-6
        assert rows[j].accuracy == pytest.approx(((w * x[:, j] + b > 0) == y).mean())
    best = sorted((r.accuracy for r in rows.values()), reverse=True)
    assert disentangle.sap(df, "e", "y").first().sap == pytest.approx(best[0] - best[1])


def test_mutual_information_equals_histograms(labelled):
    df, x, y = labelled
    got = {r.pos: r.mi for r in disentangle.mutual_information(df, "e", "y").collect()}
    for j in range(5):
        ids = np.digitize(x[:, j], np.linspace(x[:, j].min(), x[:, j].max(), 20))
        table = np.histogram2d(ids, y, bins=(len(np.unique(ids)), 2))[0] / len(y)
        outer = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True)
        mi = (table[table > 0] * np.log(table[table > 0] / outer[table > 0])).sum()
        assert got[j] == pytest.approx(mi)


def test_scores_become_null_when_undefined(spark):
    df = spark.createDataFrame([([float(i), float(-i)], 0) for i in range(10)], "e array<double>, y int")
    got = {r.score: r.value for r in disentangle.disentanglement(df, "e", "y", trees=2).collect()}
    assert got["sap"] is None and got["mig"] == 0.0


def test_pca_direction_finds_the_separating_axis(labelled):
    df, x, y = labelled
    row = d.pca_direction(df, "e", "y", 5).first()
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2]
    best = max(range(5), key=lambda i: abs(np.corrcoef(centred @ axes[i], y)[0, 1]))
    assert abs(np.dot(row.vector, axes[best])) == pytest.approx(1.0, abs=1e-6)


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, e array<double>")
    parts = d.decompose(df, "k", "e", (3, 2, 4), 3).collect()
    assert len(parts) == 9 and {p.part_label for p in parts} == {"primary", "secondary", "tertiary"}
    for k, e in rows:
        mine = [p for p in parts if p.k == k]
        assert np.sum([p.vector for p in mine], axis=0) == pytest.approx(e)
        assert np.dot(mine[0].vector, mine[1].vector) == pytest.approx(0.0, abs=1e-9)


def test_split_half_of_equal_pairs_is_perfect(spark):
    pairs = spark.createDataFrame([(i, [0.0] * 16, [1.0 + j for j in range(16)]) for i in range(20)], "i bigint, a array<double>, b array<double>")
    rows = split_half(pairs, [4, 8], 20, n_pairs=20).collect()
    assert len(rows) == 40 and all(r.raw_cosine == pytest.approx(1.0) and r.norm_agreement == pytest.approx(1.0) for r in rows)
    with pytest.raises(ValueError):
        split_half(pairs, [11], 20, n_pairs=20)


def test_largest_confident_box(spark):
    rows = [(1, 0.0, 0.0, 9.0, 9.0, 0.5, 0), (1, 1.5, 2.5, 6.2, 6.2, 0.95, 1), (1, 0.0, 0.0, 2.0, 2.0, 0.99, 2), (2, 0.0, 0.0, 1.0, 1.0, 0.1, 0)]
    df = spark.createDataFrame(rows, "image int, x0 double, y0 double, x1 double, y1 double, confidence double, seq int")
    got = geo.largest_box(df, "image").collect()
    assert [tuple(r)[:5] for r in got] == [(1, 2, 2, 4, 4)]


def _softmax_newton(x, y, many, rounds=60):
    """One position by itself, with dense matrices."""
    t = np.zeros((2, many))
    one_hot = np.eye(many)[y]
    f = np.stack([x, np.ones_like(x)])
    for _ in range(rounds):
        z = np.exp(f.T @ t - (f.T @ t).max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        g = f @ (p - one_hot) + np.stack([t[0], np.zeros(many)])
        h = np.einsum("an,bn,ncd->acbd", f, f, p[:, :, None] * np.eye(many) - p[:, :, None] * p[:, None, :]).reshape(2 * many, -1)
        h[:many, :many] += np.eye(many)
        t = t - (np.linalg.pinv(h) @ g.ravel()).reshape(2, many)
    return t, ((f.T @ t).argmax(axis=1) == y).mean()


def test_softmax_of_all_positions_equals_one_by_one(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 5, 240)
    x = rng.normal(size=(240, 4)) + np.stack([y * 0.8, np.zeros(240), -y * 0.3, (y == 2) * 2.0], axis=1)
    names = ["k", "b", "a", "z", "q"]
    df = spark.createDataFrame([(r.tolist(), names[c]) for r, c in zip(x, y)], "e array<double>, c string")
    order = sorted(names)
    codes = np.array([order.index(names[c]) for c in y])
    accuracies = []
    for r in disentangle.softmax_by_position(df.repartition(5), "e", "c").orderBy("pos").collect():
        t, accuracy = _softmax_newton(x[:, r.pos], codes, 5)
        assert r.weights == pytest.approx(t[0], abs=1e-6)
        assert np.array(r.biases) - np.mean(r.biases) == pytest.approx(t[1] - t[1].mean(), abs=1e-6)
        assert r.accuracy == pytest.approx(accuracy)
        accuracies.append(accuracy)
    best = sorted(accuracies)
    assert disentangle.sap(df, "e", "c").first().sap == pytest.approx(best[-1] - best[-2])
    with pytest.raises(ValueError):
        disentangle.sap(df.where("c = 'a'"), "e", "c")


def _dci_by_hand(df, classes):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector("e").alias("features"), F.col("y").cast("double").alias("label"))
    kind = GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.1, seed=42, cacheNodeIds=True) if classes == 2 else RandomForestClassifier(numTrees=4, maxDepth=3, seed=42)
    model = kind.fit(rows)
    weight = model.featureImportances.toArray()
    p = weight / weight.sum()
    needed = int((np.cumsum(np.sort(weight)[::-1]) < 0.99 * weight.sum()).sum()) + 1
    right = model.transform(rows).where("prediction = label").count() / rows.count()
    return [1 + (p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(p) + 1e-8), 1 - needed / len(p), right]


@pytest.mark.parametrize("classes", [2, 3])
def test_all_scores_follow_from_importances_and_accuracies(spark, labelled, classes):
    df = labelled[0] if classes == 2 else labelled[0].withColumn("y", F.when(F.get("e", 1) > 0.6, 2).otherwise(F.col("y")))
    df = df.coalesce(1).persist()
    one = disentangle.dci(df, "e", "y", trees=4).first()
    assert list(one) == pytest.approx(_dci_by_hand(df, classes))
    got = {r.score: r.value for r in disentangle.disentanglement(df, "e", "y", trees=4).collect()}
    assert [got[c] for c in ("disentanglement", "completeness", "informativeness")] == pytest.approx(list(one))
    assert got["sap"] == pytest.approx(disentangle.sap(df, "e", "y").first().sap) and got["mig"] == pytest.approx(disentangle.mig(df, "e", "y").first().mig)
    df.unpersist()


CHECKS = {
    "v19_sap_classes": "test_softmax_of_all_positions_equals_one_by_one",
    "v21_dci": "test_all_scores_follow_from_importances_and_accuracies",
    "v22_disentanglement": "test_all_scores_follow_from_importances_and_accuracies",
}


def joins_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d1_white_normalize", "d2_measure_colour", "d4_background_ssim", "x13_colour_change", "x17_ellipse_mask", "a9_pair_measures"])
def test_no_side_of_a_pixel_join_goes_through_the_driver(spark, name):
    from effectlab.plans.catalog import PLANS

    plan = joins_of(PLANS[name].build(spark, "/root/testdata/sf0.001"))
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_few_rows_of_a_file_are_dealt_before_they_become_pixels(spark):
    from effectlab.plans import fixtures

    px = fixtures.pixels_a(spark, "/root/testdata/sf0.001")
    assert px.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    # Pictures stay whole in a task, so that grouping them moves no pixel.
    assert joins_of(px.groupBy("image_id").count()).count("Exchange") == 1


def test_pictures_of_one_image_share_its_box(spark):
    px, face = solid(spark, 7, 118, (180, 150, 130)), box(spark, 7, 9, 9, 100, 100)
    both = images.apply_gain(px, {"one": (1.0, 1.0, 1.0), "half": (0.5, 0.5, 0.5)})
    got = {r.perturbation: r for r in images.measure_colour(both, face, 118, 118, 80, by=("image_id", "perturbation")).collect()}
    for name, gain in (("one", 1.0), ("half", 0.5)):
        alone = images.measure_colour(images.apply_gain(px, {"g": (gain,) * 3}), face, 118, 118, 80).first()
        assert (got[name].pixel_count, got[name].lab_l) == (alone.pixel_count, alone.lab_l)


def test_a_window_sums_the_square_also_over_gaps_and_strips(spark):
    cells = [(x, y) for x in range(9) for y in range(11) if (x, y) not in {(3, 4), (4, 4), (8, 10)}]
    px = spark.createDataFrame([(1, x, y, x + 10 * y, 0.5 * x) for x, y in cells], "image_id int, x int, y int, r int, q double")
    for rows in (256, 2):
        got = {(r.x, r.y): (r.window_n, r.r, r.q) for r in images.uniform_window(px, ["r", "q"], 5, strip_rows=rows).collect()}
        near = {(x, y): [(u, v) for u, v in cells if abs(u - x) <= 2 and abs(v - y) <= 2] for x, y in cells}
        assert got == {k: (len(n), sum(u + 10 * v for u, v in n), sum(0.5 * u for u, _ in n)) for k, n in near.items()}


def test_images_of_is_the_inverse_of_pixels_of(spark):
    from effectlab.sources.images import images_of, pixels_of

    rows = [(i, x, y, 40 * i + x, 7 * y, x + y) for i in (1, 2) for x in range(5) for y in range(3)]
    px = spark.createDataFrame(rows, "image_id bigint, x int, y int, r int, g int, b int")
    assert sorted(tuple(r) for r in pixels_of(images_of(px, 5, 3)).collect()) == sorted(rows)


def test_a_task_keeps_only_the_least_draws_of_a_resample(spark):
    from effectlab.functions.rng import draws
    from effectlab.operators.stability import _least

    n, seed = 30_000, 5
    kept = _least(spark.range(0, n, 1, 3).withColumnRenamed("id", "i"), "i", [2, 4], 20, seed)
    rows = kept.collect()
    assert len(rows) == 3 * 20 * (4 + 8)
    for count, resample in ((2, 0), (4, 19)):
        got = sorted((r._draw, r.i) for r in rows if (r.pair_count, r.resample) == (count, resample))[: 2 * count]
        drawn = draws(seed, np.array([resample]), np.arange(n), count) >> np.uint64(2)
        assert got == sorted(zip(drawn.tolist(), range(n)))[: 2 * count]
