"""Disentanglement scores of vector tables with a label."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from effectlab.functions import vector as v
from effectlab.operators.directions import as_vector, positions_of
from effectlab.operators.selection import top2_gap
from effectlab.session import written

EDGES = 20


def components_needed(importances: DataFrame, importance: str = "importance", share: float = 0.99) -> DataFrame:
    """How many of the largest importances reach ``share`` of their sum.

    The table has one row per dimension of a vector.
    """
    order = W.Window.orderBy(F.col(importance).desc(), "pos").rowsBetween(W.Window.unboundedPreceding, 0)
    everything = W.Window.partitionBy()
    running = importances.select(
        "pos", F.sum(importance).over(order).alias("_upto"), F.sum(importance).over(everything).alias("_total")
    )
    return running.agg(
        F.count(F.lit(1)).alias("n_components"),
        (F.count_if(F.col("_upto") < F.lit(share) * F.col("_total")) + 1).alias("n_needed"),
    )


def mutual_information(df: DataFrame, vector: str, label: str, edges: int = EDGES, regrid: bool = True) -> DataFrame:
    """Mutual information (nats) of each position, cut at ``edges`` even edges between
    its extremes, with the label: ``(pos, mi)``.

    With ``regrid`` the bin numbers in use are spread over as many even cells as there
    are distinct numbers, which may merge neighbours when a bin is empty.
    """
    long = positions_of(df, [], vector)
    spans = long.groupBy("pos").agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    lows = as_vector(spans.select("pos", F.col("lo").alias("value")))
    highs = as_vector(spans.select("pos", F.col("hi").alias("value")))

    def bin_of(x, i):
        lo, hi = F.get("_lo", i), F.get("_hi", i)
        step = F.floor(F.try_divide(x.cast("double") - lo, hi - lo) * (edges - 1)).cast("int") + 1
        return F.coalesce(F.least(step, F.lit(edges)), F.lit(edges))

    binned = df.withColumn("_lo", lows.scalar()).withColumn("_hi", highs.scalar()).select(
        F.col(label).alias("y"), F.posexplode(F.transform(vector, bin_of)).alias("pos", "bin")
    )
    # At most ``edges`` bins times the labels per position from here on.
    counts = binned.groupBy("pos", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    if regrid:
        for name in ("bin", "y"):
            facts = counts.groupBy("pos").agg(
                F.count_distinct(name).alias("_u"), F.min(name).alias("_a"), F.max(name).alias("_b")
            )
            at = F.floor(F.try_divide((F.col(name) - F.col("_a")) * F.col("_u"), F.col("_b") - F.col("_a")))
            cell = F.coalesce(F.least(at, F.col("_u") - 1), F.lit(0))
            counts = counts.join(facts, "pos").withColumn(name, cell).groupBy("pos", "bin", "y").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.Window.partitionBy("pos"))
    in_bin = F.sum("n").over(W.Window.partitionBy("pos", "bin"))
    in_label = F.sum("n").over(W.Window.partitionBy("pos", "y"))
    cells = counts.select("pos", F.col("n").cast("double").alias("n"), total.alias("t"), in_bin.alias("b"), in_label.alias("l"))
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("b") * F.col("l")))
    return cells.groupBy("pos").agg(F.sum(term).alias("mi"))


def mig(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Gap of the two most informative positions over the entropy of the label."""
    gap = top2_gap(mutual_information(df, vector, label), "mi")
    share = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "p", F.col("n") / F.sum("n").over(W.Window.partitionBy())
    )
    entropy = share.agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    value = F.when(F.col("_h") > 0, F.col("gap") / F.col("_h")).otherwise(0.0)
    return gap.withColumn("_h", entropy.scalar()).select(F.coalesce(value, F.lit(0.0)).alias("mig"))


def logistic_by_position(df: DataFrame, vector: str, label: str, rounds: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """One logistic regression per position (slope penalised by its square over two),
    all positions at once: ``(pos, weight, bias, accuracy)``.

    Each Newton round is one aggregate over the vectors; what returns to the driver is
    five sums per position, the state of the models. The label is 0 or 1.
    """
    spark = df.sparkSession
    rows = df.select(v.doubles(vector).alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        odd = rows.where(~F.col("y").isin(0.0, 1.0) | F.col("y").isNull()).limit(1).count()
        share, width = rows.agg(F.avg("y"), F.max(F.size("x"))).first()
        if odd or share is None or share in (0.0, 1.0):
            raise ValueError("the label must take both values 0 and 1")
        state = np.zeros((width, 2))
        state[:, 1] = np.log(share / (1 - share))
        for _ in range(rounds):
            step = _newton_step(spark, rows, state)
            state -= step
            if np.abs(step).max() < tolerance:
                break
        models = _models(spark, state)
        scored = rows.withColumn("_m", models.scalar()).select(
            "y", F.posexplode(F.transform("x", lambda x, i: F.get("_m.w", i) * x + F.get("_m.b", i))).alias("pos", "z")
        )
        right = F.avg(((F.col("z") > 0).cast("double") == F.col("y")).cast("double")).alias("accuracy")
        result = scored.groupBy("pos").agg(right).collect()  # one number per position
    finally:
        rows.unpersist()
    table = [(r.pos, float(state[r.pos, 0]), float(state[r.pos, 1]), r.accuracy) for r in result]
    return spark.createDataFrame(table, "pos int, weight double, bias double, accuracy double")


def _models(spark, state: np.ndarray) -> DataFrame:
    one = spark.createDataFrame([(state[:, 0].tolist(), state[:, 1].tolist())], "w array<double>, b array<double>")
    return one.select(F.struct("w", "b").alias("m"))


def _newton_step(spark, rows: DataFrame, state: np.ndarray) -> np.ndarray:
    cells = rows.withColumn("_m", _models(spark, state).scalar()).select(
        "y", F.posexplode(F.transform("x", lambda x, i: F.struct(x.alias("x"), (F.get("_m.w", i) * x + F.get("_m.b", i)).alias("z")))).alias("pos", "c")
    )
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("c.z")))
    cells = cells.select("pos", F.col("c.x").alias("x"), (p - F.col("y")).alias("e"), (p * (1 - p)).alias("h"))
    sums = cells.groupBy("pos").agg(
        F.sum(F.col("e") * F.col("x")), F.sum("e"), F.sum(F.col("h") * F.col("x") * F.col("x")), F.sum(F.col("h") * F.col("x")), F.sum("h")
    ).collect()
    step = np.zeros_like(state)
    for pos, gw, gb, hww, hwb, hbb in sums:
        hessian = np.array([[hww + 1.0, hwb], [hwb, hbb]])
        step[pos] = np.linalg.solve(hessian, np.array([gw + state[pos, 0], gb]))
    return step


#: Classes that a label may have: the sums of a position grow with their square.
MAX_CLASSES = 100


def label_classes(df: DataFrame, label: str) -> list:
    """The values of a label in order; an error for nulls, one value, or too many."""
    found = [r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 2).collect()]
    if None in found or not 2 <= len(found) <= MAX_CLASSES:
        raise ValueError(f"a label takes 2 to {MAX_CLASSES} values and is never null")
    return sorted(found)


def _softmax(x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Class probabilities [row, position, class] under weights and biases [2, position, class]."""
    z = x[:, :, None] * state[0] + state[1]
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(axis=2, keepdims=True)


def _class_sums(rows: DataFrame, state: np.ndarray) -> np.ndarray:
    """The gradients and the class-block Hessians of all positions: [position, sum], added up
    by each task over its rows and then by Spark in blocks of positions."""
    _, width, classes = state.shape
    upper = np.triu_indices(classes)
    size = 2 * classes + 3 * len(upper[0])
    step = max(1, 2_000_000 // (width * classes))
    chunk = max(1, 100_000 // size)
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, size))
        for batch in batches:
            given = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for low in range(0, len(given), step):
                x, y = given[low : low + step], batch.column(1).to_numpy()[low : low + step]
                p = _softmax(x, shared.value)
                curve = [p[:, :, c] * ((c == d) - p[:, :, d]) for c, d in zip(*upper)]
                p[np.arange(len(y)), :, y] -= 1.0
                total[:, :classes] += np.einsum("np,npc->pc", x, p)
                total[:, classes : 2 * classes] += p.sum(axis=0)
                for i, h in enumerate(curve):
                    at = 2 * classes + 3 * i
                    total[:, at] += (h * x * x).sum(axis=0)
                    total[:, at + 1] += (h * x).sum(axis=0)
                    total[:, at + 2] += h.sum(axis=0)
        for at in range(0, width, chunk):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + chunk].tobytes()], pa.binary())], ["at", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(part) for part in sorted(table.column("part").to_pylist())], axis=0)
        return pa.Table.from_arrays([table.column("at").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

    summed = rows.mapInArrow(partial, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").collect()
    shared.destroy()
    return np.concatenate([np.frombuffer(r["part"]).reshape(-1, size) for r in sorted(summed, key=lambda r: r["at"])])


def softmax_by_position(df: DataFrame, vector: str, label: str, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """One multinomial logistic regression per position (weights penalised by their squares
    over two), all positions at once: ``(pos, weights, biases, accuracy)`` with one weight
    and bias per class, in the order of the classes; biases add up to nothing.

    Each Newton round is one pass over the vectors. What returns to the driver is the state
    of the models: the sums of each position, whose number the classes decide.
    """
    spark = df.sparkSession
    classes = label_classes(df, label)
    many = len(classes)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = written(df.select(v.doubles(vector).alias("x"), place.cast("bigint").alias("y")).where("x is not null"), "softmax-rows")
    shares = dict(rows.groupBy("y").agg(F.count(F.lit(1))).collect())
    width = rows.agg(F.max(F.size("x"))).first()[0]
    state = np.zeros((2, width, many))
    start = np.log([shares.get(c, 0.5) for c in range(many)])
    state[1] = start - start.mean()
    upper = np.triu_indices(many)
    for _ in range(rounds):
        sums = _class_sums(rows, state)
        gradient = sums[:, : 2 * many].copy()
        gradient[:, :many] += state[0]
        hessian = np.zeros((width, 2 * many, 2 * many))
        for i, (c, d) in enumerate(zip(*upper)):
            xx, xo, oo = (sums[:, 2 * many + 3 * i + j] for j in range(3))
            for a, b in {(c, d), (d, c)}:
                hessian[:, a, b], hessian[:, many + a, many + b] = xx, oo
                hessian[:, a, many + b] = hessian[:, many + a, b] = xo
        hessian[:, range(many), range(many)] += 1.0
        # Biases may move together without effect: this holds their sum.
        hessian[:, many:, many:] += 1.0
        step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        step /= np.maximum(1.0, np.abs(step).max(axis=1, keepdims=True) / 5.0)
        state -= step.reshape(width, 2, many).transpose(1, 0, 2)
        if np.abs(step).max() < tolerance:
            break

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(width, np.int64), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column(1).to_numpy()
            for low in range(0, len(x), 1_000):
                z = x[low : low + 1_000, :, None] * state[0] + state[1]
                hits += (z.argmax(axis=2) == y[low : low + 1_000, None]).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(hits), pa.array(np.full(width, n))], ["pos", "hits", "n"])

    scored = rows.mapInArrow(right, "pos int, hits bigint, n bigint").groupBy("pos").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))
    table = [(i, state[0, i].tolist(), state[1, i].tolist()) for i in range(width)]
    models = spark.createDataFrame(table, "pos int, weights array<double>, biases array<double>")
    return models.join(scored, "pos")


def sap(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Gap of the two positions that predict the label, of any number of classes, best on
    their own."""
    classes = label_classes(df, label)
    if len(classes) == 2:
        told = df.select(vector, (F.col(label) == F.lit(classes[1])).cast("int").alias(label))
        return top2_gap(logistic_by_position(told, vector, label), "accuracy").select(F.col("gap").alias("sap"))
    return top2_gap(softmax_by_position(df, vector, label), "accuracy").select(F.col("gap").alias("sap"))


def dci(df: DataFrame, vector: str, label: str, trees: int = 100, depth: int = 3, seed: int = 42) -> DataFrame:
    """Concentration of feature importance, components needed, and accuracy of boosted
    trees (a random forest when the label has more than two values)."""
    spark = df.sparkSession
    rows = df.select(array_to_vector(v.doubles(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    classes = rows.agg(F.count_distinct("label")).first()[0]
    if classes <= 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, cacheNodeIds=True).fit(rows)
    else:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    weights = [float(x) for x in model.featureImportances.toArray()]  # one per position
    table = spark.createDataFrame(list(enumerate(weights)), "pos int, importance double")
    accuracy = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
    return dci_scores(table).withColumn("informativeness", accuracy.scalar())


def dci_scores(importances: DataFrame) -> DataFrame:
    """``disentanglement`` (one less the entropy of the shares over that of even ones) and
    ``completeness`` (the share of components that aren't needed for nearly all importance)
    of a table ``pos, importance`` with one row per position of a vector."""
    everything = W.Window.partitionBy()
    total, size = F.sum("importance").over(everything), F.count(F.lit(1)).over(everything)
    shares = importances.select(F.when(total < 1e-8, 1.0 / size).otherwise(F.col("importance") / total).alias("p"))
    entropy = shares.agg(F.coalesce(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p"))), F.lit(0.0)).alias("h"))
    return components_needed(importances).withColumn("_h", entropy.scalar()).select(
        (F.lit(1.0) - F.col("_h") / F.ln(F.col("n_components") + 1e-8)).alias("disentanglement"),
        (F.lit(1.0) - F.col("n_needed") / F.col("n_components")).alias("completeness"),
    )


def disentanglement(df: DataFrame, vector: str, label: str, trees: int = 100) -> DataFrame:
    """All scores as ``(score, value)``; one that cannot be computed is null."""
    spark = df.sparkSession

    def attempt(build: Callable[[], DataFrame], names: list[str]) -> list[tuple[str, float | None]]:
        try:
            row = build().first()
            return [(n, None if row[n] is None else float(row[n])) for n in names]
        except (ValueError, np.linalg.LinAlgError, PySparkException):
            return [(n, None) for n in names]

    rows = attempt(lambda: sap(df, vector, label), ["sap"])
    rows += attempt(lambda: mig(df, vector, label), ["mig"])
    rows += attempt(lambda: dci(df, vector, label, trees), ["disentanglement", "completeness", "informativeness"])
    return spark.createDataFrame(rows, "score string, value double")
