"""Directions estimated from tables of vectors, and their structure.

A direction is one row with an array column ``vector``. It is the size of one vector, so
it may be attached to every row of a table as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.contracts import require_empty
from effectlab.functions import vector as v
from effectlab.functions.numeric import is_finite


def positions_of(df: DataFrame, by: Sequence[str], column: str | Column) -> DataFrame:
    """Long form ``(by..., pos, value)``."""
    values = F.col(column) if isinstance(column, str) else column
    return df.select(*by, F.posexplode(values).alias("pos", "value"))


def as_vector(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One array ``vector`` per group from rows ``(by..., pos, value)`` with one row per
    position; as long as one vector."""
    pairs = F.array_sort(F.array_agg(F.struct("pos", "value")))
    return long.groupBy(*by).agg(F.transform(pairs, lambda p: p["value"]).alias("vector"))


def paired_direction(
    pairs: DataFrame, a: str = "a", b: str = "b", grid: tuple[int, int] | None = None,
    mask: dict | None = None, normalize: bool = False,
) -> DataFrame:
    """Mean of ``b - a`` over pairs, optionally masked on a (H, W) grid and scaled."""
    difference = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    mean = positions_of(pairs, [], difference).groupBy("pos").agg(F.avg("value").alias("value"))
    out = as_vector(mean)
    if mask is not None:
        out = out.select(v.masked("vector", *grid, **mask).alias("vector"))
    return out.select(v.unit_length("vector").alias("vector")) if normalize else out


def pair_problems(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(problem, n)`` for what makes a paired direction undefined: no pairs, a pair
    with one side, vectors of different length, a non-finite component."""
    bad = F.exists(F.concat(v.doubles(a), v.doubles(b)), lambda x: ~is_finite(x))
    facts = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias("one_sided"),
        F.min(F.least(F.size(a), F.size(b))).alias("shortest"),
        F.max(F.greatest(F.size(a), F.size(b))).alias("longest"),
        F.count_if(bad).alias("not_finite"),
    )
    lines = [
        ("no_pairs", F.when(F.col("n") == 0, 1).otherwise(0)),
        ("one_sided", F.col("one_sided")),
        ("unequal_length", F.when(F.col("shortest") < F.col("longest"), 1).otherwise(0)),
        ("not_finite", F.col("not_finite")),
    ]
    rows = [F.struct(F.lit(name).alias("problem"), n.cast("bigint").alias("n")) for name, n in lines]
    return facts.select(F.inline(F.array(*rows))).where("n > 0")


def require_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs, once they are known to define a direction."""
    require_empty(pair_problems(pairs, a, b), "pairs do not define a direction")
    return pairs


def _group_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    long = positions_of(df, [label], vector)
    value = F.col("value").cast("double")
    return long.groupBy("pos").agg(
        F.avg(F.when(F.col(label) == 0, value)).alias("mean_a"), F.avg(F.when(F.col(label) == 1, value)).alias("mean_b")
    )


def group_direction(df: DataFrame, vector: str, label: str, normalize: bool = True) -> DataFrame:
    """Difference of group means (label 1 minus label 0)."""
    means = _group_means(df, vector, label).select("pos", (F.col("mean_b") - F.col("mean_a")).alias("value"))
    out = as_vector(means)
    return out.select(v.unit_length("vector").alias("vector")) if normalize else out


def latent_diagnostic(df: DataFrame, vector: str, label: str, least_norm: float = 10.0) -> DataFrame:
    """Mean and deviation of the group-mean vectors and of their difference, its norm,
    and a warning when the groups hardly differ."""
    m = _group_means(df, vector, label).withColumn("diff", F.col("mean_b") - F.col("mean_a"))
    out = m.agg(
        F.avg("mean_a").alias("mean_a"), F.stddev_samp("mean_a").alias("std_a"),
        F.avg("mean_b").alias("mean_b"), F.stddev_samp("mean_b").alias("std_b"),
        F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("std_diff"),
        F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("norm_diff"),
    )
    return out.withColumn("too_similar", F.col("norm_diff") < least_norm)


def latent_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per position."""
    value = F.col("value").cast("double")
    return positions_of(df, [], vector).groupBy("pos").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def clip_range(df: DataFrame, vector: str, stats: DataFrame, k: float = 3.0) -> DataFrame:
    """Components clipped to mean +- k deviations of their position."""
    low = as_vector(stats.select("pos", (F.col("mean") - F.lit(k) * F.col("std")).alias("value")))
    high = as_vector(stats.select("pos", (F.col("mean") + F.lit(k) * F.col("std")).alias("value")))
    bounded = df.withColumn("_low", low.scalar()).withColumn("_high", high.scalar())
    clip = lambda x, i: F.least(F.greatest(x.cast("double"), F.get("_low", i)), F.get("_high", i))
    return bounded.withColumn(vector, F.transform(vector, clip)).drop("_low", "_high")


def spatial_pattern(df: DataFrame, key: str, vector: str, height: int, width: int) -> DataFrame:
    """Per vector: energy of each channel, mean energy of each grid cell, total norm;
    rows ``(key, part, i, j, value)``."""
    cell = height * width
    square = F.col("value").cast("double") * F.col("value").cast("double")
    long = positions_of(df, [key], vector).select(
        key, F.floor(F.col("pos") / cell).alias("c"),
        F.floor(F.pmod("pos", F.lit(cell)) / width).alias("y"), F.pmod("pos", F.lit(width)).cast("bigint").alias("x"), square.alias("e"),
    )
    none = F.lit(None).cast("bigint")
    channels = long.groupBy(key, "c").agg(F.sum("e").alias("value")).select(key, F.lit("channel").alias("part"), F.col("c").alias("i"), none.alias("j"), "value")
    cells = long.groupBy(key, "y", "x").agg(F.avg("e").alias("value")).select(key, F.lit("cell").alias("part"), F.col("y").alias("i"), F.col("x").alias("j"), "value")
    norms = df.select(key, F.lit("norm").alias("part"), none.alias("i"), none.alias("j"), v.norm(vector).alias("value"))
    return channels.unionByName(cells).unionByName(norms)


def apply_mask(df: DataFrame, key: str, vector: str, weights: DataFrame, height: int, width: int) -> DataFrame:
    """Long form of every vector times the weight ``(y, x, weight)`` of its grid cell."""
    at = F.pmod("pos", F.lit(height * width))
    long = positions_of(df, [key], vector).withColumns({"y": F.floor(at / width), "x": F.pmod(at, F.lit(width)).cast("bigint")})
    return long.join(weights, ["y", "x"]).select(key, "pos", (F.col("value").cast("double") * F.col("weight")).alias("value"))


def center_mask(df: DataFrame, height: int, width: int, **mask) -> DataFrame:
    """The grid ``(y, x, weight)`` as a table, once (``df`` gives the session)."""
    cells = df.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("y"), F.pmod("id", F.lit(width)).alias("x"))
    return cells.select("y", "x", v.mask_weight(F.col("y"), F.col("x"), height, width, **mask).alias("weight"))


def _dense(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _times_covariance(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The scatter matrix of the rows (column ``x``) times a d x k block, without the matrix:
    each task adds up x (x . block) over its rows, centred, and Spark adds the columns."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((mean, block))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, wanted = shared.value
        total = np.zeros_like(wanted)
        for batch in batches:
            if batch.num_rows:
                x = _dense(batch.column(0)) - centre
                total += x.T @ (x @ wanted)
        columns = [total[:, j].tobytes() for j in range(total.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array(columns, pa.binary())], ["j", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum(sorted((np.frombuffer(p) for p in table.column("part").to_pylist()), key=lambda part: part.tobytes()), axis=0)
        return pa.Table.from_arrays([table.column("j").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], ["j", "part"])

    kind = "j int, part binary"
    summed = rows.select("x").mapInArrow(partial, kind).groupBy("j").applyInArrow(add, kind).collect()  # k vectors
    shared.destroy()
    return np.stack([np.frombuffer(r["part"]) for r in sorted(summed, key=lambda r: r["j"])], axis=1)


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None, least: float = 1e-10) -> np.ndarray:
    """The directions of a d x k block outside of ``against``, from the k x k Gram matrix."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):  # the second pass takes away what rounding left
        if against is not None:
            block = block - against @ (against.T @ block)
        value, turn = np.linalg.eigh(block.T @ block)
        kept = value > (least * max(size, 1e-300)) ** 2
        block = block @ (turn[:, kept] / np.sqrt(value[kept]))
        size = 1.0
    return block


def principal_components(rows: DataFrame, k: int, tolerance: float = 1e-9, rounds: int = 40, depth: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, d x k vectors, residual) of the covariance of rows of vectors (column ``x``).

    Block power iteration whose last ``depth`` blocks are kept as a basis, in which the
    small eigenproblem is solved; the best 2 k or so go into the next round. The state is
    ``depth`` blocks of vectors; every step is one pass over the rows. The residual is
    the largest |C v - value v| over the largest value.
    """
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    means = dict(positions_of(rows, [], "x").groupBy("pos").agg(F.avg("value").alias("m")).collect())
    mean = np.array([means[i] for i in range(width or 0)])
    k = min(k, width or 0)
    if not k or n < 2:
        return np.zeros(k), np.eye(width or 0)[:, :k], 0.0
    wide = min(width, k + max(k, 8))
    block = _orthonormal(np.random.default_rng(seed).standard_normal((width, wide)))
    for _ in range(rounds):
        basis, images = [block], []
        while True:
            images.append(_times_covariance(rows, mean, basis[-1]) / (n - 1))
            fresh = _orthonormal(images[-1], np.hstack(basis)) if len(basis) < depth else block[:, :0]
            if not fresh.shape[1]:
                break
            basis.append(fresh)
        whole, image = np.hstack(basis), np.hstack(images)
        small = whole.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-value)[:wide]
        value, block, image = value[best], whole @ turn[:, best], image @ turn[:, best]
        residual = np.linalg.norm(image[:, :k] - block[:, :k] * value[:k], axis=0).max() / max(value[0], 1e-300)
        if residual < tolerance:
            break
        block = _orthonormal(block)
    vectors = block[:, :k]
    # A component's sign is free: its largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    return value[:k], vectors, float(residual)


def pca_direction(df: DataFrame, vector: str, label: str, k: int = 10) -> DataFrame:
    """The principal component that goes most with a binary label, at unit length:
    ``component, correlation, residual, vector``.

    Rows without a vector or label are left out. Nothing as large as the covariance matrix
    is made (:func:`principal_components`).
    """
    rows = df.select(v.doubles(vector).alias("x"), F.col(label).cast("double").alias("y")).where("x is not null and y is not null")
    _, components, residual = principal_components(rows, k)
    # A correlation does not change when the data are centred, so raw scores will do.
    table = F.array(*[F.lit(i) for i in range(components.shape[1])])
    axes = df.sparkSession.createDataFrame([(components.T.tolist(),)], "axes array<array<double>>")
    dot = lambda j: F.aggregate(F.zip_with("x", F.get("_axes", j), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    scores = rows.withColumn("_axes", axes.scalar()).select("y", F.posexplode(F.transform(table, dot)).alias("pos", "s"))
    found = scores.groupBy("pos").agg(F.covar_samp("s", "y").alias("cov"), F.stddev_samp("s").alias("sx"), F.stddev_samp("y").alias("sy"))
    ranked = found.select("pos", F.abs(F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))).alias("r")).where("r is not null")
    best = ranked.agg(F.max_by("pos", F.struct("r", -F.col("pos"))).alias("pos"), F.max("r").alias("correlation")).first()
    chosen, correlation = (best.pos, best.correlation) if best.pos is not None else (0, 0.0)
    component = components[:, chosen].tolist() if components.shape[1] else []
    one = df.sparkSession.createDataFrame([(int(chosen), float(correlation), residual, component)], "component int, correlation double, residual double, vector array<double>")
    return one.withColumn("vector", v.unit_length("vector"))


# Names of the leading parts of a decomposition.
PART_LABELS = ("primary", "secondary", "tertiary")


def decompose(df: DataFrame, key: str, vector: str, shape: tuple[int, int, int], parts: int = 3) -> DataFrame:
    """Orthogonal rank-1 parts of each (C, H, W) vector seen as a C x (H W) matrix,
    strongest first: ``(key, part, part_label, singular_value, vector)``.

    The vectors of a batch are decomposed together, a bounded number of cells at a time. A
    null vector has no parts.
    """
    channels, height, width = shape
    cells = height * width
    rank = min(parts, channels, cells)
    step = max(1, 4_000_000 // (channels * cells * max(1, rank)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                rows = batch.slice(low, step)
                stacked = _dense(rows.column(1)).reshape(-1, channels, cells)
                u, s, vt = np.linalg.svd(stacked, full_matrices=False)
                made = np.einsum("bcr,br,brh->brch", u[:, :, :rank], s[:, :rank], vt[:, :rank])
                size = channels * cells
                offsets = pa.array(np.arange(0, made.size + 1, size, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))
                names = rows.column(0).take(pa.array(np.repeat(np.arange(len(stacked)), rank)))
                part = pa.array(np.tile(np.arange(rank, dtype=np.int32), len(stacked)))
                yield pa.RecordBatch.from_arrays([names, part, pa.array(s[:, :rank].ravel()), vectors], [key, "part", "singular_value", "vector"])

    kind = df.schema[key].dataType.simpleString()
    given = df.select(key, v.doubles(vector).alias("_v")).where("_v is not null")
    out = given.mapInArrow(split, f"`{key}` {kind}, part int, singular_value double, vector array<double>")
    labels = F.array(*[F.lit(x) for x in PART_LABELS])
    return out.withColumn("part_label", F.get(labels, F.col("part")))
