"""Steering: moving vectors along directions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions import vector as v
from effectlab.operators.directions import as_vector, positions_of


def _attached(df: DataFrame, direction: DataFrame) -> DataFrame:
    """``_v``: the direction (one row, one vector long) beside every row."""
    return df.withColumn("_v", direction.select("vector").scalar())


def sweep(df: DataFrame, vector: str, direction: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``z + alpha * v`` for every row and every alpha."""
    listed = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    moved = _attached(df, direction).select("*", listed)
    return moved.withColumn(vector, v.add_scaled(vector, "_v", F.col("alpha"))).drop("_v")


def apply_vector(df: DataFrame, vector: str, direction: DataFrame, alpha: float = 1.0) -> DataFrame:
    return sweep(df, vector, direction, [alpha]).drop("alpha")


def apply_vectors(df: DataFrame, vector: str, directions: DataFrame, alphas: Mapping[str, float]) -> DataFrame:
    """Add several named directions ``(name, vector)``; a name without an alpha has 1."""
    pairs = [x for name, a in alphas.items() for x in (F.lit(name), F.lit(float(a)))]
    alpha = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("name")), F.lit(1.0)) if pairs else F.lit(1.0)
    scaled = directions.select(v.scaled("vector", alpha).alias("s"))
    combined = as_vector(positions_of(scaled, [], "s").groupBy("pos").agg(F.sum("value").alias("value")))
    return apply_vector(df, vector, combined)


def constrained(
    df: DataFrame, vector: str, direction: DataFrame, alpha: float,
    predicate: Callable[[Column, Column], Column], steps: int = 50, shrink: float = 0.9,
) -> DataFrame:
    """Shrink alpha until ``predicate(original, moved)`` holds; after ``steps`` refusals
    the next alpha is taken unchecked. Adds ``step`` and ``alpha``."""
    moved = _attached(df, direction)
    z, d = F.col(vector), F.col("_v")

    def accepted(i: Column) -> Column:
        return predicate(z, v.add_scaled(z, d, F.lit(alpha) * F.pow(F.lit(shrink), i)))

    tried = F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), accepted)
    chosen = moved.withColumn("step", F.coalesce(F.try_element_at(tried, F.lit(1)), F.lit(steps)))
    chosen = chosen.withColumn("alpha", F.lit(alpha) * F.pow(F.lit(shrink), F.col("step")))
    return chosen.withColumn(vector, v.add_scaled(vector, "_v", F.col("alpha"))).drop("_v")


def best_alpha(
    df: DataFrame, vector: str, direction: DataFrame, score: Callable[[Column], Column],
    span: tuple[float, float] = (-3.0, 3.0), samples: int = 20,
) -> DataFrame:
    """The grid alpha with the highest ``score(moved)``, the first of equals; 0 where no
    score is above minus infinity. Adds ``best_alpha`` and ``best_score``."""
    grid = F.array(*[F.lit(float(a)) for a in np.linspace(*span, samples)])
    z, d = F.col(vector), F.col("_v")

    def judged(a: Column, i: Column) -> Column:
        value = score(v.add_scaled(z, d, a)).cast("double")
        return F.struct(value.alias("score"), (-i).alias("rank"), a.alias("alpha"))

    usable = F.filter(
        F.transform(grid, judged), lambda s: s["score"].isNotNull() & ~F.isnan(s["score"]) & (s["score"] > F.lit(float("-inf")))
    )
    best = _attached(df, direction).withColumn("_best", F.array_max(usable))
    return best.select(
        *df.columns, F.coalesce(F.col("_best.alpha"), F.lit(0.0)).alias("best_alpha"), F.col("_best.score").alias("best_score")
    )


#: Vectors that a basis may have: it goes to every task.
MAX_BASIS = 1_024


def orthonormal(basis: DataFrame, order: str = "name") -> DataFrame:
    """Gram-Schmidt over the rows ``(name, vector)`` of a basis, in name order; one row
    ``basis: array<array<double>>``. More than ``MAX_BASIS`` rows are an error."""
    found = basis.orderBy(order).limit(MAX_BASIS + 1).collect()
    if len(found) > MAX_BASIS:
        raise ValueError(f"a basis has at most {MAX_BASIS} vectors")
    rows = [np.asarray(r.vector, dtype=float) for r in found]
    done: list[np.ndarray] = []
    for row in rows:
        for b in done:
            row = row - (row @ b) * b
        done.append(row / (np.linalg.norm(row) + v.EPSILON))
    return basis.sparkSession.createDataFrame([([b.tolist() for b in done],)], "basis array<array<double>>")


def project(df: DataFrame, vector: str, basis: DataFrame) -> DataFrame:
    """The part of each vector inside the span of an orthonormal basis."""
    zero = F.transform(vector, lambda _: F.lit(0.0))
    parts = F.aggregate(
        F.col("_basis"), zero,
        lambda done, b: v.let(v.dot(vector, b), lambda weight: v.add_scaled(done, b, weight)),
    )
    return df.withColumn("_basis", basis.scalar()).withColumn(vector, parts).drop("_basis")


def interpolate(df: DataFrame, a: str, b: str, steps: int = 5, kind: str = "linear") -> DataFrame:
    """``steps`` points from ``a`` to ``b``, ends included: ``step, vector``."""
    t = F.col("step") / F.lit(float(max(steps - 1, 1)))
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    return rows.withColumn("vector", v.interpolate(a, b, t, kind))
