"""Vector columns: arrays of numbers, accumulated in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from effectlab.functions.numeric import as_col

EPSILON = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, also where it is used in lambdas."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column | str) -> Column:
    return F.transform(as_col(v), lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; the norms are kept away from zero."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def agreement(a: Column | str, b: Column | str) -> Column:
    """``cosine, norm_a, norm_b, norm_ratio, norm_agreement, max_abs_diff`` of a pair."""
    na, nb = norm(a), norm(b)
    gap = F.array_max(F.zip_with(as_col(a), as_col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.struct(
        cosine(a, b).alias("cosine"), na.alias("norm_a"), nb.alias("norm_b"),
        F.try_divide(nb, na).alias("norm_ratio"),
        F.try_divide(F.least(na, nb), F.greatest(na, nb)).alias("norm_agreement"),
        gap.alias("max_abs_diff"),
    )


def add_scaled(z: Column | str, v: Column | str, alpha: Column) -> Column:
    """``z + alpha * v``."""
    return F.zip_with(as_col(z), as_col(v), lambda x, y: x.cast("double") + alpha * y.cast("double"))


def scaled(v: Column | str, factor: Column) -> Column:
    return F.transform(as_col(v), lambda x: x.cast("double") * factor)


def unit_length(v: Column | str) -> Column:
    """``v / (norm + 1e-8)``."""
    return let(doubles(v), lambda d: let(norm(d) + EPSILON, lambda n: F.transform(d, lambda x: x / n)))


def rescale(v: Column | str, magnitude: float) -> Column:
    """``v`` at the given norm; a vector of (almost) no length stays as it is."""
    return let(
        doubles(v),
        lambda d: let(norm(d), lambda n: F.when(n < EPSILON, d).otherwise(F.transform(d, lambda x: x * (F.lit(magnitude) / n)))),
    )


def mask_weight(
    y: Column, x: Column, height: int, width: int,
    center: float = 1.0, edge: float = 0.1, falloff: str = "gaussian", radius: float = 0.6,
) -> Column:
    """Weight of grid cell (y, x): ``center`` in the middle of the grid, falling to
    ``edge``, over coordinates from -1 to 1."""

    def coordinate(i: Column, n: int) -> Column:
        return F.lit(-1.0) + i * F.lit(2.0 / (n - 1)) if n > 1 else F.lit(-1.0)

    cy, cx = coordinate(y, height), coordinate(x, width)
    distance = F.sqrt(cx * cx + cy * cy)
    if falloff == "gaussian":
        shape = F.exp(F.lit(-3.0) * F.pow(distance / F.lit(radius), F.lit(2.0)))
    elif falloff == "hard":
        shape = F.when(distance <= radius, 1.0).otherwise(0.0)
    elif falloff == "linear":
        shape = F.lit(1.0) - F.least(F.greatest(distance / F.lit(radius), F.lit(0.0)), F.lit(1.0))
    else:
        raise ValueError("falloff must be gaussian, hard or linear")
    return F.lit(edge) + F.lit(center - edge) * shape


def masked(v: Column | str, height: int, width: int, **mask) -> Column:
    """A (C, H, W) vector with every channel weighted by the centre mask."""
    cell = height * width

    def weight(x: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(cell))
        return x.cast("double") * mask_weight(F.floor(at / width), F.pmod(at, F.lit(width)), height, width, **mask)

    return F.transform(as_col(v), weight)


def resize_grid(v: Column | str, channels: int, height: int, width: int, new_height: int, new_width: int) -> Column:
    """Bilinear resize of a (C, H, W) vector with half-pixel centres."""

    def axis(target: Column, size: int, new: int) -> tuple[Column, Column, Column]:
        at = F.greatest((target + 0.5) * F.lit(size / new) - 0.5, F.lit(0.0))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(size - 1)), at - low

    def cell(values: Column, k: Column) -> Column:
        c = F.floor(k / (new_height * new_width)).cast("int")
        rest = F.pmod(k, F.lit(new_height * new_width))
        y0, y1, fy = axis(F.floor(rest / new_width), height, new_height)
        x0, x1, fx = axis(F.pmod(rest, F.lit(new_width)), width, new_width)

        def value(y: Column, x: Column) -> Column:
            return F.get(values, (c * height + y) * width + x)

        top = value(y0, x0) * (1 - fx) + value(y0, x1) * fx
        bottom = value(y1, x0) * (1 - fx) + value(y1, x1) * fx
        return top * (1 - fy) + bottom * fy

    cells = F.sequence(F.lit(0), F.lit(channels * new_height * new_width - 1))
    return let(doubles(v), lambda values: F.transform(cells, lambda k: cell(values, k)))


def interpolate(a: Column | str, b: Column | str, t: Column, kind: str = "linear") -> Column:
    """The point at ``t`` between two vectors, along a line or an arc."""
    if kind == "linear":
        return F.zip_with(as_col(a), as_col(b), lambda x, y: (1 - t) * x.cast("double") + t * y.cast("double"))
    if kind != "spherical":
        raise ValueError("kind must be linear or spherical")
    closeness = dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))
    angle = F.acos(F.least(F.greatest(closeness, F.lit(-1.0)), F.lit(1.0)))

    def weights(theta: Column) -> Column:
        flat = F.sin(theta) < 1e-6
        wa = F.when(flat, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * theta), F.sin(theta)))
        wb = F.when(flat, t).otherwise(F.try_divide(F.sin(t * theta), F.sin(theta)))
        return F.struct(wa.alias("a"), wb.alias("b"))

    return let(
        let(angle, weights),
        lambda w: F.zip_with(as_col(a), as_col(b), lambda x, y: w["a"] * x.cast("double") + w["b"] * y.cast("double")),
    )
