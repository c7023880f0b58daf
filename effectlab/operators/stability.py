"""Split-half stability of a paired direction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from effectlab.functions.rng import draws
from effectlab.operators.directions import paired_direction


def _weights(height: int, width: int, center: float, edge: float, radius: float) -> np.ndarray:
    y, x = np.meshgrid(np.linspace(-1, 1, height), np.linspace(-1, 1, width), indexing="ij")
    return edge + (center - edge) * np.exp(-3.0 * (x * x + y * y) / radius**2)


# Draws that a task makes at a time.
_CELLS = 1 << 18


def _least(keys: DataFrame, key: str, counts: Sequence[int], resamples: int, seed: int) -> DataFrame:
    """``key, pair_count, resample, _draw``: of the keys of each task the ``2 * count`` with the
    least draws of each resample. A task holds no more than those and one slice of draws."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: [np.empty(0, np.int64) for _ in range(3)] for c in counts}
        # The draw that a key has to be below or at to be among the least of a resample.
        limit = {c: np.full(resamples, np.iinfo(np.int64).max) for c in counts}
        step = max(1, _CELLS // resamples)
        for batch in batches:
            items = batch.column(0).to_numpy()
            for at in range(0, len(items), step):
                part = items[at : at + step]
                for c in counts:
                    drawn = (draws(seed, np.arange(resamples)[:, None], part[None, :], c) >> np.uint64(2)).astype(np.int64)
                    resample, place = np.nonzero(drawn <= limit[c][:, None])
                    new = (resample, drawn[resample, place], part[place])
                    rep, draw, item = (np.concatenate(pair) for pair in zip(held[c], new))
                    order = np.lexsort((item, draw, rep))
                    rep, draw, item = rep[order], draw[order], item[order]
                    rank = np.arange(len(rep)) - np.searchsorted(rep, rep)
                    limit[c][rep[rank == 2 * c - 1]] = draw[rank == 2 * c - 1]
                    held[c] = [v[rank < 2 * c] for v in (rep, draw, item)]
        for c, (rep, draw, item) in held.items():
            cells = [pa.array(item, pa.int64()), pa.array(np.full(len(rep), c, np.int32)), pa.array(rep.astype(np.int32)), pa.array(draw, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, [key, "pair_count", "resample", "_draw"])

    return keys.mapInArrow(choose, f"`{key}` bigint, pair_count int, resample int, _draw bigint")


def split_half(
    pairs: DataFrame,
    counts: Sequence[int],
    resamples: int = 200,
    seed: int = 20260816,
    grid: tuple[int, int] = (4, 4),
    center: float = 1.0,
    edge: float = 0.3,
    radius: float = 1.0,
    key: str = "i",
    n_pairs: int | None = None,
) -> DataFrame:
    """Agreement of directions from disjoint random halves of ``count`` pairs each.

    Each resample orders the pairs by a draw and takes the first ``2 * count``. Every task
    keeps only that many keys per resample while it reads; a group then holds ``2 * count`` vectors, a parameter and not the data size.
    """
    counts = sorted(set(int(c) for c in counts))
    if resamples < 20:
        raise ValueError("split-half stability needs at least 20 resamples")
    if not counts or counts[0] < 2 or (n_pairs is not None and 2 * counts[-1] > n_pairs):
        raise ValueError("pair counts must be at least 2 and at most half of the pairs")
    full = np.asarray(paired_direction(pairs).first().vector, dtype=float)
    weights = np.tile(_weights(*grid, center, edge, radius).ravel(), len(full) // (grid[0] * grid[1]))

    # Only keys are drawn and ranked; the vectors join the chosen few afterwards.
    order = W.Window.partitionBy("pair_count", "resample").orderBy("_draw", key)
    ranked = (
        _least(pairs.select(F.col(key).cast("bigint").alias(key)), key, counts, resamples, seed)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= 2 * F.col("pair_count"))
        .drop("_draw")
    )
    differences = pairs.select(key, F.zip_with("a", "b", lambda x, y: y.cast("double") - x.cast("double")).alias("d"))
    ranked = ranked.join(differences, key)

    def cosine(p: np.ndarray, q: np.ndarray) -> float:
        return float(p @ q / (max(np.linalg.norm(p), 1e-8) * max(np.linalg.norm(q), 1e-8)))

    def halves(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_rank")
        vectors = np.vstack(frame["d"].to_numpy())
        left, right = vectors[: name[0]].mean(axis=0), vectors[name[0] :].mean(axis=0)
        norms = sorted((float(np.linalg.norm(left)), float(np.linalg.norm(right))))
        return pd.DataFrame(
            [[
                *name, cosine(left, right), cosine(left * weights, right * weights),
                norms[0] / norms[1] if norms[1] else float("nan"), cosine(left, full), cosine(right, full),
            ]],
            columns=["pair_count", "resample", "raw_cosine", "masked_cosine", "norm_agreement", "left_to_full_cosine", "right_to_full_cosine"],
        )

    return ranked.groupBy("pair_count", "resample").applyInPandas(
        halves,
        "pair_count int, resample int, raw_cosine double, masked_cosine double, norm_agreement double,"
        " left_to_full_cosine double, right_to_full_cosine double",
    )
