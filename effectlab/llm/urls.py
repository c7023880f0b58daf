"""URL filters: site rules first, then a ratio of two character language models.

Accepted and rejected URLs (those that a rule allows or blocks, each distinct URL once)
train two Markov models over bytes. The order varies: a context of up to ``ORDERS - 1``
bytes is interpolated with its shorter ones by Witten-Bell weights, so that a context
counts as much as it has been seen. The score of a URL is the difference of its
log-likelihoods over its length; the threshold between the verdicts is calibrated on
labelled URLs that the models haven't seen (one in ``HOLD_OUT`` by hash).

Contexts are hashed into ``2 ** BITS`` slots an order, so a model has a fixed size whatever
it is trained on (about 10 MB for both), and is broadcast. All counts are Spark aggregates
over all labelled URLs; tasks combine theirs before the shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no
rule; a null or empty URL scores 0; a score at the threshold is accepted; if one class has
no labels everything that no rule fits is allowed; an empty table gives no rows; other
columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.llm.words import Block, blocks, mix
from effectlab.session import written

ORDERS = 6
BITS = 17
HOLD_OUT = 5
#: Calibration looks at scores in bins of this width, in nats a byte.
BIN = 0.01


@dataclass(frozen=True)
class SiteRule:
    """``allow`` or block a host with all its subdomains, where the path starts with ``path``."""

    allow: bool
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(tail, r"(?s)^([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[SiteRule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and whether it allows; nulls where none fits."""
    name, allow = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(True))
    for rule in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = ((F.col(host) == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, allow = name.when(fits, F.lit(str(rule))), allow.when(fits, F.lit(rule.allow))
    return name, allow


def _slots(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each byte's contexts and of contexts with the byte: [order, byte]."""
    n = len(block.data)
    place = np.arange(n) - np.repeat(block.offsets[:-1], np.diff(block.offsets))
    symbol = block.data.astype(np.uint64) + np.uint64(1)
    context = np.zeros(n, np.uint64)
    slots, pairs = np.empty((ORDERS, n), np.int64), np.empty((ORDERS, n), np.int64)
    for order in range(ORDERS):
        if order:
            before = np.zeros(n, np.uint64)
            before[order:] = symbol[:-order] if n > order else 0
            before[place < order] = 0
            context = context * np.uint64(257) + before
        slot = mix(context + np.uint64(order + 1)) >> np.uint64(64 - BITS)
        slots[order] = slot.astype(np.int64) + (order << BITS)
        pairs[order] = (mix(slot * np.uint64(257) + symbol + np.uint64(order << 40)) >> np.uint64(64 - BITS)).astype(np.int64) + (order << BITS)
    return slots, pairs


_COUNTS = T.StructType([T.StructField("accepted", T.BooleanType()), T.StructField("slot", T.LongType()), T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context, context with next byte) of the URLs of each class."""
    for batch in batches:
        accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for label in (False, True):
            for block in blocks(batch.column(0).filter(pa.array(accepted == label))):
                slots, pairs = _slots(block)
                both, n = np.unique(slots.ravel() << 32 | pairs.ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(n)), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF), pa.array(n)], _COUNTS.names)


@dataclass
class Models:
    """Counts of both classes, rejected first: of pairs, of contexts, and of distinct next bytes."""

    pair: np.ndarray
    context: np.ndarray
    distinct: np.ndarray

    def scores(self, block: Block) -> np.ndarray:
        slots, pairs = _slots(block)
        sums = []
        for label in (0, 1):
            p = np.full(len(block.data), 1 / 256)
            for order in range(ORDERS):
                kinds = self.distinct[label][slots[order]].astype(float)
                seen = self.context[label][slots[order]].astype(float)
                p = np.where(seen > 0, (self.pair[label][pairs[order]] + kinds * p) / np.maximum(seen + kinds, 1), p)
            total = np.zeros(len(p) + 1)
            np.cumsum(np.log(p), out=total[1:])
            sums.append(total[block.offsets[1:]] - total[block.offsets[:-1]])
        return (sums[1] - sums[0]) / np.maximum(np.diff(block.offsets), 1)


def train(labelled: DataFrame) -> Models:
    """Both models, from distinct ``url`` with ``accepted``."""
    rows = labelled.select("url", "accepted").mapInArrow(_count, _COUNTS).groupBy("accepted", "slot", "pair").agg(F.sum("n").alias("n"))
    counts = written(rows, "url-counts")
    size = ORDERS << BITS
    models = Models(*(np.zeros((2, size), np.int32) for _ in range(3)))
    for key in ("pair", "slot"):
        got = counts.groupBy("accepted", key).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
        label, at = got["accepted"].to_numpy().astype(int), got[key].to_numpy()
        if key == "pair":
            models.pair[label, at] = got["n"]
        else:
            models.context[label, at], models.distinct[label, at] = got["n"], got["kinds"]
    return models


def score(urls: DataFrame, models: Models, url: str = "url", result: str = "score") -> DataFrame:
    """``urls`` with the length-normalised log-likelihood difference, above 0 like accepted ones."""
    urls = urls.drop(result)
    names = urls.columns
    shared = urls.sparkSession.sparkContext.broadcast((models.pair, models.context, models.distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Models(*shared.value)
        for batch in batches:
            made = [own.scores(block) for block in blocks(batch.column(names.index(url)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*made, np.zeros(0)]))], [*names, result])

    return urls.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in urls.schema), T.StructField(result, T.DoubleType())]))


def threshold(scored: DataFrame) -> float:
    """The score with the least mean error of both classes, from ``score`` and ``accepted``;
    the middle of the best scores where several are as good."""
    binned = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin"), "accepted").agg(F.count("*").alias("n")).toPandas()
    yes, no = binned[binned["accepted"]], binned[~binned["accepted"]]
    if not len(yes) or not len(no):
        return 0.0
    edges = np.arange(binned["bin"].min(), binned["bin"].max() + 2)
    lost = np.array([yes["n"][yes["bin"] < e].sum() for e in edges]) / yes["n"].sum()
    let = np.array([no["n"][no["bin"] >= e].sum() for e in edges]) / no["n"].sum()
    best = edges[np.isclose(lost + let, (lost + let).min())]
    return float(best[len(best) // 2] * BIN)


def judge(pages: DataFrame, rules: Sequence[SiteRule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block)."""
    pages = pages.drop("host", "path", "rule", "score", "verdict", "_allow")
    host, path = parts(F.col(url))
    placed = pages.withColumns({"host": host, "path": path})
    rule, allow = fitting_rule(rules)
    ruled = placed.withColumns({"rule": rule, "_allow": allow})
    labelled = written(ruled.where(F.col("_allow").isNotNull()).select(F.col(url).alias("url"), F.col("_allow").alias("accepted")).distinct(), "url-labels")
    classes = {r["accepted"] for r in labelled.select("accepted").distinct().collect()}
    if classes != {True, False}:
        judged = ruled.withColumns({"score": F.lit(0.0), "_limit": F.lit(0.0)})
    else:
        unseen = F.pmod(F.xxhash64("url"), F.lit(HOLD_OUT)) == 0
        models = train(labelled.where(~unseen))
        limit = threshold(score(labelled.where(unseen), models))
        judged = score(ruled, models, url).withColumn("_limit", F.lit(limit))
    accepted = F.coalesce("_allow", F.col("score") >= F.col("_limit"))
    return judged.withColumn("verdict", F.when(accepted, "allow").otherwise("block")).drop("_allow", "_limit")
