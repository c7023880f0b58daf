"""Sharding by histogram sort.

The global order is (content hash, tie-breaker, row). Splitters between shards are found by
counting: every round lays evenly spaced probes into the open key interval of each
splitter, one job counts the exact bytes between neighbouring probes over all partitions,
and the interval shrinks to the gap around the wanted byte position. A splitter is done
when the bytes below a probe lie within the tolerance. If one content hash alone spans the
wanted position (a hot group of equal texts), the search goes on inside the group over the
tie-breaker, and if rows that are equal in both do, over the rows' numbers, so groups are
split only when they must be and any can be. Rows are then exchanged once, by range, into
pieces of about ``PIECE_ROWS`` rows; the driver sees counts only, ``probes`` x splitters
per round.

The rows are written once with their keys and numbers, and everything after reads that
table, so numbers hold. With ``keep_text`` false the text isn't part of it.

Defined results: a null text has no bytes and hashes like an empty one; equal rows are
told apart by the tie-breaker and then by their numbers in the table; an empty table gives
no rows; other columns pass through, and a column named like one that is added is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectlab.session import written

#: Keys are 62-bit, so that sums and differences of keys stay in a bigint.
KEY_BITS = 62
_TOP = 1 << KEY_BITS
_KEYS = ("_head", "_tail", "_row")
#: Rows that one task sorts, about.
PIECE_ROWS = 50_000


@dataclass
class _Search:
    """One splitter: its key lies in (low, high]; ``below`` bytes have a key under ``low``.

    ``group`` holds the keys that are settled: none while the content hash is searched, then
    the hash whose rows are split by their tie-breaker, then both.
    """

    target: float
    tolerance: float
    low: int = 0
    high: int = _TOP
    below: int = 0
    group: tuple[int, ...] = ()
    done: tuple[int, ...] | None = None


def _histogram(keys: DataFrame, open_: list[tuple], probes: int) -> dict[tuple, list[tuple[int, int]]]:
    """Bytes and rows in each gap between probes, for each distinct (group, low, high)."""
    cells = []
    for number, (group, low, high) in enumerate(open_):
        step = max(1, -(-(high - low) // probes))
        key = _KEYS[len(group)]
        inside = (F.col(key) >= low) & (F.col(key) < high)
        for name, value in zip(_KEYS, group):
            inside &= F.col(name) == value
        cells.append(F.when(inside, F.lit(number * probes) + F.expr(f"CAST(({key} - {low}L) div {step}L AS BIGINT)")))
    found = keys.select("_size", F.array(*cells).alias("cell")).select("_size", F.explode(F.filter("cell", lambda c: c.isNotNull())).alias("cell"))
    counts = {row["cell"]: (row["bytes"], row["n"]) for row in found.groupBy("cell").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).collect()}
    return {key: [counts.get(number * probes + i, (0, 0)) for i in range(probes)] for number, key in enumerate(open_)}


def _narrow(search: _Search, gaps: list[tuple[int, int]], probes: int) -> None:
    step = max(1, -(-(search.high - search.low) // probes))
    below = search.below
    for i, (size, rows) in enumerate(gaps):
        if below + size >= search.target or i == probes - 1:
            break
        below += size
    low = min(search.low + i * step, search.high)
    high = min(low + step, search.high)
    head = lambda key: (*search.group, key, 0, 0)[:3]
    last = len(search.group) == len(_KEYS) - 1
    under, over = search.target - below, below + size - search.target
    if under <= search.tolerance:
        search.done = head(low)
    elif over <= search.tolerance:
        search.done = head(high)
    elif rows == 1 or (high - low <= 1 and last):  # one row spans the target: the nearer side
        search.done = head(low if under <= over else high)
    elif high - low <= 1:  # one key does: go on inside it
        search.low, search.high, search.below, search.group = 0, _TOP, below, (*search.group, low)
        return
    search.low, search.high, search.below = low, high, below


def splitters(keys: DataFrame, shards: int, ranges: int = 1, tolerance: float = 0.002, probes: int = 64) -> list[tuple[int, ...]]:
    """``shards * ranges - 1`` keys (head, tail, row) that cut the rows of ``keys`` (columns
    ``_head``, ``_tail``, ``_row``, ``_size``) into shards of nearly equal bytes, each of ``ranges``
    pieces. ``tolerance`` is the allowed error between shards as a share of one shard;
    cuts inside a shard, which only share out the work, may be off by half a piece."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    part = total / (shards * ranges)
    searches = [_Search(part * i, part / 2 if i % ranges else tolerance * total / shards) for i in range(1, shards * ranges)]
    while still := [s for s in searches if s.done is None]:
        open_ = list(dict.fromkeys((s.group, s.low, s.high) for s in still))
        gaps = _histogram(keys, open_, probes)
        for s in still:
            _narrow(s, gaps[(s.group, s.low, s.high)], probes)
    return [s.done for s in searches]


def _range_of(cuts: list[tuple[int, ...]]) -> Column:
    """The number of cuts at or below a row's key, by bisection inside one expression."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        head, tail, row = cuts[middle]
        in_tie = (F.col("_tail") < tail) | ((F.col("_tail") == tail) & (F.col("_row") < row))
        under = (F.col("_head") < head) | ((F.col("_head") == head) & in_tie)
        return F.when(under, pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(cuts))


def shard(docs: DataFrame, shards: int = 16, text: str = "text", tie: str = "doc_id", ranges: int | None = None, tolerance: float = 0.002, probes: int = 64, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus 1), ``shard`` and ``slot``.

    Shards hold nearly equal bytes and are contiguous in the order of (content hash, tie,
    row); ``slot`` numbers the rows of a shard in that order, from 0 and without gaps.
    ``ranges`` pieces a shard are sorted by separate tasks; by default the counted rows
    decide how many.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mask = F.lit(_TOP - 1)
    keyed = docs.withColumns({
        "size": (F.octet_length(body) + 1).cast("bigint"),
        "_head": F.xxhash64(body).bitwiseAND(mask),
        "_tail": F.xxhash64(F.lit(1), F.col(tie)).bitwiseAND(mask),
        "_row": F.monotonically_increasing_id(),
    })
    keyed = written(keyed if keep_text else keyed.drop(text), "shard-rows")
    keys = keyed.select(*_KEYS, F.col("size").alias("_size"))
    ranges = ranges or max(1, -(-keys.count() // (shards * PIECE_ROWS)))
    cuts = splitters(keys, shards, ranges, tolerance, probes)
    counts = {r["piece"]: r["n"] for r in keys.select(_range_of(cuts).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).collect()}
    base, bases = 0, []
    for piece in range(shards * ranges):
        base = 0 if piece % ranges == 0 else base
        bases.append(base)
        base += counts.get(piece, 0)
    order = Window.partitionBy("_piece").orderBy(*_KEYS)
    placed = keyed.withColumn("_piece", _range_of(cuts)).withColumn("_rank", F.row_number().over(order) - 1)
    return placed.withColumns({
        "shard": F.expr(f"CAST(_piece div {ranges} AS INT)"),
        "slot": F.get(F.array(*[F.lit(b).cast("bigint") for b in bases]), F.col("_piece")) + F.col("_rank"),
    }).drop(*_KEYS, "_piece", "_rank")
