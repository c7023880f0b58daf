"""Quality rules: decision lists learned from labelled text statistics.

Statistics of each text come from NumPy kernels over Arrow batches. The learner works by
sequential covering: a rule grows by the threshold condition with the largest information
gain on two thirds of the labelled rows, is pruned back on the remaining third, and is
kept while it is right there more often than ``least_precision``; the rows it covers are
then set aside. The list becomes one ordered Spark ``CASE`` expression, so that judging a
corpus costs no more than its statistics.

Only labelled statistics reach the driver: at most ``MAX_LABELLED`` rows, those with the
lowest hash of their id, a few dozen numbers each.

Defined results: a null text has no words and zero statistics, ratios with nothing below
the line are 0; repeated rows are judged alike; without labels, or with labels of one
class only, the list is empty and keeps everything; an empty table gives no rows; other
columns pass through, and those named like a statistic are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.llm.words import Block, blocks, windows, words_of

#: Labelled rows that a list is learned from, at most.
MAX_LABELLED = 20_000
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_alpha", "n_marks", "n_list_marks", "n_short_lines")

_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_IS_UPPER = np.isin(np.arange(256), range(65, 91))
_IS_ALPHA = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_IS_MARK = np.isin(np.arange(256), [ord(c) for c in "!?"])


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, code) pairs in text order: which have an equal pair, and which an earlier one."""
    order = np.lexsort((code, row))
    same = (row[order][1:] == row[order][:-1]) & (code[order][1:] == code[order][:-1])
    later = np.zeros(len(row), bool)
    later[1:] = same
    any_ = later.copy()
    any_[:-1] |= same
    out = np.zeros((2, len(row)), bool)
    out[0, order], out[1, order] = any_, later  # the sort is stable, so the first of equals is the earliest
    return out[0], out[1]


def _lines(block: Block, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, content hash, words) of the lines with a word."""
    feeds = np.flatnonzero(block.data == 10)
    cuts = np.unique(np.concatenate([block.offsets, feeds + 1]))  # where a line or a row begins
    of_word = np.searchsorted(cuts, words.start, "right") - 1
    line, count = np.unique(of_word, return_counts=True)
    begin = cuts[line]
    stop = np.append(cuts, len(block.data))[line + 1]
    stop = stop - ((stop > begin) & (block.data[stop - 1] == 10))  # without the line feed
    raw = block.data.tobytes()
    code = np.fromiter((hash(raw[a:b]) for a, b in zip(begin.tolist(), stop.tolist())), np.int64, len(begin))
    row = np.searchsorted(block.offsets, begin, "right") - 1
    return row, code, count


def _statistics(block: Block) -> dict[str, np.ndarray]:
    words, data, offsets, n = words_of(block), block.data, block.offsets, block.rows
    row = words.row
    per_row = lambda at: np.bincount(at, minlength=n)[:n]
    code, at = windows(words, 3)
    repeated, _ = _repeats(row[at], code)
    covered = np.zeros(len(row) + 2, bool)
    for i in range(3):
        covered[at[repeated] + i] = True
    again, again_later = _repeats(row, words.hash)
    line_row, line_code, line_words = _lines(block, words)
    _, dup = _repeats(line_row, line_code)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    in_word = np.cumsum(inside[:-1]).astype(bool)
    single_mark = (words.end - words.start == 1) & np.isin(data[words.start], [ord("|"), ord("-"), ord("*")])
    return {
        "n_words": per_row(row),
        "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_IS_SYMBOL[data], offsets),
        "n_dup_lines": per_row(line_row[dup]),
        "n_repeat_words": per_row(row[covered[: len(row)]]),
        "n_lines": per_row(line_row),
        "n_distinct": per_row(row[~again_later]),
        "n_upper": _sums(_IS_UPPER[data], offsets),
        "n_alpha": _sums(_IS_ALPHA[data], offsets),
        "n_marks": _sums(_IS_MARK[data], offsets),
        "n_list_marks": per_row(row[single_mark]),
        "n_short_lines": per_row(line_row[line_words < 4]),
    }


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the counts :data:`COUNTS` of it."""
    keep = [f for f in docs.schema.fields if f.name not in (*COUNTS, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            for block in blocks(batch.column(batch.schema.get_field_index(text))):
                made = _statistics(block)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(block.first, block.rows) for c in columns), *(pa.array(made[c].astype(np.int64)) for c in COUNTS)],
                    [*(f.name for f in keep), *COUNTS],
                )

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(text, *(f.name for f in keep)).mapInArrow(run, schema)


#: What rules may test: a count, or a count as a share of another.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_alpha"),
    "alpha_share": ("n_alpha", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "list_mark_share": ("n_list_marks", "n_words"),
    "short_line_share": ("n_short_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    count, of = FEATURES[name]
    return F.col(count).cast("double") if of is None else F.coalesce(F.try_divide(F.col(count).cast("double"), F.col(of)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values >= self.threshold if self.above else values < self.threshold

    def column(self) -> Column:
        return feature(self.feature) >= self.threshold if self.above else feature(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _covers(rule: tuple[Condition, ...], table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for condition in rule:
        rows = rows & condition.holds(table)
    return rows


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Condition | None:
    """The condition with the largest first-order information gain on ``rows``."""
    positive, negative = (bad & rows).sum(), (~bad & rows).sum()
    start = np.log2(positive / (positive + negative))
    best, chosen = 1e-9, None
    for name, values in table.items():
        inside = np.flatnonzero(rows)
        order = inside[np.argsort(values[inside], kind="stable")]
        sorted_, is_bad = values[order], bad[order]
        edges = np.flatnonzero(np.diff(sorted_)) + 1
        if not len(edges):
            continue
        low_bad = np.cumsum(is_bad)[edges - 1]
        for above, p, n in ((False, low_bad, edges - low_bad), (True, positive - low_bad, negative - (edges - low_bad))):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / (p + n)) - start), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, chosen = gain[at], Condition(name, above, float((sorted_[edges[at] - 1] + sorted_[edges[at]]) / 2))
    return chosen


def learn(table: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, max_conditions: int = 6, max_rules: int = 40) -> list[tuple[Condition, ...]]:
    """An ordered list of threshold conjunctions that cover the rows with ``bad``."""
    growing = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules and (bad & left & growing).any() and (~bad).any():
        rows, rule = left & growing, ()
        while len(rule) < max_conditions and (~bad & rows).any():
            condition = _best_condition(table, bad, rows)
            if condition is None:
                break
            rule, rows = (*rule, condition), rows & condition.holds(table)
        if not rule:
            break
        pruning = left & ~growing

        def worth(rule: tuple[Condition, ...]) -> float:
            covered = _covers(rule, table, pruning)
            p, n = (bad & covered).sum(), (~bad & covered).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[: i + 1] for i in range(len(rule))), key=lambda r: (worth(r), -len(r)))
        covered = _covers(rule, table, left)
        p, n = (bad & covered).sum(), (~bad & covered).sum()
        if p < 2 or p < least_precision * (p + n):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", limit: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Feature table and labels (bad: label 0) of at most ``limit`` labelled rows."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    chosen = marks.orderBy(F.xxhash64(key), key).limit(limit)
    rows = statistics(docs.select(key, text).join(F.broadcast(chosen), key), text)
    got = rows.orderBy(F.xxhash64(key), key).select("_label", *(feature(f).alias(f) for f in FEATURES)).toPandas()
    return {f: got[f].to_numpy() for f in FEATURES}, got["_label"].to_numpy() == 0


def rejecting_rule(rules: list[tuple[Condition, ...]]) -> Column:
    """The text of the first rule that covers a row, null where none does."""
    column = None
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        told = F.lit(" and ".join(map(str, rule)))
        column = F.when(holds, told) if column is None else column.when(holds, told)
    return F.lit(None).cast("string") if column is None else column


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
