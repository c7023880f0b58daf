"""Fill-in-middle transformation with cut points from a Roaring-style boundary set.

The unit boundaries of a text (code points before each unit, and its end) are kept as a
compressed set: offsets are grouped by their high 16 bits, and the low halves of a group
are an array, a bitmap or runs, whichever is smallest, with the cardinalities of all
containers accumulated. The k-th boundary is found by a search of the cumulative
cardinalities and a select inside one container, so both cuts of a text are two selects,
and a stored set (``boundaries``) answers later cuts without the text.

Draws are Spark columns: four 32-bit numbers from the SHA-256 of ``seed:id``. Each text is
cut and put together in the task that reads it; nothing moves between tasks. A text goes
out as prefix-suffix-middle (``psm``), suffix-prefix-middle (``spm``) or unchanged
(``plain``), and :func:`restore` puts the original together from output and form alone.

Defined results: a null text is an empty one; an empty text, and one that contains a mark,
is ``plain``; a null id draws like an empty one; equal ids draw alike; very long texts are
worked through by themselves; an empty table gives no rows; other columns pass through,
and one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.llm.words import Block, blocks

ARRAY, BITMAP, RUNS = 0, 1, 2
#: One container: the high bits of its offsets, its kind, the cardinality of the set up to
#: and with it, and where its bytes end in the payload.
_HEAD = np.dtype([("key", "<u4"), ("kind", "<u4"), ("upto", "<u8"), ("end", "<u8")])
_BITMAP_BYTES = 8192


def _container(low: np.ndarray) -> tuple[int, bytes]:
    """The smallest form of ascending 16-bit offsets."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    if 4 * (len(breaks) + 1) < min(2 * len(low), _BITMAP_BYTES):
        first = np.concatenate([low[:1], low[breaks]])
        last = np.concatenate([low[breaks - 1], low[-1:]])
        return RUNS, np.stack([first, last - first], axis=1).astype("<u2").tobytes()
    if 2 * len(low) <= _BITMAP_BYTES:
        return ARRAY, low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return BITMAP, np.packbits(bits, bitorder="little").tobytes()


def pack(offsets: np.ndarray) -> bytes:
    """A boundary set of ascending distinct offsets below 2**48."""
    offsets = np.asarray(offsets, np.int64)
    high = offsets >> 16
    edges = np.flatnonzero(np.diff(high)) + 1
    head, payload, size = np.zeros(len(edges) + 1 if len(offsets) else 0, _HEAD), [], 0
    starts, stops = [0, *edges.tolist()], [*edges.tolist(), len(offsets)]
    for i in range(len(head)):
        kind, data = _container(offsets[starts[i] : stops[i]] & 0xFFFF)
        payload.append(data)
        size += len(data)
        head[i] = (high[starts[i]], kind, stops[i], size)
    return len(head).to_bytes(4, "little") + head.tobytes() + b"".join(payload)


def _head(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _HEAD, int.from_bytes(data[:4], "little"), 4)


def cardinality(data: bytes) -> int:
    head = _head(data)
    return int(head["upto"][-1]) if len(head) else 0


def select(data: bytes, k: int) -> int:
    """The k-th smallest offset of a set, from 0."""
    head = _head(data)
    at = int(np.searchsorted(head["upto"], k, "right"))
    if not 0 <= k or at == len(head):
        raise IndexError(k)
    k -= int(head["upto"][at - 1]) if at else 0
    begin = 4 + head.nbytes + (int(head["end"][at - 1]) if at else 0)
    stop = 4 + head.nbytes + int(head["end"][at])
    kind, key = int(head["kind"][at]), int(head["key"][at]) << 16
    if kind == ARRAY:
        return key | int.from_bytes(data[begin + 2 * k : begin + 2 * k + 2], "little")
    if kind == RUNS:
        runs = np.frombuffer(data[begin:stop], "<u2").reshape(-1, 2).astype(np.int64)
        upto = np.cumsum(runs[:, 1] + 1)
        run = int(np.searchsorted(upto, k, "right"))
        return key | int(runs[run, 0] + k - (upto[run - 1] if run else 0))
    words = np.frombuffer(data[begin:stop], "<u8")
    upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    word = int(np.searchsorted(upto, k, "right"))
    bits = np.flatnonzero(np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little"))
    return key | (word * 64 + int(bits[k - (int(upto[word - 1]) if word else 0)]))


def boundaries(block: Block, unit: str = "line") -> Iterator[np.ndarray]:
    """For each row of a block the code points before each of its units, and its end."""
    lead = (block.data & 0xC0) != 0x80
    before = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    breaks = np.flatnonzero(block.data == 0x0A) + 1 if unit == "line" else np.flatnonzero(lead)
    inner = np.searchsorted(breaks, block.offsets, "right").tolist()
    for row, (begin, end) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())):
        cuts = before[breaks[inner[row] : inner[row + 1]]] - before[begin]
        parts = [np.zeros(1, np.int64), cuts]
        if end > begin and (not len(cuts) or cuts[-1] < before[end] - before[begin]):
            parts.append(before[end : end + 1] - before[begin])
        yield np.concatenate(parts)


@dataclass(frozen=True)
class Plan:
    """How texts are transformed: percentages, the seed of the draws, marks and units."""

    rate: int = 100
    spm: int = 50
    seed: str = "7"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def cut(docs: DataFrame, one: str, two: str, text: str = "text", unit: str = "line", keep_set: str | None = None, into: tuple[str, str] = ("first", "last")) -> DataFrame:
    """``docs`` with ``n`` units, and the code points before the cuts (columns ``into``):
    the boundaries numbered by the smaller and the larger of columns ``one`` and ``two``
    modulo n + 1. ``keep_set`` names a column for the packed boundary set."""
    docs = docs.drop("n", *into, *([keep_set] if keep_set else []))
    names = docs.columns
    if unit not in ("line", "character"):
        raise ValueError(f"unknown unit {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = [batch.column(names.index(c)).to_pylist() for c in (one, two)]
            counts, firsts, lasts, sets = [], [], [], []
            for block in blocks(batch.column(names.index(text))):
                for offsets in boundaries(block, unit):
                    packed, row = pack(offsets), len(counts)
                    n = cardinality(packed) - 1
                    low, high = sorted((draw[0][row] % (n + 1), draw[1][row] % (n + 1)))
                    counts.append(n)
                    firsts.append(select(packed, low))
                    lasts.append(select(packed, high))
                    if keep_set:
                        sets.append(packed)
            made = [pa.array(x, pa.int64()) for x in (counts, firsts, lasts)]
            added = [pa.array(sets, pa.binary())] if keep_set else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, *added], [*names, "n", *into, *([keep_set] if keep_set else [])])

    fields = [*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n", *into))]
    return docs.mapInArrow(run, T.StructType([*fields, *([T.StructField(keep_set, T.BinaryType())] if keep_set else [])]))


def transform(docs: DataFrame, plan: Plan = Plan(), text: str = "text", key: str = "doc_id", keep_set: str | None = None) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    one, two, whether, which = draws(F.col(key), plan.seed)
    drawn = docs.withColumns({text: F.coalesce(text, F.lit("")), "_one": one, "_two": two, "_whether": whether % 100, "_which": which % 100})
    made = cut(drawn, "_one", "_two", text, plan.unit, keep_set, ("_first", "_last"))
    body = F.col(text)
    marked = F.lit(False)
    for mark in (plan.prefix, plan.suffix, plan.middle):
        marked = marked | F.contains(body, F.lit(mark))
    plain = (F.length(body) == 0) | marked | (F.col("_whether") >= plan.rate)
    form = F.when(plain, "plain").when(F.col("_which") < plan.spm, "spm").otherwise("psm")
    begin = F.substring(body, F.lit(1), F.col("_first").cast("int"))
    centre = F.substring(body, (F.col("_first") + 1).cast("int"), (F.col("_last") - F.col("_first")).cast("int"))
    rest = F.substring(body, (F.col("_last") + 1).cast("int"), F.length(body))
    marks = {m: F.lit(getattr(plan, m)) for m in ("prefix", "suffix", "middle")}
    output = (
        F.when(F.col("form") == "plain", body)
        .when(F.col("form") == "psm", F.concat(marks["prefix"], begin, marks["suffix"], rest, marks["middle"], centre))
        .otherwise(F.concat(marks["suffix"], rest, marks["prefix"], begin, marks["middle"], centre))
    )
    chars = lambda c: F.when(F.col("form") != "plain", c)
    done = made.withColumn("form", form).withColumns({"prefix_chars": chars(F.col("_first")), "middle_chars": chars(F.col("_last") - F.col("_first")), "output": output})
    return done.drop("_one", "_two", "_whether", "_which", "_first", "_last")


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that :func:`transform` made ``output`` of. Marks occur once each in it, as
    a text that contains one stays plain."""
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    middle = after(output, plan.middle)
    rest = before(output, plan.middle)
    psm = F.concat(before(after(rest, plan.prefix), plan.suffix), middle, after(rest, plan.suffix))
    spm = F.concat(after(rest, plan.prefix), middle, before(after(rest, plan.suffix), plan.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def sql(plan: Plan = Plan()) -> str:
    """The digests of the query over ``documents``, by lists of lines."""
    p, s, m = plan.prefix, plan.suffix, plan.middle
    draw = lambda i: f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{plan.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents
), c AS (
  SELECT doc_id, text, u, len(u) AS n, {draw(0)} % (len(u) + 1) AS one, {draw(1)} % (len(u) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR {draw(2)} % 100 >= {plan.rate} THEN 'plain'
              WHEN {draw(3)} % 100 < {plan.spm} THEN 'spm' ELSE 'psm' END AS form FROM t
), x AS (
  SELECT *, array_to_string(u[1:least(one, two)], '') AS a, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS b,
         array_to_string(u[greatest(one, two) + 1:], '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || a || '{s}' || z || '{m}' || b ELSE '{s}' || z || '{p}' || a || '{m}' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM x"""

