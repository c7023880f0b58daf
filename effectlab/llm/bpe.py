"""Byte-level BPE: encoding by folding ranked merges over the bytes of distinct words.

Encoding is one narrow pass, without a shuffle. Each task reads its rows in chunks; the
words of a chunk (matches of the splitting pattern) are numbered, and each distinct word
that isn't a token itself goes once through the fold, a Spark ``aggregate``: starting from
its byte tokens, the merges that its bytes allow are applied in the order of their ranks,
each wherever its pair stands, from the left. A state is a string with one character a
token, so that a merge is a ``replace`` of two characters by one; which pair a rank merges
is looked up in literal arrays of the plan. The texts' word numbers are then replaced by
the tokens found. Decoding joins the byte strings of the ids.

One sweep in the order of ranks gives what repeatedly merging the lowest pair gives, if no
merged token has a lower rank than its parts: then no merge makes a pair of lower rank.
:func:`merges` checks this. It also finds, for each token, the one pair of tokens that it
can be merged from: the last two parts that the merges leave of its own bytes; another
pair can't stand side by side. The merges that a word's bytes allow are the tokens among
its byte runs.

Defined results: null and empty texts have no ids; very long texts form a chunk of their
own; ids are listed in text order, repeats included; an empty table gives no rows; all
columns pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text whose distinct words share one numbering.
CHUNK = 8_000_000
#: Rows that a pass works on at a time; Arrow's batches are larger.
ROWS = 500
#: Multipliers of the hash of byte runs.
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file, from the driver's disk (a few MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged) ranks of the one pair from which each token can be merged."""
    found, none = [], max(ranks.values(), default=0) + 1
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            at = min(range(len(pairs)), key=pairs.__getitem__)
            if pairs[at] == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            left, right = ranks[parts[0]], ranks[parts[1]]
            if any(len(p) > 1 and ranks[p] > rank for p in parts):
                raise ValueError(f"{token!r} has a lower rank than one of its parts")
            found.append((left, right, rank))
    return found


def character(rank: int) -> str:
    """The character that stands for a token in the fold; surrogates are left out."""
    return chr(rank + 1 if rank < 0xD7FF else rank + 0x801)


def _ranks_of(text: str) -> np.ndarray:
    """The tokens of a string of :func:`character`."""
    code = np.frombuffer(text.encode("utf-32-le"), np.int32)
    return np.where(code < 0xD800, code - 1, code - 0x801)


def _literal(values: list[str]) -> Column:
    """A constant array of strings: Spark parses it once, when it plans the query."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "array<string>")


def fold(start: Column, allowed: Column, table: list[tuple[int, int, int]]) -> Column:
    """The tokens that the ranked merges ``allowed`` (ascending) make of the byte tokens ``start``."""
    pairs, merged = [""] * (max(rank for _, _, rank in table) + 1), []
    for left, right, rank in table:
        pairs[rank] = character(left) + character(right)
    merged = [character(rank) for rank in range(len(pairs))]
    pairs_, merged_ = _literal(pairs), _literal(merged)
    return F.aggregate(allowed, start, lambda word, rank: F.replace(word, F.get(pairs_, rank), F.get(merged_, rank)))


class _Numbers(dict):
    """Numbers of words: the rank of one that is a token, the next free number of another."""

    def __init__(self, whole: dict[str, int], first: int):
        super().__init__()
        self.whole, self.first, self.fresh = whole, first, []

    def __missing__(self, word: str) -> int:
        number = self.whole.get(word)
        if number is None:
            number = self.first + len(self.fresh)
            self.fresh.append(word)
        self[word] = number
        return number


def _prefixes(ranks: dict[bytes, int], table: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of every prefix of a token that merges make, and the token's rank (-1: a prefix only)."""
    made = {rank for _, _, rank in table}
    found: dict[bytes, int] = {}
    for token, rank in ranks.items():
        if rank in made:
            for i in range(2, len(token)):
                found.setdefault(token[:i], -1)
            found[token] = rank
    code = np.array([_code(p) for p in found], np.uint64)
    order = np.argsort(code)
    return code[order], np.array(list(found.values()), np.int32)[order]


def _code(piece: bytes) -> int:
    code = 0
    for byte in piece:
        code = (code * _STEP + byte * _SPREAD + 1) & 0xFFFFFFFFFFFFFFFF
    return code


def _allowed(raw: list[bytes], codes: np.ndarray, ranks: np.ndarray) -> pa.ListArray:
    """The merges that the bytes of each word allow, ascending. The runs of bytes grow from
    every place at once, as long as they begin a token. (A chance match of hashes adds a
    merge whose pair doesn't occur; it does nothing.)"""
    sizes = np.array([len(w) for w in raw])
    value = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) * np.uint64(_SPREAD) + np.uint64(1)
    word = np.repeat(np.arange(len(raw)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at, code, size = np.arange(len(value)), value, 1
    found = []
    while len(at):
        going = at + size < end[at]
        at = at[going]
        code = code[going] * np.uint64(_STEP) + value[at + size]
        size += 1
        near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[near] == code
        at, code, rank = at[hit], code[hit], ranks[near[hit]]
        found.append(word[at[rank >= 0]] << 32 | rank[rank >= 0])
    pairs = np.sort(np.concatenate(found))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    bounds = np.searchsorted(pairs >> 32, np.arange(len(raw) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))


def _number_words(pattern: str, text: str, names: list[str], ranks: dict[bytes, int], table: list[tuple[int, int, int]]):
    """First pass over a task's rows: for each chunk a row with the byte tokens and allowed
    merges of each new word, then the rows (columns ``names``), their texts as word numbers. A word that is a
    token is numbered by its rank; the others come after the ranks. What a task needs of the
    tokens is made here, once, as a few arrays and strings."""
    first_new = max(ranks.values()) + 1
    whole = {token.decode(): rank for token, rank in ranks.items() if _is_text(token)}
    single = {i: character(ranks[bytes([i])]) for i in range(256)}
    codes_of, ranks_of = _prefixes(ranks, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        ints = pa.list_(pa.int32())

        def flush(numbers: _Numbers, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for first in range(0, len(numbers.fresh), 10_000):
                raw = [w.encode() for w in numbers.fresh[first : first + 10_000]]
                words = pa.array([w.decode("latin-1").translate(single) for w in raw], pa.string())
                nulls = [pa.nulls(len(raw), held[0].schema.field(name).type) for name in names]
                yield pa.RecordBatch.from_arrays([*nulls, pa.nulls(len(raw), pa.binary()), words, _allowed(raw, codes_of, ranks_of)], [*names, "_codes", "_word", "_merges"])
            yield from held

        numbers, held, size = _Numbers(whole, first_new), [], 0
        for batch in _slices(batches):
            texts = batch.column(batch.schema.get_field_index(text))
            codes = pa.array([np.fromiter(map(numbers.__getitem__, find(value.as_py() or "")), np.int32).tobytes() for value in texts], pa.binary())
            # Copies: a column of the batch would keep the texts beside it in memory.
            kept = [_copied(batch.column(batch.schema.get_field_index(name))) for name in names]
            n, size = batch.num_rows, size + texts.nbytes
            held.append(pa.RecordBatch.from_arrays([*kept, codes, pa.nulls(n, pa.string()), pa.nulls(n, ints)], [*names, "_codes", "_word", "_merges"]))
            del batch, texts, kept, codes
            if size >= CHUNK:
                yield from flush(numbers, held)
                numbers, held, size = _Numbers(whole, first_new), [], 0
        if held:
            yield from flush(numbers, held)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, ``ROWS`` at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _copied(column: pa.Array) -> pa.Array:
    """The values of a column in memory of their own."""
    return column.take(pa.array(np.arange(len(column))))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _put_tokens(names: list[str], result: str, decoded: str | None, ranks: dict[bytes, int]):
    """Second pass, over the same rows in the same order: word numbers become token ids.
    Rows of words that follow rows of texts begin the next chunk."""
    known, pieces_of = max(ranks.values()) + 1, _pieces(ranks) if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        values, lengths = np.arange(known, dtype=np.int32), np.ones(known, np.int64)
        starts = np.arange(known)
        for batch in _slices(batches):
            is_word = batch.column("_codes").is_null().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(is_word)) + 1), len(is_word)]
            for first, last in zip(edges, edges[1:]):
                part = batch.slice(first, last - first)
                if last > first and is_word[first]:
                    words = part.column("_word").to_pylist()
                    pieces.append(_ranks_of("".join(words)))
                    sizes.append(np.array([len(w) for w in words]))
                elif last > first:
                    if pieces:
                        lengths = np.concatenate([np.ones(known, np.int64), *sizes])
                        values = np.concatenate([np.arange(known, dtype=np.int32), *pieces])
                        starts = np.cumsum(lengths) - lengths
                        pieces, sizes = [], []
                    made = _with_ids(part, names, result, values, starts, lengths)
                    yield made.append_column(decoded, _decoded(made.column(result), pieces_of)) if decoded else made

    return run


def _with_ids(rows: pa.RecordBatch, names: list[str], result: str, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    packed = []
    for cell in rows.column("_codes"):
        code = np.frombuffer(cell.as_buffer(), np.int32)
        size = lengths[code]
        end = np.cumsum(size)
        ids = values[np.arange(end[-1] if len(end) else 0) + np.repeat(starts[code] - (end - size), size)]
        packed.append(ids.astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(packed, pa.binary())], [*names, result])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", result: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``result``: the token ids of ``text``, each match of ``pattern``
    separately, as little-endian unsigned 32-bit integers (:func:`unpack` makes arrays).
    With ``decoded``, a column of that name has the ids decoded again, as :func:`decode`
    would, in the same pass."""
    docs = docs.drop(result, "_codes", "_word", "_merges", *([decoded] if decoded else []))
    own = [T.StructField(f.name, f.dataType) for f in docs.schema if keep_text or f.name != text]
    names = [f.name for f in own]
    added = [T.StructField("_codes", T.BinaryType()), T.StructField("_word", T.StringType()), T.StructField("_merges", T.ArrayType(T.IntegerType()))]
    table = merges(ranks)
    split = docs.mapInArrow(_number_words(pattern, text, names, ranks, table), T.StructType([*own, *added]))
    folded = split.select(*names, "_codes", F.when(F.col("_word").isNotNull(), fold(F.col("_word"), F.col("_merges"), table)).alias("_word"))
    made = [T.StructField(c, T.BinaryType()) for c in (result, decoded) if c]
    return folded.mapInArrow(_put_tokens(names, result, decoded, ranks), T.StructType([*own, *made]))


def unpack(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """``rows`` with the packed ``ids`` as an array of integers."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(ids)
            lists = [np.frombuffer(cell.as_buffer(), "<u4").astype(np.int32) if cell.is_valid else None for cell in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType()) if f.name == ids else f.dataType) for f in rows.schema]))


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def _decoded(ids: pa.Array, pieces: list[bytes]) -> pa.Array:
    take = pieces.__getitem__
    return pa.array([b"".join(map(take, np.frombuffer(cell.as_buffer(), "<u4").tolist())) if cell.is_valid else None for cell in ids], pa.binary())


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", result: str = "decoded") -> DataFrame:
    """``rows`` with ``result``: the bytes of the packed token ids, joined. Null ids give null."""
    rows = rows.drop(result)
    names, pieces = rows.columns, _pieces(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(names.index(ids)), pieces)], [*names, result])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField(result, T.BinaryType())])
    return rows.mapInArrow(run, schema)
