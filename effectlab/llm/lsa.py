"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents; tasks combine
   theirs, so ``TERMS`` numbers a task are shuffled.
2. A randomised SVD of the benchmark's TF-IDF passages gives each word a vector: passes
   over the passages multiply them by a thin matrix in the tasks, and chunks of the
   products are summed by Spark. Texts are folded in, that is each direction is divided by
   its singular value, so that the many words all texts share don't drown the rest.
3. Every window of every document is compared with every benchmark passage by cosine in
   that space; a window's vector is the sum of those of its cells of ``CELL`` words. Where
   it is near, the words around the window are compared with the whole item: half of the
   weight of its words must be there in any order, the longest common subsequence must
   hold most of the item, and of its answer (its last sentence) unless nearly all of the
   item is there.
4. A short item fills little of a window. So each item is also looked up by its ``RARE`` rarest
   words: the words around each of their occurrences, as many as the item has and an eighth
   more at either end, are compared in the same way, and a leak that holds nearly all of the
   item is reported, without a cosine.

The benchmark is a query set that is run in blocks of ``BLOCK_PASSAGES`` passages, each
broadcast; documents are read by narrow passes and never shuffled.

Defined results: null and empty texts and items match nothing; an item of a few words must
be there word for word; equal items are each reported; repeated rows are judged alike; empty
tables give no leaks; other columns pass through, except one named like the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.llm.words import blocks, words_of
from effectlab.session import written

BITS = 16
TERMS = 1 << BITS
#: Dimensions of the space, extra columns of the random probe, and passes that sharpen it.
RANK, EXTRA, PASSES = 64, 16, 2
#: Windows of 2 and of 4 cells of so many words, one every half window.
CELL = 12
#: Words of a passage of the benchmark.
PASSAGE = 48
#: Cosine from which a window is compared word by word, if its part along the passage is at
#: least ``HELD`` of the passage's length; passages of the benchmark a block.
HELD = 0.4
NEAR = 0.6
BLOCK_PASSAGES = 20_000
#: Shares of an item, and of its answer, that a leak holds in order; share of an item that needs no answer.
SHARED, ANSWERED, PLAIN = 0.6, 0.5, 0.85
#: Share of the weight (inverse document frequency) of an item's words that a leak holds.
WEIGHED = 0.5
#: Items of fewer words must be there whole.
SHORT = 8
#: Rarest words of an item that are looked up one by one: what holds ``PLAIN`` of the item
#: with one of them is found at any length.
RARE = 3
#: Word slots by which candidates are sifted before they are compared.
_SLOTS = 12
_CHUNK = 1024


def _terms(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each hashed term, and documents in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in blocks(batch.column(0)):
                words = words_of(block, lower=True)
                keys = np.sort(words.row << BITS | _terms(words.hash))
                fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
                counts += np.bincount(keys[fresh] & (TERMS - 1), minlength=TERMS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows))], ["term", "n"])

    got = docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(TERMS, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _starts(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word (in its row) of the passages of rows of ``sizes`` words; the last ends with the row."""
    step = width // 2
    number = np.where(sizes > 0, np.maximum(0, -(-(sizes - width) // step)) + 1, 0)
    row = np.repeat(np.arange(len(sizes)), number)
    place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    return row, np.minimum(place * step, np.maximum(0, sizes[row] - width))


def _passages(sample: DataFrame) -> DataFrame:
    """The passages of ``text`` as arrays of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                words = words_of(block, lower=True)
                term, sizes = _terms(words.hash), np.diff(words.row_start)
                row, start = _starts(sizes, PASSAGE)
                first = words.row_start[row] + start
                last = np.minimum(first + PASSAGE, words.row_start[row + 1])
                yield pa.RecordBatch.from_arrays([pa.array([term[a:b] for a, b in zip(first, last)], pa.list_(pa.int64()))], ["terms"])

    return sample.mapInArrow(run, "terms array<bigint>")


def _used(passages: DataFrame) -> np.ndarray:
    """The terms of the passages in order, ``TERMS`` at most."""
    return np.sort(passages.select(F.explode("terms").alias("term")).distinct().toPandas()["term"].to_numpy(np.int64))


def _multiplied(passages: DataFrame, used: np.ndarray, weights: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A' A x thin for the TF-IDF rows A of the passages over their ``used`` terms: partial
    products of the tasks, in chunks of ``_CHUNK`` terms, are summed by Spark."""
    shared = passages.sparkSession.sparkContext.broadcast((used, weights[used].astype(np.float32), thin.astype(np.float32)))
    rows, width = thin.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, x = shared.value
        total = np.zeros((-(-rows // _CHUNK) * _CHUNK, width), np.float32)
        for batch in batches:
            lists = batch.column(0)
            term = np.searchsorted(known, lists.flatten().to_numpy())
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            value = weight[term]
            norm = np.sqrt(np.bincount(row, value**2, len(lists)))
            value = value / np.maximum(norm, 1e-9)[row].astype(np.float32)
            y = np.zeros((len(lists), width), np.float32)
            np.add.at(y, row, x[term] * value[:, None])
            np.add.at(total, term, y[row] * value[:, None])
        for chunk in np.flatnonzero(np.abs(total).sum(axis=1).reshape(-1, _CHUNK).sum(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([total[chunk * _CHUNK : (chunk + 1) * _CHUNK].tobytes()], pa.binary())], ["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(_CHUNK * width), None
        for batch in batches:
            for number, part in zip(batch.column(0), batch.column(1)):
                chunk = number.as_py()
                total += np.frombuffer(part.as_buffer(), np.float32)
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["chunk", "part"])

    kind = "chunk bigint, part binary"
    out = np.zeros((-(-rows // _CHUNK) * _CHUNK, width))
    for row in passages.mapInArrow(run, kind).groupBy("chunk").applyInArrow(add, kind).toLocalIterator():
        out[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["part"], np.float32).reshape(_CHUNK, width)
    shared.destroy()
    return out[:rows]


def space(passages: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Vectors of terms, [term, rank]: the leading right singular vectors of the TF-IDF rows
    of ``passages`` over their singular values. Terms that no passage has get none."""
    used = _used(passages)
    thin = np.random.default_rng(20).standard_normal((len(used), rank + EXTRA))
    for _ in range(PASSES):
        thin, _ = np.linalg.qr(_multiplied(passages, used, weights, thin))
    squares, turn = np.linalg.eigh(thin.T @ _multiplied(passages, used, weights, thin))
    lead = np.argsort(-squares)[:rank]
    lead = lead[squares[lead] > 1e-6 * max(squares[lead[0]], 1e-12)]
    out = np.zeros((TERMS, len(lead)), np.float32)
    out[used] = thin @ turn[:, lead] / np.sqrt(squares[lead])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of Python integers."""
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    whole = (1 << len(a)) - 1
    state = whole
    for word in b.tolist():
        hit = state & places.get(word, 0)
        state = ((state + hit) | (state - hit)) & whole
    return len(a) - state.bit_count()


def _answer(text: bytes, start: np.ndarray, end: np.ndarray) -> int:
    """The first word of the last sentence of an item, by its words' byte ranges."""
    for i in range(len(start) - 2, -1, -1):
        if text[end[i] - 1 : end[i]] in (b".", b"?", b"!", b":"):
            return i + 1
    return 0


def _items(rows: list[tuple[int, str]]) -> list[tuple[int, np.ndarray, int]]:
    """(id, word hashes, first word of the answer) of the items that have words."""
    out = []
    for number, text in rows:
        for block in blocks(pa.array([text])):
            words = words_of(block, lower=True)
            if len(words.hash):
                out.append((number, words.hash, _answer(block.data.tobytes(), words.start, words.end)))
    return out


def _is_leak(item: np.ndarray, weight: np.ndarray, answer: int, around: np.ndarray) -> tuple[bool, float, float]:
    """Whether ``around`` holds the item, and the shares of it and of its answer that it holds."""
    least, present = _least(item), np.isin(item, around)
    if present.sum() < least or weight[present].sum() < WEIGHED * weight.sum():
        return False, 0.0, 0.0
    length = common(item, around)
    if length < least:
        return False, 0.0, 0.0
    shared, answered = length / len(item), common(item[answer:], around) / (len(item) - answer)
    return shared >= PLAIN or answered >= ANSWERED, shared, answered


_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("shared", T.DoubleType()), T.StructField("answered", T.DoubleType()), T.StructField("cosine", T.DoubleType())]))


def _least(item: np.ndarray) -> float:
    return len(item) if len(item) < SHORT else SHARED * len(item)


def _windows(words, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both widths: each window's row, first word and vector. Windows end with their row."""
    sizes = np.diff(words.row_start)
    cells = -(-sizes // CELL)
    row = np.repeat(np.arange(len(sizes)), cells)
    place = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    first = words.row_start[row] + place * CELL
    if not len(first):
        return
    sums = np.add.reduceat(table[_terms(words.hash)], first, axis=0)
    for step in (1, 2):
        same = row[step:] == row[:-step]
        sums[:-step][same] += sums[step:][same]
        # A window whose earlier neighbour already reaches the end of the row holds nothing new.
        chosen = np.flatnonzero((place % step == 0) & ((place == 0) | (place + step < cells[row])))
        yield row[chosen], first[chosen], sums[chosen]


def _slot(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - _SLOTS)).astype(np.int64)


@dataclass(frozen=True)
class _Items:
    """The items of a block in flat arrays: words, weights and slots of item i lie at
    ``start[i]`` to ``start[i + 1]``; ``rare`` are hashes of the rarest words of the items, in
    order, ``rare_of`` the items that they are of, and ``rare_at`` their places in them."""

    ids: list[int]
    words: np.ndarray
    weights: np.ndarray
    slots: np.ndarray
    start: np.ndarray
    answers: list[int]
    rare: np.ndarray
    rare_of: np.ndarray
    rare_at: np.ndarray

    @staticmethod
    def made(items: list[tuple[int, np.ndarray, int]], weights: np.ndarray) -> _Items:
        words = np.concatenate([w for _, w, _ in items])
        rare, rare_of, rare_at = [], [], []
        for number, (_, w, _) in enumerate(items):
            unique = np.unique(w)
            some = unique[np.argsort(-weights[_terms(unique)], kind="stable")[:RARE]]
            at = np.flatnonzero(np.isin(w, some))  # a word that the item repeats has several places
            rare.append(w[at])
            rare_of.append(np.full(len(at), number))
            rare_at.append(at)
        keys, of, at = (np.concatenate(x) for x in (rare, rare_of, rare_at))
        order = np.argsort(keys, kind="stable")
        start = np.append(0, np.cumsum([len(w) for _, w, _ in items]))
        return _Items([i for i, _, _ in items], words, weights[_terms(words)].astype(np.float32), _slot(words), start, [a for _, _, a in items], keys[order], of[order], at[order])


def _sifted(slots: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, items: _Items) -> np.ndarray:
    """Candidates (words ``begin`` to ``end`` against an item) that may hold enough of the item's
    weight. Words are told apart by slot here, so none that does is lost."""
    kept = []
    for low in range(0, len(item), 1_000):
        a, b, number = begin[low : low + 1_000], end[low : low + 1_000], item[low : low + 1_000]
        there = np.zeros((len(a), 1 << _SLOTS), bool)
        candidate, place = _runs(a, b)
        there[candidate, slots[place]] = True
        candidate, place = _runs(items.start[number], items.start[number + 1])
        weight = items.weights[place]
        held = np.bincount(candidate, there[candidate, items.slots[place]] * weight, len(a))
        kept.append(low + np.flatnonzero(held >= (WEIGHED - 1e-3) * np.bincount(candidate, weight, len(a))))
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of a run and a place in it, for all places of the runs [first, last)."""
    sizes = last - first
    of = np.repeat(np.arange(len(first)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)


def _by_rare_words(code: np.ndarray, items: _Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block that are among the rarest of an item, the item, and where it would
    begin: an item that is there nearly whole is found by them however short it is."""
    marked = np.zeros(TERMS, bool)
    marked[_terms(items.rare)] = True
    at = np.flatnonzero(marked[_terms(code)])
    first, last = np.searchsorted(items.rare, code[at], "left"), np.searchsorted(items.rare, code[at], "right")
    of, place = _runs(first, last)
    return at[of], items.rare_of[place], at[of] - items.rare_at[place]


def _search(docs: DataFrame, items: list[tuple[int, np.ndarray, int]], vectors: np.ndarray, weights: np.ndarray, text: str, result: str) -> DataFrame:
    """``docs`` with the leaks of these items added to ``result``."""
    passages, of = [], []
    for number, (_, words, _) in enumerate(items):
        _, starts = _starts(np.array([len(words)]), PASSAGE)
        for start in starts:
            passages.append(vectors[_terms(words[start : start + PASSAGE])].sum(axis=0))
            of.append(number)
    queries = np.array(passages, np.float32)
    lengths_of = np.maximum(np.linalg.norm(queries, axis=1), 1e-9).astype(np.float32)
    queries /= lengths_of[:, None]
    known = _Items.made(items, weights)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, queries.T.copy(), np.array(of), known, HELD * lengths_of))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, targets, item_of, known, floor = shared.value
        lengths = np.diff(known.start)

        def compared(words, row, begin, end, number, cosine, least, mine) -> None:
            """Verify candidates and put the leaks of a row into ``mine[row]``."""
            for k in _sifted(_slot(words.hash), begin, end, number, known).tolist():
                found, which = mine[int(row[k])], int(number[k])
                if which in found:
                    continue
                at = slice(known.start[which], known.start[which + 1])
                leak, share, answered = _is_leak(known.words[at], known.weights[at], known.answers[which], words.hash[begin[k] : end[k]])
                # A few common words stand in order anywhere: a short item must be there nearly whole.
                if leak and share >= (PLAIN if lengths[which] < 2 * SHORT else least):
                    found[which] = (known.ids[which], share, answered, None if cosine is None else float(cosine[k]))

        for batch in batches:
            found: list[dict[int, tuple]] = [{} for _ in range(batch.num_rows)]
            for block in blocks(batch.column(names.index(text))):
                words = words_of(block, lower=True)
                for number_of, (row, first, vectors) in enumerate(_windows(words, table)):
                    reach = CELL * (2, 4)[number_of]
                    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-6)
                    for low in range(0, len(row), 1_000):
                        along = vectors[low : low + 1_000] @ targets
                        near = np.flatnonzero((along >= floor) & (along >= NEAR * norm[low : low + 1_000, None]))
                        if not len(near):
                            continue
                        w, p = low + near // along.shape[1], near % along.shape[1]
                        number = item_of[p]
                        own = lengths[number] >= SHORT  # shorter ones must stand as they are, and are looked up
                        w, p, number = w[own], p[own], number[own]
                        begin = np.maximum(words.row_start[row[w]], first[w] - lengths[number])
                        end = np.minimum(words.row_start[row[w] + 1], first[w] + reach + lengths[number])
                        compared(words, block.first + row[w], begin, end, number, along[w - low, p] / norm[w], 0.0, found)
                at, number, start = _by_rare_words(words.hash, known)
                if len(at):
                    # Words may be put in or left out, an eighth of them; a short item stands as it is.
                    row, slack = words.row[at], lengths[number] // SHORT
                    begin = np.maximum(words.row_start[row], start - slack)
                    end = np.minimum(words.row_start[row + 1], start + lengths[number] + slack)
                    compared(words, block.first + row, begin, end, number, None, PLAIN, found)
            before = batch.column(names.index(result)).to_pylist()
            told = [[*old, *(dict(zip(("item_id", "shared", "answered", "cosine"), x)) for x in new.values())] for old, new in zip(before, found)]
            kind = batch.schema.field(result).type
            columns = [pa.array(told, kind) if n == result else batch.column(names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", result: str = "leaks") -> DataFrame:
    """``docs`` with ``result``: the items of ``benchmark`` (``item_id``, ``text``) that each
    text holds, as (item_id, shared, answered, cosine)."""
    docs = docs.withColumn(result, F.array().cast(_LEAKS))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    n_passages = items.select(F.sum(F.ceil(F.octet_length("text") / PASSAGE))).first()[0] or 0
    if not n_passages:
        return docs
    counts, rows = frequencies(docs, text)
    weights = np.maximum(np.log((rows + 1) / (counts + 1)), 0.01)  # a word of every text still has a direction
    passages = written(_passages(items.select("text")), "passages")
    vectors = space(passages, weights) * weights[:, None].astype(np.float32)
    parts = -(-int(n_passages) // BLOCK_PASSAGES)
    for part in range(parts):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if known := _items([(r["item_id"], r["text"]) for r in block]):
            docs = _search(docs, known, vectors, weights, text, result)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document and item of the benchmark that it holds."""
    marked = mark(docs.select(key, text), benchmark, text, key, "_leaks")
    return marked.select(key, F.inline("_leaks")).groupBy(key, "item_id").agg(*(F.max(c).alias(c) for c in ("shared", "answered", "cosine")))
