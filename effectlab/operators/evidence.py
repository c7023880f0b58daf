"""Which snippets occur in which documents, for snippets and documents of any number.

Containment is a substring test, so no equi-key exists as such. But every inner word of
a snippet (all but its first and last, which may be cut by the edges of a longer word)
must occur in the document as a whole word, next to its neighbours. A run of inner words
is therefore an anchor that both sides share. A document meets the anchors of all snippets
inside its row, where these are few (their number is counted first), or else in a semi
join, and only the anchors that it holds leave the row. Each snippet is looked up by the
one of its anchors that fewest documents have; the documents of an anchor are dealt to
``SALTS`` parts, so that one which all documents hold is no hot key. Candidates are verified
on the full text. Snippets of one or two words have no inner word: they are a query set that
every document answers inside its row, a block of them at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.keys import normalize_ws
from effectlab.session import written

RUN = 4  # words in a long anchor
#: Anchors that documents meet inside their rows, which hash them for every document; more of
#: them go through a join, which hashes them once a task.
IN_ROW = 1_000
#: Short snippets that a document answers at a time.
BLOCK = 256
SALTS = 16


def _anchors(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` neighbouring words. Equal hashes of different runs only
    make candidates that are not verified."""
    count = F.size(words) - size
    starts = F.when(count >= 0, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)]))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _by_anchor(snippets: DataFrame, documents: DataFrame, snippet_id: str, document_id: str) -> DataFrame:
    """Candidates for snippets with inner words (column ``_inner``), by their rarest anchor."""
    inner = _hashed(F.col("_inner"))
    own = F.when(F.size("_inner") >= RUN, _anchors(F.col("_words"), RUN)).otherwise(_anchors(F.col("_words"), 1))
    runs = snippets.withColumn("_words", inner).select(snippet_id, F.explode(F.array_distinct(own)).alias("_anchor"))
    runs = written(runs, "evidence-anchors")
    wanted = runs.select("_anchor").distinct()
    # The hashes are bound by a projection, so each word is hashed once.
    hashed = documents.select(document_id, _hashed(F.split("_text", " ")).alias("_words"))
    entries = F.concat(_anchors(F.col("_words"), RUN), _anchors(F.col("_words"), 1))
    if wanted.count() <= IN_ROW:
        known = hashed.withColumn("_wanted", wanted.agg(F.collect_set("_anchor")).scalar())
        hits = known.select(document_id, F.explode(F.array_intersect(entries, F.col("_wanted"))).alias("_anchor"))
    else:
        hits = hashed.select(document_id, F.explode(F.array_distinct(entries)).alias("_anchor")).join(wanted, "_anchor", "left_semi")
    hits = written(hits, "evidence")
    # One that is nowhere ends the search.
    spread = hits.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    rarest = runs.join(spread, "_anchor", "left").groupBy(snippet_id).agg(
        F.min_by(F.struct("_anchor", "_n"), F.struct(F.coalesce("_n", F.lit(0)), F.col("_anchor"))).alias("_best")
    )
    salted = rarest.where("_best._n is not null").select(snippet_id, "_best._anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(document_id), F.lit(SALTS)).cast("int")
    return hits.withColumn("_salt", salt).join(salted, ["_anchor", "_salt"]).select(snippet_id, document_id)


def _short_pairs(short: DataFrame, documents: DataFrame, snippet_id: str, document_id: str) -> DataFrame:
    """Pairs of the snippets without inner words: the query set, in blocks, against every row."""
    blocks = -(-short.count() // BLOCK)
    if not blocks:
        return None
    dealt = short.withColumn("_block", F.pmod(F.xxhash64(snippet_id), F.lit(blocks)).cast("int"))
    sets = dealt.groupBy("_block").agg(F.collect_list(F.struct(F.col(snippet_id).alias("id"), F.col("_snippet").alias("s"))).alias("_set"))
    turns = documents.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = turns.join(sets, "_block").select(document_id, F.explode(F.filter("_set", lambda q: F.contains(F.col("_text"), q["s"]))).alias("_hit"))
    return held.select(F.col("_hit.id").alias(snippet_id), document_id)


def _prepared(snippets: DataFrame, documents: DataFrame, snippet_id: str, document_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    s = snippets.select(snippet_id, normalize_ws(text).alias("_snippet"))
    words = F.split("_snippet", " ")
    s = s.withColumn("_inner", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    return s, documents.select(document_id, normalize_ws(text).alias("_text"))


def _pairs(s: DataFrame, d: DataFrame, snippet_id: str, document_id: str) -> DataFrame:
    """Pairs of all snippets but empty ones."""
    long = s.where(F.size("_inner") > 0)
    candidates = _by_anchor(long, d, snippet_id, document_id)
    checked = candidates.join(long.select(snippet_id, "_snippet"), snippet_id).join(d, document_id)
    found = checked.where(F.contains(F.col("_text"), F.col("_snippet"))).select(snippet_id, document_id)
    short = _short_pairs(s.where((F.size("_inner") == 0) & (F.col("_snippet") != "")), d, snippet_id, document_id)
    return found if short is None else found.unionAll(short)


def evidence_pairs(
    snippets: DataFrame, documents: DataFrame, snippet_id: str, document_id: str, text: str = "text"
) -> DataFrame:
    """``(snippet_id, document_id)`` for every document that contains the snippet, after
    white space is normalised on both sides. An empty snippet is in every document that has
    a text."""
    s, d = _prepared(snippets, documents, snippet_id, document_id, text)
    pairs = _pairs(s, d, snippet_id, document_id)
    empty = s.where(F.col("_snippet") == "").select(snippet_id)
    if not empty.limit(1).isEmpty():
        pairs = pairs.unionAll(_short_pairs(empty.withColumn("_snippet", F.lit("")), d, snippet_id, document_id))
    return pairs


def evidence_presence(
    snippets: DataFrame, documents: DataFrame, snippet_id: str, document_id: str, text: str = "text"
) -> DataFrame:
    """Per snippet: required documents, those that contain it, and whether all do. For an
    empty snippet the documents with a text are counted, not listed."""
    s, d = _prepared(snippets, documents, snippet_id, document_id, text)
    found = _pairs(s, d, snippet_id, document_id).groupBy(snippet_id).agg(F.count(F.lit(1)).alias("n_present"))
    sizes = documents.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(text).alias("texts")))
    joined = s.select(snippet_id, "_snippet").join(found, snippet_id, "left").withColumn("_sizes", sizes.scalar())
    present = F.when(F.col("_snippet") == "", F.col("_sizes.texts")).otherwise(F.coalesce("n_present", F.lit(0).cast("bigint")))
    required = F.col("_sizes.n")
    return joined.select(
        snippet_id, required.alias("n_required"), present.alias("n_present"),
        (required - present).alias("n_missing"), (required == present).alias("present_in_all"),
    )


def missing_evidence(required: DataFrame, pairs: DataFrame, snippet_id: str, document_id: str) -> DataFrame:
    """The required (snippet, document) pairs in which the snippet does not occur."""
    return required.select(snippet_id, document_id).join(pairs, [snippet_id, document_id], "left_anti")
