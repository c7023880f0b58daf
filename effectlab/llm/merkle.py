"""Merkle manifest of a dataset, and proofs for all its rows by octopus multiproofs.

Every row is a leaf. The leaves of a group (a language) are ordered and made into a tree
of ``ARITY`` children a node; the groups' roots, ordered by group, are made into a tree of
the same kind, whose root stands for the dataset. The manifest is three tables in the
shared folder: leaves with their positions, complete nodes, and group roots.

*Building.* Leaves are exchanged once, by range of (group, key), so that a partition holds
runs of neighbouring leaves; its rows are numbered as they are read, and the sizes of all
runs, added up, give the positions. A leaf partition then derives all the nodes whose
leaves it has. Only nodes at the rims of partitions, a few a level, are joined with those
of neighbours, level by level. No group is gathered: a language with all rows is spread
over as many partitions as any other rows.

*Proving.* A partition knows its leaves' positions and so the coordinates (level, index)
on their paths. The siblings that aren't on a path of its own are what it misses: the
least union of coordinates for all of its proofs. Those are fetched in one join; the
partition then derives every interior node that its proofs share once, and expands the
proof of each leaf from the runs it has. A claimed leaf is folded with its own proof up to
a root, and verified against that of the manifest.

Defined results: nulls are spelled ``-``, null keys and groups come first; rows with equal
keys are ordered by leaf, equal leaves take neighbouring positions; a very long text is
read by the task that has it, only digests move; a table without rows has no proofs and
no root; other columns pass through :func:`leaf`, and clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.session import written

ARITY = 8
#: Leaves that one partition holds, about.
PART_LEAVES = 20_000


def field(value: Column) -> Column:
    """A value as bytes that tell it from any other: ``-`` or its length, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Tree:
    """Tables of a forest: ``leaves`` (part, group, pos, n, leaf, other columns), ``nodes``
    (group, level, idx, hash, edge), ``runs`` (part, group, first, last, n) and ``roots``
    (group, n, root). An ``edge`` is a node whose parent no single partition could derive."""

    leaves: DataFrame
    nodes: DataFrame
    runs: DataFrame
    roots: DataFrame


def _numbered(schema: T.StructType):
    """Rows of a sorted partition with their place in the partition's run of the group."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = object(), 0
        for batch in batches:
            group = batch.column(names.index("group")).to_pylist()
            places = []
            for value in group:
                place = place + 1 if value == last else 0
                last = value
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*names, "place"])

    return run


def _levels(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, from the leaves to the root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def _complete(pos: np.ndarray, hashes: list[str], n: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, index, hash, edge) of the inner nodes over a run of neighbouring leaves, and of
    leaves at its edges."""
    first, sizes = int(pos[0]), _levels(n)
    for level, size in enumerate(sizes):
        last = first + len(hashes)
        above, upto = -(-first // ARITY), last // ARITY if last < size else -(-size // ARITY)
        for i, h in enumerate(hashes):
            edge = level + 1 < len(sizes) and not above <= (first + i) // ARITY < upto
            if level or edge:
                yield level, first + i, h, edge
        if level + 1 == len(sizes):
            return
        hashes = [_h("".join(hashes[max(0, ARITY * p - first) : ARITY * (p + 1) - first])) for p in range(above, upto)]
        if not hashes:
            return
        first = above


_NODE = "group string, level int, idx bigint, hash string, edge boolean"


def _derive(key: tuple, table: pa.Table) -> pa.Table:
    frame = table.select(["group", "pos", "leaf", "n"]).to_pandas().sort_values("pos", kind="stable")
    rows = []
    for _, one in frame.groupby(frame["group"].isna().astype(str) + frame["group"].fillna(""), sort=False):
        group = one["group"].iloc[0]
        group = None if pd.isna(group) else group
        rows += [(group, *node) for node in _complete(one["pos"].to_numpy(), one["leaf"].tolist(), int(one["n"].iloc[0]))]
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group", "level", "idx", "hash", "edge"])


def _same(left: str, right: str, *columns: str) -> Column:
    """Equality of columns of two aliases, nulls equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def grow(leaves: DataFrame, order: Sequence[str], part_leaves: int = PART_LEAVES) -> Tree:
    """The trees of ``leaves`` (columns ``group`` string, ``leaf`` and others), one a group,
    with leaves in the order of columns ``order``, then by leaf."""
    rows = written(leaves, "merkle-rows")
    parts = max(1, -(-rows.count() // part_leaves))
    # The last key lets even a group of equal rows be dealt to several partitions.
    keys = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("leaf").asc()]
    turn = rows.withColumn("_turn", F.monotonically_increasing_id())
    dealt = turn.repartitionByRange(parts, *keys, F.col("_turn").asc()).sortWithinPartitions(*keys, "_turn").drop("_turn").withColumn("part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())])
    numbered = written(dealt.mapInArrow(_numbered(dealt.schema), schema), "merkle-leaves")
    sizes = numbered.groupBy("part", "group").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.select("part", "group", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(Window.partitionBy("group")).alias("n"), "rows")
    runs = written(runs.select("part", "group", "first", (F.col("first") + F.col("rows") - 1).alias("last"), "n"), "merkle-runs")
    placed = numbered.alias("a").join(runs.alias("b"), _same("a", "b", "part", "group")).select("a.*", F.col("b.n"), (F.col("b.first") + F.col("a.place")).alias("pos")).drop("place")
    inner = written(placed.select("part", "group", "pos", "leaf", "n").groupBy("part").applyInArrow(_derive, _NODE), "merkle-nodes")
    # What partitions share: nodes whose siblings lie in another one, joined level by level.
    depth = len(_levels(runs.agg(F.max("n")).first()[0] or 1))
    totals = runs.groupBy("group").agg(F.max("n").alias("n"))
    open_ = written(inner.where("edge").alias("a").join(totals.alias("b"), _same("a", "b", "group")).select("a.group", "level", "idx", "hash", "b.n"), "merkle-edges")
    made, joined = [], None
    for level in range(depth - 1):
        here = open_.where(F.col("level") == level).select("group", "idx", "hash", "n")
        here = here.unionAll(joined) if joined is not None else here
        children = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = here.groupBy("group", "n", F.expr(f"idx div {ARITY}").alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256).alias("hash"))
        made.append(up.select("group", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "hash", F.lit(True).alias("edge"), "n"))
        # The width of the level that was made; a level of one node is the root.
        width = F.ceil(F.col("n") / F.lit(ARITY ** (level + 1)))
        joined = up.where(width > 1).select("group", F.col("up").alias("idx"), "hash", "n")
    shared = None
    for one in made:
        shared = one if shared is None else shared.unionAll(one)
    nodes = inner if shared is None else inner.unionAll(written(shared, "merkle-shared").select(inner.columns))
    tops = nodes.where("idx = 0").alias("a").join(totals.alias("b"), _same("a", "b", "group")).select("a.group", "a.level", "a.hash", "b.n")
    top = tops.groupBy("group", "n").agg(F.max_by("hash", "level").alias("root"))
    alone = placed.where("n = 1").select("group", "n", F.col("leaf").alias("root"))
    return Tree(placed, nodes, runs, written(top.where("n > 1").unionAll(alone), "merkle-roots"))


@dataclass(frozen=True)
class Manifest:
    """The groups' trees, and the tree over their roots."""

    groups: Tree
    top: Tree


def manifest(leaves: DataFrame, order: Sequence[str], part_leaves: int = PART_LEAVES) -> Manifest:
    """The manifest of ``leaves`` (``group``, ``leaf``, the columns ``order`` and others)."""
    groups = grow(leaves, order, part_leaves)
    tops = groups.roots.select(F.lit("").alias("group"), F.col("group").alias("member"), F.col("root").alias("leaf"))
    return Manifest(groups, grow(tops, ["member"], part_leaves))


def missing(runs: Sequence[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The octopus: coordinates (level, index) that the proofs of all leaves in ``runs``
    (first, last) need and their leaves don't give."""
    own = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in runs]))
    out = []
    for level, size in enumerate(_levels(n)[:-1]):
        up = np.unique(own // ARITY)
        whole = (up[:, None] * ARITY + np.arange(ARITY)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(whole[whole < size], own, assume_unique=True)]
        own = up
    return out


def _wanted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, one in frame.groupby(frame["group"].isna().astype(str) + frame["group"].fillna("")):
        coordinates = missing(list(zip(one["first"].tolist(), one["last"].tolist())), int(one["n"].iloc[0]))
        rows += [(key[0], one["group"].iloc[0], level, idx) for level, idx in coordinates]
    return pd.DataFrame(rows, columns=["part", "group", "level", "idx"])


def _fetched(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, group, level, idx, hash): one join gives each partition what it misses."""
    wanted = runs.groupBy("part").applyInPandas(_wanted, "part int, group string, level int, idx bigint")
    return wanted.alias("a").join(nodes.alias("b"), _same("a", "b", "group", "level", "idx")).select("a.part", "a.group", "a.level", "a.idx", "b.hash")


class _Paths:
    """The runs of sibling digests that the proofs of some leaves of a tree go through."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.sizes, self.runs = _levels(n), []
        for level, size in enumerate(self.sizes[:-1]):
            joined = {}
            for up in {i // ARITY for i in own}:
                places = range(up * ARITY, min(size, up * ARITY + ARITY))
                joined[up] = "".join(own[i] if i in own else fetched[(level, i)] for i in places)
            self.runs.append(joined)
            own = {up: _h(run) for up, run in joined.items()}
        self.root = own[0]

    def siblings(self, at: int) -> Iterator[tuple[str, str]]:
        """Digests left and right of the node on the path from leaf ``at``, level by level."""
        for joined in self.runs:
            at, place = divmod(at, ARITY)
            yield joined[at][: 64 * place], joined[at][64 * (place + 1) :]


def _fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = _h(left + node + right)
    return node


def prove(made: Manifest, claim: str, chosen: DataFrame | None = None) -> DataFrame:
    """A proof for every leaf of the manifest, or for the leaves of ``chosen`` (rows of
    ``made.groups.leaves``): its columns but ``part``, ``place`` and ``n``, with ``subroot``,
    ``root``, ``proof_sha256`` (digest of all siblings, from the leaf up, left to right),
    ``folded_root`` (from column ``claim``, or the leaf where that is null) and ``verified``."""
    trees, leaves = made.groups, made.groups.leaves
    if chosen is None:
        runs, nodes = trees.runs, trees.nodes.select("group", "level", "idx", "hash")
    else:
        leaves = chosen
        runs = chosen.select("part", "group", F.col("pos").alias("first"), F.col("pos").alias("last"), "n")
        # Any leaf can be a sibling of a chosen one, so all are among the nodes.
        inner = trees.nodes.where("level > 0").select("group", "level", "idx", "hash")
        nodes = inner.unionAll(trees.leaves.select("group", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash")))
    top = made.top
    ranks = top.leaves.select(F.col("member").alias("group"), F.col("pos").alias("rank"), F.col("n").alias("groups"))
    ranked = runs.select("part", "group").distinct().alias("a").join(ranks.alias("b"), _same("a", "b", "group")).select("a.part", "a.group", "b.rank", "b.groups")
    upper = ranked.select("part", F.lit("").alias("group"), F.col("rank").alias("first"), F.col("rank").alias("last"), F.col("groups").alias("n"))
    top_nodes = top.nodes.where("level > 0").select("group", "level", "idx", "hash").unionAll(
        top.leaves.select("group", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash")))
    # Given to each partition: digests of its own trees, of the top tree, and the ranks of its groups.
    none = F.lit(None)
    given = (
        _fetched(runs, nodes).select("part", F.lit("node").alias("kind"), "group", "level", "idx", "hash")
        .unionAll(_fetched(upper, top_nodes).select("part", F.lit("top").alias("kind"), "group", "level", "idx", "hash"))
        .unionAll(ranked.select("part", F.lit("rank").alias("kind"), "group", F.col("groups").cast("int").alias("level"), F.col("rank").alias("idx"), none.cast("string").alias("hash")))
    )
    kept = [f for f in leaves.schema.fields if f.name not in ("part", "n")]
    schema = T.StructType([*kept, *(T.StructField(c, T.StringType()) for c in ("subroot", "root", "proof_sha256", "folded_root"))])
    names = [f.name for f in kept]

    def expand(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        nodes: dict = {}
        for r in told:
            if r["kind"] == "node":
                nodes.setdefault(r["group"], {})[(r["level"], r["idx"])] = r["hash"]
        tops = {(r["level"], r["idx"]): r["hash"] for r in told if r["kind"] == "top"}
        rank = {r["group"]: r["idx"] for r in told if r["kind"] == "rank"}
        groups, pos, digest, n = (left.column(c).to_pylist() for c in ("group", "pos", "leaf", "n"))
        claims = left.column(claim).to_pylist()
        own: dict = {}
        size: dict = {}
        for g, p, d, m in zip(groups, pos, digest, n):
            own.setdefault(g, {})[p] = d
            size[g] = m
        paths = {g: _Paths(own[g], nodes.get(g, {}), size[g]) for g in own}
        head = _Paths({rank[g]: path.root for g, path in paths.items()}, tops, next(r["level"] for r in told if r["kind"] == "rank")) if own else None
        above = {g: list(head.siblings(rank[g])) for g in own}
        made = [[], [], [], []]
        for g, p, d, c in zip(groups, pos, digest, claims):
            path = [*paths[g].siblings(p), *above[g]]
            proof = sha256()
            for before, after in path:
                proof.update(before.encode())
                proof.update(after.encode())
            for column, value in zip(made, (paths[g].root, head.root, proof.hexdigest(), _fold(d if c is None else c, path))):
                column.append(value)
        return pa.Table.from_arrays([*(left.column(c) for c in names), *(pa.array(x, pa.string()) for x in made)], [*names, "subroot", "root", "proof_sha256", "folded_root"])

    proofs = leaves.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(expand, schema)
    # The manifest's word counts, not the partition's: a proof that doesn't fit is not verified.
    known = top.roots.select("root").scalar()
    return proofs.withColumn("root", known).withColumn("verified", F.col("folded_root") == F.col("root"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _sql_tree(name: str, leaves: str) -> str:
    """All nodes (grp, level, idx, hash, n) over rows (grp, pos, leaf, n)."""
    return f"""
{name}(grp, level, idx, hash, n) AS (
  SELECT grp, 0, pos, leaf, n FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, idx // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx)), (n + {ARITY - 1}) // {ARITY}
  FROM {name} WHERE n > 1 GROUP BY grp, level, idx // {ARITY}, n
), {name}_runs AS (
  SELECT grp, level, idx // {ARITY} AS up, list(hash ORDER BY idx) AS hashes FROM {name} WHERE n > 1 GROUP BY ALL
)"""


#: The digests of the query over ``documents``: trees and paths as recursive tables.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS crc,
         {" || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text FROM documents
), l AS (
  SELECT doc_id, lang AS grp, sha256(head || {_sql_field("text")}) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || {_sql_field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS claim FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM l
), {_sql_tree("low", "p")}, subroots AS (
  SELECT grp, hash FROM low WHERE n = 1
), t AS (
  SELECT '' AS grp, grp AS lang, hash AS leaf, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM subroots
), {_sql_tree("high", "t")}, low_walk(doc_id, grp, level, idx, node, proof) AS (
  SELECT doc_id, grp, 0, pos, coalesce(claim, leaf), '' FROM p
  UNION ALL
  SELECT w.doc_id, w.grp, w.level + 1, w.idx // {ARITY},
         sha256(array_to_string(list_transform(hashes, lambda h, i: CASE WHEN i = idx % {ARITY} + 1 THEN node ELSE h END), '')),
         proof || array_to_string(list_filter(hashes, lambda h, i: i <> idx % {ARITY} + 1), '')
  FROM low_walk w JOIN low_runs r ON w.grp IS NOT DISTINCT FROM r.grp AND w.level = r.level AND w.idx // {ARITY} = r.up
), low_end AS (
  SELECT doc_id, grp, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM low_walk GROUP BY doc_id, grp
), walk(doc_id, grp, level, idx, node, proof) AS (
  SELECT doc_id, e.grp, 0, t.pos, node, proof FROM low_end e JOIN t ON e.grp IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT w.doc_id, w.grp, w.level + 1, w.idx // {ARITY},
         sha256(array_to_string(list_transform(hashes, lambda h, i: CASE WHEN i = idx % {ARITY} + 1 THEN node ELSE h END), '')),
         proof || array_to_string(list_filter(hashes, lambda h, i: i <> idx % {ARITY} + 1), '')
  FROM walk w JOIN high_runs r ON w.level = r.level AND w.idx // {ARITY} = r.up
), ends AS (
  SELECT doc_id, grp, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM walk GROUP BY doc_id, grp
)
SELECT p.doc_id, p.leaf, s.hash AS subroot, h.hash AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = h.hash AS verified
FROM p JOIN ends e ON p.doc_id = e.doc_id AND p.grp IS NOT DISTINCT FROM e.grp
JOIN subroots s ON p.grp IS NOT DISTINCT FROM s.grp, (SELECT hash FROM high WHERE n = 1) h"""
