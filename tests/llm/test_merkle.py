import random
from hashlib import sha256

import pytest
from effectlab.llm import merkle
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "lang", "text")


def h(text):
    return sha256(text.encode()).hexdigest()


def spelled(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, at):
    """The siblings of leaf ``at`` from the bottom up, and the root."""
    proof = []
    while len(nodes) > 1:
        first = at // 8 * 8
        proof.append(([*nodes[first:at]], [*nodes[at + 1 : first + 8]]))
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return proof, nodes[0]


def brute(rows):
    """Rows (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, lang, text, claim)."""
    groups = {}
    for doc_id, lang, text, claim in rows:
        groups.setdefault(lang, []).append((doc_id, spelled(doc_id, lang, text), claim))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    roots = {g: climb([r[1] for r in groups[g]], 0)[1] for g in order}
    out = []
    for rank, g in enumerate(order):
        above, root = climb([roots[x] for x in order], rank)
        for at, (doc_id, leaf, claim) in enumerate(groups[g]):
            path = climb([r[1] for r in groups[g]], at)[0] + above
            node = leaf if claim is None else claim
            for left, right in path:
                node = h("".join([*left, node, *right]))
            proof = h("".join("".join(left + right) for left, right in path))
            out.append((doc_id, leaf, roots[g], root, proof, node, node == root))
    return out


def made(spark, rows, part_leaves, parts=3):
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string, claim string").repartition(parts)
    leaves = df.select("doc_id", F.col("lang").alias("group"), merkle.leaf(*[F.col(c) for c in COLUMNS]).alias("leaf"), "claim")
    return merkle.manifest(leaves, ["doc_id"], part_leaves)


def read(proofs):
    key = lambda r: tuple((x is not None, x) for x in r)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in proofs.collect()), key=key)


def same(got, want):
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def random_rows(n, langs, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(langs), rng.choice([None, "", "Text é", "x" * rng.randrange(9)]), None if rng.random() < 0.6 else h(str(i))) for i in range(n)]


@pytest.mark.parametrize("n, langs, part_leaves", [(150, ["en", "de", None, "é", "EN"], 11), (600, ["en"], 37), (64, ["a"], 8), (9, ["a", "b"], 1000), (1, [None], 5)])
def test_proofs_equal_brute_force(spark, n, langs, part_leaves):
    rows = random_rows(n, langs, n)
    same(read(merkle.prove(made(spark, rows, part_leaves), "claim")), brute(rows))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, "a", "t", None), (None, None, None, h("x")), (3, "a", "one", None), (3, "a", "two", None), (4, "a", "L" * 300_000, None)]
    rows += [(7, "hot", "same", None)] * 90 + [(i, "hot", None, None) for i in range(40)]
    same(read(merkle.prove(made(spark, rows, 13), "claim")), brute(rows))


def test_equal_rows_are_dealt_to_several_partitions(spark):
    got = made(spark, [(7, "hot", "same", None)] * 200, 20)
    assert got.groups.leaves.select("part").distinct().count() > 5
    assert sorted(r["pos"] for r in got.groups.leaves.select("pos").collect()) == list(range(200))


def test_an_empty_table(spark):
    assert merkle.prove(made(spark, [], 10), "claim").count() == 0


def test_a_claim_that_is_the_leaf_is_verified_and_any_other_is_not(spark):
    rows = [(i, "en", f"Text {i}", None) for i in range(100)]
    rows = [(i, g, t, spelled(i, g, t.lower() if i % 3 == 0 else t) if i % 2 else None) for i, g, t, _ in rows]
    got = {r["doc_id"]: r["verified"] for r in merkle.prove(made(spark, rows, 30), "claim").collect()}
    assert got == {i: not (i % 2 and i % 3 == 0) for i in range(100)}


def test_some_leaves_are_proved_alone(spark):
    rows = random_rows(300, ["en", "de", None], 5)
    manifest = made(spark, rows, 40)
    chosen = manifest.groups.leaves.where("doc_id % 17 = 0")
    want = [r for r in brute(rows) if r[0] % 17 == 0]
    same(read(merkle.prove(manifest, "claim", chosen)), want)


def test_the_octopus_is_the_least_union():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 700)
        own = sorted(rng.sample(range(n), rng.randrange(1, min(n, 40) + 1)))
        needed, known = set(), set()
        for at in own:
            size, i, level = n, at, 0
            known.add((0, at))
            while size > 1:
                needed |= {(level, j) for j in range(i // 8 * 8, min(size, i // 8 * 8 + 8)) if j != i}
                size, i, level = -(-size // 8), i // 8, level + 1
                known.add((level, i))
        assert set(merkle.missing([(i, i) for i in own], n)) == needed - known


def test_lowered_leaves_other_letters(spark):
    row = spark.createDataFrame([("AÉZ[a", None)], "a string, b string").select(merkle.lowered(F.col("a")), merkle.lowered(F.col("b"))).first()
    assert row == ("aÉz[a", None)
