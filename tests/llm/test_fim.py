import hashlib
import random
import re

import numpy as np
import pytest
from effectlab.llm import fim
from pyspark.sql import functions as F

SHAPES = {
    "array": np.arange(0, 60000, 37),
    "bitmap": np.flatnonzero(np.random.default_rng(1).random(1 << 16) < 0.3),
    "runs": np.concatenate([np.arange(100, 9000), np.arange(20000, 20003), np.arange(40000, 65536)]),
    "many containers": np.flatnonzero(np.random.default_rng(2).random(400_000) < 0.02),
    "a gap of containers": np.array([0, 5, 70000, 1 << 30, (1 << 30) + 1, (1 << 40) + 7]),
    "one": np.array([0]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_every_boundary_is_selected(name):
    offsets = SHAPES[name]
    packed = fim.pack(offsets)
    assert fim.cardinality(packed) == len(offsets)
    some = range(len(offsets)) if len(offsets) < 3000 else [0, 1, 63, 64, 65, 4095, 4096, len(offsets) - 2, len(offsets) - 1, *range(7, len(offsets), 101)]
    assert all(fim.select(packed, k) == offsets[k] for k in some if k < len(offsets))
    for bad in (-1, len(offsets)):
        with pytest.raises(IndexError):
            fim.select(packed, bad)


def test_the_smallest_container_is_taken():
    kinds = {name: set(fim._head(fim.pack(offsets))["kind"].tolist()) for name, offsets in SHAPES.items()}
    assert kinds["array"] == {fim.ARRAY} and kinds["bitmap"] == {fim.BITMAP} and kinds["runs"] == {fim.RUNS}
    assert len(fim.pack(np.arange(1_000_000))) < 1000
    assert fim.cardinality(fim.pack(np.array([], np.int64))) == 0


def brute(doc_id, text, plan=fim.Plan()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+" if plan.unit == "line" else r"(?s).", text)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h[2] % 100 >= plan.rate:
        return n, "plain", None, None, text
    if h[3] % 100 < plan.spm:
        return n, "spm", len(x), len(y), plan.suffix + z + plan.prefix + x + plan.middle + y
    return n, "psm", len(x), len(y), plan.prefix + x + plan.suffix + z + plan.middle + y


def rows():
    rng = random.Random(4)
    pieces = ["a", "é", "漢", "😀", "\n", "\n", " ", "\r\n", "<", "P>", "word"]
    made = [(i, "".join(rng.choices(pieces, k=rng.randrange(60)))) for i in range(400)]
    made += [(900, "x<P>y\nz"), (901, "a\n<S>"), (902, "<M>"), (903, "<"), (904, "<S\n>"), (905, "no end"), (906, "\n"), (907, "\n\n\n")]
    made += [(None, "a\nb\nc\n"), (None, None), (910, None), (911, ""), (1, "again\nagain\n"), (1, "again\nagain\n")]
    made += [(912, "é\n" * 150_000), (913, "long line " * 50_000), (914, "ab\n\n" * 9000 + "\n" * 70_000)]
    return made


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(rate=60, spm=0, seed="s", unit="character"), fim.Plan(spm=100)])
def test_outputs_equal_brute_force_and_are_restored(spark, plan):
    given = rows()
    df = spark.createDataFrame(given, "doc_id int, text string").withColumns({"form": F.lit("old"), "first": F.lit(1.5)})
    made = fim.transform(df, plan, keep_set="cuts").withColumn("back", fim.restore(F.col("output"), F.col("form"), plan)).collect()
    assert {r["first"] for r in made} == {1.5}
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]), (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["back"]) for r in made)
    want = sorted(((i is None, i or 0, t or ""), brute(i, t, plan), t or "") for i, t in given)
    assert got == want
    assert all(fim.cardinality(bytes(r["cuts"])) == r["n"] + 1 for r in made)


def test_an_empty_table_and_an_unknown_unit(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert fim.transform(df).count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, fim.Plan(unit="page"))
