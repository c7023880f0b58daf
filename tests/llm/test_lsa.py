import random

import numpy as np
from effectlab.llm import lsa


def fixture():
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else "".join(rng.choice(["ba", "ne", "ro", "ti", "lus"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([14, 30, 55])) + ". " + text(6) + ".") for i in range(12)] + [(50, text(300))]
    docs = [(i, text(rng.randrange(0, 400))) for i in range(150)]
    leaks = set()
    for n, (item, words) in enumerate(items):
        docs.append((1000 + n, text(150) + " " + words + " " + text(90)))
        leaks.add((1000 + n, item))
        changed = words.split()
        for k in rng.sample(range(len(changed)), len(changed) // 6):
            changed[k] = "other"
        docs.append((2000 + n, text(60) + " " + " ".join(changed) + " " + text(60)))
        leaks.add((2000 + n, item))
    return docs, items, leaks


def test_verbatim_and_paraphrased_items_are_found_and_clean_texts_are_not(spark):
    docs, items, leaks = fixture()
    odd = [(3000, None), (3001, ""), (3002, "x")]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs + odd], "doc_id int, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items + [(60, None), (61, ""), (None, "x y")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lsa.leaks(table, bench).collect()}
    assert {g for g in got if g[0] < 2000} == {x for x in leaks if x[0] < 2000}
    assert len(got & leaks) >= 0.9 * len(leaks) and got <= leaks


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items, _ = fixture()
    table, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    verbatim = lambda rows: {(r["doc_id"], r["item_id"]) for r in rows if 1000 <= r["doc_id"] < 2000}
    whole = verbatim(lsa.leaks(table, bench).collect())
    monkeypatch.setattr(lsa, "BLOCK_PASSAGES", 15)
    assert verbatim(lsa.leaks(table, bench).collect()) == whole


def test_marks_keep_rows_and_columns_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], "doc_id int, text string, leaks string")
    bench = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    rows = lsa.mark(docs, bench).collect()
    assert len(rows) == 2 and all(r["leaks"][0]["item_id"] == 1 for r in rows)
    assert lsa.leaks(docs.limit(0), bench).count() == 0 and lsa.leaks(docs, bench.limit(0)).count() == 0


def test_longest_common_subsequence_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert lsa.common(a.astype(np.uint64), b.astype(np.uint64)) == table[-1, -1]


def test_short_items_are_found_verbatim_and_with_a_word_changed(spark):
    rng = random.Random(31)
    words = ["the", "of", "and", "in", "is"] + ["".join(rng.choice(["ba", "ne", "ro", "ti", "lus", "ka"]) for _ in range(3)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words[:5]) if rng.random() < 0.4 else rng.choice(words[5:]) for _ in range(n))
    items = [(i, text(size)) for i, size in enumerate(s for s in (4, 6, 8, 11, 16, 24, 40) for _ in range(12))]
    docs = [(5000 + i, text(300)) for i in range(120)]
    docs += [(i, text(70) + " " + item + " " + text(50)) for i, item in items]
    changed = {}
    for i, item in items:
        parts = item.split()
        if len(parts) >= 16:
            parts[rng.randrange(len(parts))] = "changed"
            changed[1000 + i] = i
            docs.append((1000 + i, text(70) + " " + " ".join(parts) + " " + text(50)))
    got = {(r["doc_id"], r["item_id"]) for r in lsa.leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    padded = {d: f" {t} " for d, t in docs}
    brute = {(d, i) for d, t in padded.items() for i, item in items if f" {item} " in t}
    assert len(got & brute) >= 0.98 * len(brute)
    assert len(got & set(changed.items())) >= 0.95 * len(changed)
    assert len(got - brute - set(changed.items())) <= 0.02 * len(got)


CHECKS = {"op9_latent_leaks": "test_short_items_are_found_verbatim_and_with_a_word_changed"}
