import collections
import random
import re

import numpy as np
from effectlab.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b c a b c d", "x x x x", None, "", " \n\t ", "one line\none line\n\none line", "é ü # $$ |\r\n<b>", "w " * 3000, "same\nsame", "a b c\nb c a b c", "tail\n"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct": len(set(words))}


def test_statistics_against_python(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["aa", "b", "é#", "d\n", "e"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "n_words int, text string").withColumnRenamed("n_words", "k")
    for row in rules.statistics(docs).collect():
        want = brute(texts[row["k"]])
        assert {c: row[c] for c in want} == want


def test_a_clashing_column_is_replaced_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id int, text string, n_words string")
    assert rules.statistics(docs).first()["n_words"] == 2
    assert rules.statistics(docs.limit(0)).count() == 0


def test_learns_a_threshold_and_a_conjunction():
    rng = np.random.default_rng(1)
    table = {"a": rng.random(900), "b": rng.random(900)}
    bad = (table["a"] > 0.8) | ((table["a"] < 0.3) & (table["b"] < 0.4))
    learned = rules.learn(table, bad)
    said = np.zeros(900, bool)
    for rule in learned:
        said |= rules._covers(rule, table, np.ones(900, bool))
    assert (said == bad).mean() > 0.97


def test_one_class_gives_an_empty_list_that_keeps_everything(spark):
    assert rules.learn({"a": np.arange(9.0)}, np.zeros(9, bool)) == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, quality int")
    table, bad = rules.labelled(docs, labels)
    assert rules.statistics(docs).withColumn("rule", rules.rejecting_rule(rules.learn(table, bad))).where("rule IS NULL").count() == 1


def test_the_emitted_expression_is_the_list(spark):
    texts = ["word " * 60, "## $$ %% " * 30] * 30
    docs = spark.createDataFrame([(i, t + f" x{i}") for i, t in enumerate(texts)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id int, quality int")
    learned = rules.learn(*rules.labelled(docs, labels))
    got = rules.statistics(docs).withColumn("rule", rules.rejecting_rule(learned)).collect()
    assert all((r["rule"] is not None) == (r["doc_id"] % 2 == 1) for r in got)


CHECKS = {"op4_decision_list": "test_statistics_against_python"}
