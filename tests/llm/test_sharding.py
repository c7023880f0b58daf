import random

from effectlab.llm import sharding


def placed(spark, rows, shards=4, **how):
    df = sharding.shard(spark.createDataFrame(rows, "doc_id int, text string, shard string"), shards, **how)
    assert df.columns[:2] == ["doc_id", "text"] and len(df.columns) == 5
    return df.toPandas()


def check(got, rows):
    assert len(got) == len(rows)
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in got["text"]]
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_near_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(200) + str(i), "old") for i in range(3000)]
    got = placed(spark, rows)
    check(got, rows)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() < 0.01 * sums.mean() + 2 * 420


def test_a_hot_group_is_split_and_small_groups_stay_together(spark):
    rows = [(i, "hot text " * 5, "") for i in range(2000)] + [(5000 + i, f"pair {i % 500}", "") for i in range(1000)]
    got = placed(spark, rows)
    check(got, rows)
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.05 * sums.mean()
    pairs = got[got["doc_id"] >= 5000].groupby("text")["shard"].nunique()
    assert (pairs > 1).sum() <= 3


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(1, None, ""), (1, None, ""), (None, "", ""), (None, None, ""), (2, "x" * 100000, ""), (3, "y", ""), (3, "y", "")]
    check(placed(spark, rows, 3), rows)
    check(placed(spark, rows[:0], 3), [])
    check(placed(spark, rows[:1], 16), rows[:1])


def test_order_is_by_content(spark):
    rows = [(i, f"text {i % 50}", "") for i in range(400)]
    got = placed(spark, rows, 2, ranges=2).sort_values(["shard", "slot"])
    runs = (got["text"] != got["text"].shift()).sum()
    assert runs <= 51


def test_rows_equal_in_id_and_text_are_split(spark):
    rows = [(7, "the same text again and again", "")] * 4000 + [(100 + i, f"s{i}", "") for i in range(400)]
    got = placed(spark, rows, 16)
    check(got, rows)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= 4 * 30


def test_texts_can_be_left_out(spark):
    df = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(50)], "doc_id int, text string, size int")
    got = sharding.shard(df, 4, keep_text=False)
    assert got.columns == ["doc_id", "size", "shard", "slot"] and got.agg({"size": "sum"}).first()[0] == sum(len(f"text {i}") + 1 for i in range(50))


CHECKS = {"op7_sharding": "test_near_equal_bytes_and_gapless_slots"}
