import os

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from effectlab.llm import bpe
from test_secrets import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs.toPandas().set_index("doc_id")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        made.append(docs.toPandas().set_index("doc_id"))
    return made


def test_quality_keeps_clean_documents_and_drops_junk(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    kept = labels.index.isin(stages[1].index)
    clean = (labels["quality"] == 1) & (labels["toxic"] == 0)
    assert kept[clean].mean() > 0.95 and kept[labels["quality"] == 0].mean() < 0.2


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    texts = before.reset_index().groupby(before["text"].str.lower().str.split().str.join(" ").values)["doc_id"].min()
    assert set(after.index) <= set(texts)
    assert len(after) > 0.8 * len(texts)


def test_leaks_go_and_the_rest_stays(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = stages[2]["text"].map(lambda t: any(i in t for i in items))
    assert set(stages[3].index) == set(stages[2].index[~leaky])


def test_secrets_are_replaced_and_other_texts_unchanged(stages):
    from test_secrets import brute

    same = 0
    for doc_id, row in stages[4].iterrows():
        assert brute(row["text"]) == "" and row["n_chars"] == len(row["text"])
        same += row["text"] == stages[3].loc[doc_id, "text"]
        assert (row["text"] == stages[3].loc[doc_id, "text"]) == (brute(stages[3].loc[doc_id, "text"]) == "")
    assert same > 0.8 * len(stages[4])
    assert list(stages[4].columns) == list(stages[0].columns)


def test_ids_are_those_of_the_library(stages):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc_id, row in stages[5].iterrows():
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode_ordinary(stages[4].loc[doc_id, "text"])
    assert len(stages[5]) == len(stages[4])


CHECKS = {"pipeline": "test_ids_are_those_of_the_library"}
