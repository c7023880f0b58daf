import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from effectlab.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = [
    "The quick brown fox, it's 12345 naïve cafés!", None, "", "  \n\n x　y  ", "日本語 🎉🎉 é" * 5, "aaaa bbbbb " * 9,
    "-" * 3001, "z" * 2000, "\x00\x01\x02", "don't DON'T we'll", " leading and trailing ", "same text", "same text",
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encodes_like_the_library_and_decodes_back(spark, reference):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string").withColumnRenamed("n", "ids_of")
    made = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="again")
    rows = bpe.unpack(bpe.decode(made, RANKS)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        text = TEXTS[row["ids_of"]] or ""
        assert row["ids"] == reference.encode_ordinary(text)
        assert bytes(row["decoded"]) == bytes(row["again"]) == text.encode()


def test_clashing_columns_are_replaced_and_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([("ab", "x", "y")], "text string, ids string, _codes string")
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN).columns == ["text", "ids"]
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_chunks_do_not_change_the_ids(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    texts = [f"word{i} wordy{i % 3} zyx{i * 7}" for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = bpe.unpack(bpe.encode(docs, RANKS, public_tokenizers.PATTERN)).collect()
    assert {r["text"]: r["ids"] for r in rows} == {t: reference.encode_ordinary(t) for t in texts}


def test_a_chunk_holds_no_texts():
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": ["word " * 200] * 2000})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    number = bpe._number_words(public_tokenizers.PATTERN, "text", ["doc_id"], RANKS, bpe.merges(RANKS))
    made = list(number(pa.ipc.open_stream(sink.getvalue())))
    texts = [b for b in made if b.column("_codes").null_count == 0]
    assert sum(b.num_rows for b in texts) == 2000 and max(b.num_rows for b in texts) <= bpe.ROWS
    # A buffer with a parent is a part of the message that has the texts too.
    assert all(b.column("doc_id").buffers()[1].parent is None for b in texts)


def test_merges_refuse_a_token_below_its_parts():
    with pytest.raises(ValueError):
        bpe.merges({b"a": 0, b"b": 1, b"c": 2, b"ab": 9, b"abc": 4})


CHECKS = {"op1_byte_bpe": "test_encodes_like_the_library_and_decodes_back"}
