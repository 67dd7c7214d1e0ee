"""The fold of merges in Spark's own functions gives the library's ids."""

import public_tokenizers
import pytest

from lakeweave.llm import bpe, bpe_columns


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_words_of_documents(spark, docs, ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    words = sorted({w for r in docs.limit(40).collect() for w in codec.split(r["text"])} | {" ", "a" * 40, "é😀", "\n\n", "xyzxyzxyz", "12345678901234567890"})
    rows = bpe_columns.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert len(rows) == len(words)
    for r in rows:
        assert list(r["ids"]) == bpe.merge(r["word"].encode(), ranks)
        assert bytes(r["decoded"]) == r["word"].encode()


def test_nulls_and_nothing(spark, ranks):
    df = spark.createDataFrame([("",), (None,)], "word string")
    assert [(r["word"], list(r["ids"])) for r in bpe_columns.encode_words(df, ranks).collect()] == [("", []), (None, [])]
    assert bpe_columns.encode_words(df.where("false"), ranks).count() == 0


def test_is_native(spark, ranks):
    plan = bpe_columns.encode_words(spark.createDataFrame([("a",)], "word string"), ranks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
