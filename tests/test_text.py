from __future__ import annotations

import hashlib

import pytest
from batchloom.functions import arrays, text
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ids(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


@pytest.mark.parametrize("value", [None, "", " \t\n", "a", "  a b\t\nc ", " a ", "a\x0bb\x0cc"])
def test_strip_and_words(spark, value):
    bare = (value or "").strip(" \t\n\r\x0b\x0c")
    assert one(spark, text.strip(F.lit(value).cast("string"))) == bare
    words = [w for w in bare.replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").split(" ") if w]
    assert one(spark, text.words(F.lit(value).cast("string"))) == words
    assert one(spark, text.n_words(F.lit(value).cast("string"))) == len(words)


def test_ids_are_hashes(spark):
    expected = [3 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 97 for w in ("naïve", "b")]
    assert one(spark, text.token_ids(F.lit(" naïve  b "), 97)) == expected
    assert one(spark, text.token_ids(F.lit(None).cast("string"), 97)) == []


@pytest.mark.parametrize(("given", "expected"), [([5, 2], [5, 2]), ([5], [5, 2]), ([], [2])])
def test_ensure_eos(spark, given, expected):
    assert one(spark, text.ensure_eos(ids(*given), 2)) == expected


def test_any_tokenizer(spark):
    encode = text.tokenizer_udf(lambda: lambda batch: [[len(w) for w in t.split()] for t in batch])
    df = spark.createDataFrame([(1, "a bb"), (2, None)], "i int, t string")
    assert {r.i: r.x for r in df.select("i", encode("t").alias("x")).collect()} == {1: [1, 2], 2: []}


def test_decode(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "idx int, t string")
    vocab = text.vocabulary(df, "t")
    got = text.decode(df.select("idx", text.token_ids(F.col("t")).alias("ids")), vocab)
    assert {r.idx: r.text for r in got.collect()} == {1: "b a b", 2: "", 3: ""}


def test_array_helpers(spark):
    assert one(spark, arrays.pad_to(ids(1, 2), F.lit(4), 0)) == [1, 2, 0, 0]
    assert one(spark, arrays.pad_to(ids(1, 2), F.lit(1), 0)) == [1, 2]
    assert one(spark, arrays.mask_to(F.lit(2), F.lit(3))) == [1, 1, 0]
    assert one(spark, arrays.set_last(ids(), 9)) == [9] and one(spark, arrays.set_last(ids(1, 2), 9)) == [1, 9]
    assert one(spark, arrays.head(ids(1, 2), -3)) == []
    assert one(spark, arrays.masked_labels(ids(1, 2, 3), F.lit(2))) == [-100, -100, 3]
    assert one(spark, arrays.masked_labels(ids(1), F.lit(2))) == [-100]
    assert one(spark, arrays.response_labels(F.lit(1), ids(7), F.lit(4))) == [-100, 7, -100, -100]
