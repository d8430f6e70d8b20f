"""Strip, words, and the hash tokenizer, all as built-in expressions.

Null text counts as empty everywhere: it has no words and no ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def strip(text: Column) -> Column:
    """Text without white space at either end; null as empty."""
    return F.coalesce(F.regexp_replace(text, f"^{SPACE}|{SPACE}$", ""), F.lit(""))


def filled(text: Column) -> Column:
    return F.length(strip(text)) > 0


def words(text: Column) -> Column:
    bare = strip(text)
    return F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """As size(words(text)), without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0))


def word_id(word: Column, vocab_size: int) -> Column:
    return (3 + F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % vocab_size).cast("int")


def token_ids(text: Column, vocab_size: int = 50_254) -> Column:
    """White space tokens as ids from 3 on, 0 to 2 being pad, bos and eos."""
    return F.transform(words(text), lambda w: word_id(w, vocab_size))


def add_eos(ids: Column, eos: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos)))


def ensure_eos(ids: Column, eos: int) -> Column:
    """An EOS at the end unless there is one; an empty sequence becomes [eos]."""
    return F.when(F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False)), ids).otherwise(add_eos(ids, eos))


def tokenizer_udf(make: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """A column function for any tokenizer; ``make`` builds its batch encoder once in each worker."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            yield pd.Series(run(texts.fillna("").tolist()))

    return encode


def vocabulary(texts: DataFrame, column: str, vocab_size: int = 50_254) -> DataFrame:
    """(id, word) of all words; of several words with one id, the least."""
    each = texts.select(F.explode(words(F.col(column))).alias("word"))
    return each.groupBy(word_id(F.col("word"), vocab_size).alias("id")).agg(F.min("word").alias("word"))


def decode(sequences: DataFrame, vocab: DataFrame, *, key: str = "idx", ids: str = "ids") -> DataFrame:
    """(key, text): ids as words in order; ids without a word are left out, and a row without any word gives ''."""
    each = sequences.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    found = each.join(vocab, "id", "left").where("word IS NOT NULL OR pos IS NULL OR pos = 0")
    return found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda x: x["word"]), " ").alias("text"))
