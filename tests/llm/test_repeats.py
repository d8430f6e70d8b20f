from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from batchloom.llm import repeats, textarrays
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, empty, prose


def brute(texts: dict, width: int) -> set:
    places = defaultdict(list)
    for d, t in sorted(texts.items()):
        w = [x for x in re.split("[ \t\n\v\f\r]+", t or "") if x]
        for p in range(len(w) - width + 1):
            places[tuple(w[p : p + width])].append((d, p))
    marked = {}
    for found in places.values():
        if len(found) > 1:
            least = min(found)
            marked |= {x: x == least for x in found}
    out = set()
    for first in (True, False):
        for d, p in marked:
            if marked[d, p] is first and marked.get((d, p - 1)) is not first:
                q = p
                while marked.get((d, q + 1)) is first:
                    q += 1
                out.add((d, p, q + width, q - p + 1, first))
    return out


def found(df) -> set:
    rows = df.collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (60, 80, 20)]
    texts = [prose(rng, rng.randrange(0, 150)) for _ in range(40)]
    for i in range(25):
        at = rng.randrange(40)
        texts[at] = f"{texts[at]} {rng.choice(passages)}  {prose(rng, 5)}"
    return texts + [texts[3], texts[3]]


@pytest.mark.parametrize("method", ["sketch", "radix"])
@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 2000, "shard_cells": 500}])
def test_equals_brute_force(spark, corpus, method, sizes):
    docs = documents(spark, corpus)
    assert found(repeats.repeated_spans(docs, width=30, method=method, **sizes)) == brute(dict(enumerate(corpus)), 30)


def test_an_overloaded_sketch_loses_nothing(spark, corpus):
    got = repeats.repeated_spans(documents(spark, corpus), width=20, depth=1, load=1, shard_cells=50)
    assert found(got) == brute(dict(enumerate(corpus)), 20)


@pytest.mark.parametrize("method", ["sketch", "radix"])
def test_awkward_texts(spark, method):
    docs = documents(spark, AWKWARD).withColumns({"chunk": F.lit(1), "shard": F.lit("x"), "cells": F.lit(None).cast("string")})
    assert found(repeats.repeated_spans(docs, width=3, method=method)) == brute(dict(enumerate(AWKWARD)), 3)
    assert found(repeats.repeated_spans(empty(spark), method=method)) == set()


def test_rows_without_id_and_repeated_ids(spark):
    text = "a b c d e"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text)], "doc_id bigint, text string")
    got = repeats.repeated_spans(docs, width=5)
    assert {(r.doc_id, r.is_first) for r in got.collect()} == {(7, True)}


def test_sizes_grow_with_the_root_of_the_corpus():
    small, large = (repeats.Layout(n * 6, n, 2, 4, repeats.CHUNK_BYTES, repeats.SHARD_CELLS, 64) for n in (10**8, 25 * 10**12))
    assert small.chunk_bytes == repeats.CHUNK_BYTES < large.chunk_bytes <= 64 * repeats.CHUNK_BYTES
    assert 25 * 10**12 * 2 / (large.chunks * large.shards * 2) > 100  # cells a blob


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        repeats.repeated_spans(empty(spark), method="other")


def test_cut_keeps_first_occurrences_and_other_columns(spark):
    rng = random.Random(1)
    passage, left, right = prose(rng, 60), prose(rng, 10), prose(rng, 10)
    texts = [f"{left}\n{passage} {right}", f"new  {passage}\tend", passage, "short", None, ""]
    docs = documents(spark, texts).withColumns({"row": F.lit("r"), "cut_from": F.lit(1), "is_first": F.lit(True)})
    out = repeats.cut_repeats(docs, repeats.repeated_spans(docs))
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == texts[0]
    assert got[1].text == "new  end" and got[1].n_chars == len("new  end")
    assert 2 not in got
    assert got[3].text == "short" and got[4].text is None and got[5].text == ""
    assert repeats.cut_repeats(empty(spark), repeats.repeated_spans(empty(spark))).count() == 0


@given(st.lists(st.integers(0, 2**27), max_size=300), st.integers(1, 2**27))
def test_codes_round_trip(cells, top):
    cells = np.sort(np.array(cells, np.int64) % top)
    assert (repeats.decode(repeats.encode(cells)) == cells).all()


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=200), st.integers(0, 60))
def test_radix_sorts(keys, shift):
    a, b = np.array(keys, np.uint64).reshape(-1, 2).T >> np.uint64(shift)
    order = repeats._radix(a, b)
    assert list(zip(a[order], b[order])) == sorted(zip(a, b))


@pytest.mark.parametrize("radix", [True, False])
def test_keys_that_agree_in_one_code_stay_apart(radix):
    """Forced collisions: of either code alone."""
    entries = [(5, 1), (5, 2), (6, 1), (5, 1), (7, 7)]
    rows = {"first": [], "second": [], "ids": [], "owners": [], "places": [], "twice": []}
    for chunk, (a, b) in enumerate(entries):
        for name, value in (("first", np.array([a], np.uint64).tobytes()), ("second", np.array([b], np.uint64).tobytes()), ("ids", np.array([10 - chunk]).tobytes()), ("owners", repeats.planes(np.array([0]))), ("places", repeats.planes(np.array([3]))), ("twice", np.packbits([chunk == 4]).tobytes())):
            rows[name].append(value)
    said = list(repeats._exact(pa.table(rows), radix))
    assert [again[0] >> 7 for again, _ in said] == [1, 0, 0, 1, 1]
    assert [leads[0] >> 7 for _, leads in said] == [0, 1, 1, 1, 1]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_planes_round_trip(x):
    assert repeats.unplaned(repeats.planes(np.array(x, np.int64))).tolist() == x


def test_digits_are_of_words():
    words = [f"w{i}" for i in range(60)]
    other = [*words[:12], "z", *words[13:]]

    def codes(ws, upto):
        hashes, begin, *_ = next(repeats._windows([pa.record_batch({"text": [" ".join(ws)]})], 50))
        return repeats.Digits(50, (10, 25)).codes(hashes, begin, upto)

    assert codes(words, 1)[0] == codes(other, 1)[0] and codes(words, 1)[3] != codes(other, 1)[3]
    assert codes(words, 2)[0] != codes(other, 2)[0]
    first, second = repeats.Digits(50, (10, 25)).key(*next(repeats._windows([pa.record_batch({"text": [" ".join(words)]})], 50))[:2])
    changed = repeats.Digits(50, (10, 25)).key(*next(repeats._windows([pa.record_batch({"text": [" ".join([*words[:40], "z", *words[41:]])]})], 50))[:2])
    assert first[0] == changed[0][0] and second[0] != changed[1][0]


@pytest.mark.parametrize("method", ["sketch", "radix"])
def test_one_passage_in_every_document(spark, method):
    """A hot window costs its shard a row a chunk, however often it occurs."""
    rng = random.Random(2)
    passage = prose(rng, 55)
    texts = [f"{prose(rng, 5)} {passage} {prose(rng, 3)} {passage}" for _ in range(300)]
    docs = documents(spark, texts)
    assert found(repeats.repeated_spans(docs, method=method, chunk_bytes=20_000, shard_cells=4000)) == brute(dict(enumerate(texts)), 50)
    batch = pa.record_batch({"doc_id": list(range(300)), "text": texts})
    digits, layout = repeats.Digits(50), repeats.Layout(10**6, 10**5, 1, 4, 1 << 20, 1 << 20, 64)
    back = [(s, repeats.encode(np.unique(repeats.decode(b)))) for s, b in repeats._first_cells([batch], digits, layout)]
    sent = [r for r in repeats._chunk_found([batch], back, digits, layout) if r[0] >= 0]
    passages = [repeats.unplaned(r[5]) for r in sent]
    assert sum(map(len, passages)) == len({tuple(t.split()[p : p + 50]) for t in texts for p in range(len(t.split()) - 49)})


@pytest.mark.parametrize("method", ["sketch", "radix"])
def test_long_texts_in_pieces(spark, method):
    rng = random.Random(6)
    long = prose(rng, 700_000, 10**9)
    texts = [long, " ".join(long.split()[300_000:300_200]), "x" * 6_000_000 + " " + prose(rng, 60), prose(rng, 60)]
    texts.append(texts[2])
    got = found(repeats.repeated_spans(documents(spark, texts), method=method))
    assert got == {(0, 300_000, 300_200, 151, True), (1, 0, 200, 151, False), (2, 0, 61, 12, True), (4, 0, 61, 12, False)}


@given(st.lists(st.sampled_from(["a", "bb", " ", "\n", "cccccccc "]), max_size=80), st.integers(0, 4), st.integers(1, 20))
def test_pieces_hold_every_run_of_words_once(parts, overlap, most):
    text = "".join(parts)
    batch = pa.record_batch({"text": [None, text, "one two"]})
    seen = []
    for data, off, row, base in textarrays.pieces(batch, overlap, most=most):
        starts, ends, word_off = textarrays.words(data, off)
        begin, owner = textarrays.window_starts(word_off, overlap + 1)
        for b, o in zip(begin.tolist(), owner.tolist()):
            seen.append((o + row, b - int(word_off[o]) + base, tuple(data[starts[k] : ends[k]].tobytes().decode() for k in range(b, b + overlap + 1))))
    expected = []
    for r, t in enumerate(["", text, "one two"]):
        w = t.split()
        expected += [(r, i, tuple(w[i : i + overlap + 1])) for i in range(len(w) - overlap)]
    assert seen == expected
