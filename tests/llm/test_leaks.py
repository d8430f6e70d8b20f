from __future__ import annotations

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from batchloom.llm import leaks
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, empty


def semi_global(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def mutate(rng: random.Random, text: str, n: int) -> str:
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:at] + (rng.choice("qxz") if kind else "") + text[at + (kind != 1) :]
    return text


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    items = [sentence(rng, n) for n in (12, 20, 40, 60, 25)]
    texts = []
    for i in range(24):
        body = sentence(rng, rng.randrange(0, 40))
        if i % 2:
            body += " " + mutate(rng, rng.choice(items), rng.randrange(0, 40)).upper() + "\n" + sentence(rng, 5)
        texts.append(body)
    return items, texts


def test_equals_brute_force(spark, cases):
    items, texts = cases
    known = leaks.segments(list(enumerate(items)), q=leaks.Q, segment=leaks.SEGMENT, rate=leaks.RATE)
    expected = set()
    for d, t in enumerate(texts):
        low = leaks.fold(np.frombuffer(t.encode(), np.uint8)).tobytes()
        for s in range(len(known.item)):
            if semi_global(known.text[s, : known.size[s]].tobytes(), low) <= known.edits[s]:
                expected.add((d, int(known.item[s])))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = documents(spark, texts)
    got = leaks.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert 0 < len(expected) < 24
    assert {r.doc_id for r in leaks.drop_leaks(docs, benchmark).collect()} == set(range(24)) - {d for d, _ in expected}
    parts = leaks.find_leaks(docs, benchmark, part_bytes=12_000)
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in got}


def test_edited_passages_are_found(spark):
    rng = random.Random(3)
    items = [sentence(rng, 40) for _ in range(20)]
    texts = []
    for i in range(60):
        words = items[i % 20].split()
        for at in rng.sample(range(len(words)), 2):
            words[at] = "other"
        texts.append(f"{sentence(rng, 20)} {' '.join(words)}\n{sentence(rng, 10)}")
    clean = [sentence(rng, 70) for _ in range(60)]
    got = leaks.find_leaks(documents(spark, texts + clean), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} <= {(i, i % 20) for i in range(60)}
    assert len(got) >= 57 and not {r.doc_id for r in got} & set(range(60, 120))


def test_alignment_within_the_band():
    rng = random.Random(2)
    for _ in range(50):
        pattern = sentence(rng, 12).encode()
        text = mutate(rng, pattern.decode(), 4).encode()
        k = 5
        region = (b"\xff" * k + text).ljust(len(pattern) + 4 * k, b"\xff")[: len(pattern) + 4 * k]
        got = leaks.align(np.frombuffer(pattern, np.uint8)[None], np.array([len(pattern)]), np.frombuffer(region, np.uint8)[None])[0]
        assert got == semi_global(pattern, region)


def test_a_band_over_two_rows(spark):
    rng = random.Random(4)
    item = sentence(rng, 30)
    texts = [sentence(rng, 3), item, item, sentence(rng, 1), item]
    got = leaks.find_leaks(documents(spark, texts).coalesce(1), spark.createDataFrame([(9, item)], "item_id bigint, text string"))
    assert {(r.doc_id, r.edits) for r in got.collect()} == {(1, 0), (2, 0), (4, 0)}


def test_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "without an id but long enough to match"), (4, "same words here and there again")], "item_id bigint, text string")
    docs = documents(spark, [*AWKWARD, "we said: SAME words\there and there again!", "we said: same words here and there again!"]).withColumns({"item_id": F.lit(1), "edits": F.lit("x")})
    n = len(AWKWARD)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, benchmark).collect()} == {(n, 4), (n + 1, 4)}
    kept = leaks.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(n))
    assert leaks.find_leaks(empty(spark), benchmark).count() == 0
    assert leaks.find_leaks(docs, empty(spark, "item_id bigint, text string")).count() == 0
    assert leaks.drop_leaks(docs, empty(spark, "item_id bigint, text string")).count() == n + 2


def test_repeated_rows_and_missing_ids(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, item), (1, item), (None, item)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert [r.doc_id for r in leaks.find_leaks(docs, benchmark).collect()] == [1, 1]
    assert leaks.drop_leaks(docs, benchmark).count() == 0


@pytest.mark.parametrize("n", [100, 120, 240])
def test_verbatim_parts_at_every_offset(n):
    rng = random.Random(n)
    item = sentence(rng, n)[:n].strip().ljust(n, "x")
    known = leaks.segments([(7, item)], q=leaks.Q, segment=leaks.SEGMENT, rate=leaks.RATE)
    for size in (80, 90, 100):
        texts = [f"{'?' * (i % 7)} {item[i : i + size]} {'!' * 100}" for i in range(n - size + 1)]
        row, seg, start, end, edits = leaks.search(pa.record_batch({"text": texts}), known)
        assert set(row.tolist()) == set(range(len(texts)))
        exact = edits == 0
        assert {(int(r), int(s)) for r, s in zip(row[exact], seg[exact], strict=True)} >= {(i, i) for i in range(len(texts))}
        assert all(texts[r][a:b] in item for r, a, b in zip(row[exact], start[exact], end[exact], strict=True))


def test_edited_parts_at_every_offset(spark):
    rng = random.Random(8)
    item = sentence(rng, 40)[:200]
    cuts = [item[i : i + 80] for i in range(0, 121, 5)]
    texts = ["?" * 90 + "".join("~" if j in (9, 25, 40, 55, 70) else c for j, c in enumerate(t)) + "?" * 90 for t in cuts]
    got = leaks.find_leaks(documents(spark, texts), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert all(r.edits <= 6 for r in got)


def test_items_shorter_than_a_gram(spark):
    benchmark = spark.createDataFrame([(1, "Short"), (2, "q: 7?"), (3, "é")], "item_id bigint, text string")
    texts = ["a short one", "shorter", "not\tSHORT", "so: q: 7? yes", "é", "cafés", "short", ""]
    got = leaks.find_leaks(documents(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.start_byte, r.end_byte, r.edits) for r in got} == {(0, 1, 2, 7, 0), (2, 1, 4, 9, 0), (3, 2, 4, 9, 0), (4, 3, 0, 2, 0), (6, 1, 0, 5, 0)}


def test_parts_stay_below_their_bound():
    rng = random.Random(5)
    items = [(i // 2, sentence(rng, rng.choice([3, 16, 20, 300])).encode()) for i in range(400)]
    parts = list(leaks.parts_of(iter(items), segment=leaks.SEGMENT, part_bytes=200_000))
    assert len(parts) > 3 and [x for p in parts for x in p] == items
    for part in parts:
        assert len(pickle.dumps(leaks.segments(part, q=leaks.Q, segment=leaks.SEGMENT, rate=leaks.RATE))) <= 200_000
    ends = [(p[0][0], p[-1][0]) for p in parts]
    assert all(a[1] != b[0] for a, b in zip(ends, ends[1:]))  # an item's rows lie in one part
    long = list(leaks.parts_of(iter([(1, b"ab " * 1_000_000), (2, b"x")]), segment=leaks.SEGMENT, part_bytes=40 << 20))
    assert [len(p) for p in long] == [1, 1, 2]


def test_many_parts_and_passes_give_the_same(spark, cases, monkeypatch):
    items, texts = cases
    benchmark = spark.createDataFrame([*enumerate(items), (9, "tiny")], "item_id bigint, text string")
    docs = documents(spark, [*texts, "tiny"])
    got = {tuple(r) for r in leaks.find_leaks(docs, benchmark).collect()}
    clean = {r.doc_id for r in leaks.drop_leaks(docs, benchmark).collect()}
    for parts in (64, 2):
        monkeypatch.setattr(leaks, "PASS_PARTS", parts)
        assert {tuple(r) for r in leaks.find_leaks(docs, benchmark, part_bytes=9000).collect()} == got
        assert {r.doc_id for r in leaks.drop_leaks(docs, benchmark, part_bytes=9000).collect()} == clean


def test_long_texts_are_searched_in_pieces():
    rng = random.Random(13)
    item = sentence(rng, 30)
    known = leaks.segments([(7, item), (8, "tiny")], q=leaks.Q, segment=leaks.SEGMENT, rate=leaks.RATE)
    for lead in range(380, 420, 3):
        text = sentence(rng, 400)[:lead] + " " + item + " " + sentence(rng, 200) + " tiny untiny"
        batch = pa.record_batch({"text": ["a", text, None, "b tiny"]})
        one = leaks._by_item(batch.append_column("doc_id", pa.array([0, 1, 2, 3])), known, *leaks.search(batch, known))
        several = leaks._by_item(batch.append_column("doc_id", pa.array([0, 1, 2, 3])), known, *leaks.search(batch, known, most=200))
        assert one.to_pylist() == several.to_pylist() and one.num_rows == 3
