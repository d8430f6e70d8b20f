from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from batchloom.llm import neardups, textarrays
from batchloom.plans import settle
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, edited, empty, prose


def bag(text) -> Counter:
    w = (text or "").split()
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def weighted(a: Counter, b: Counter) -> float:
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def brute_groups(texts: list, threshold: float) -> dict:
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [bag(t) for t in texts]
    pairs = set()
    for i in range(len(texts)):
        for j in range(i):
            if weighted(bags[i], bags[j]) >= threshold:
                pairs.add((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}, pairs


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(5, 200)) for _ in range(60)]
    for i in range(20):
        for _ in range(rng.randrange(1, 5)):
            n = len(texts[i].split())
            texts.append(edited(rng, texts[i], rng.randrange(0, max(1, n // 12))))
    return texts


def test_groups_equal_brute_force(spark, corpus):
    expected, pairs = brute_groups(corpus, neardups.THRESHOLD)
    got = {r.doc_id: r for r in neardups.near_groups(documents(spark, corpus)).collect()}
    together = sum(a in got and b in got and got[a].group_id == got[b].group_id for a, b in pairs)
    assert len(pairs) > 40 and together >= 0.9 * len(pairs)
    for r in got.values():  # nothing is joined that brute force keeps apart
        assert expected[r.doc_id] == expected[r.group_id] and r.is_kept == (r.doc_id == r.group_id)
    assert all(sum(r.is_kept for r in got.values() if r.group_id == g) == 1 for g in {r.group_id for r in got.values()})


def test_a_chain_becomes_one_group(spark):
    rng = random.Random(3)
    texts = [prose(rng, 100)]
    for _ in range(12):
        texts.append(edited(rng, texts[-1], 6))
    got = neardups.near_groups(documents(spark, texts)).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(i, 0) for i in range(13)}


def test_large_group_of_copies(spark):
    rng = random.Random(4)
    base = prose(rng, 80)
    texts = [edited(rng, base, rng.randrange(0, 5)) for _ in range(300)] + [base] * 50
    got = neardups.near_groups(documents(spark, texts)).collect()
    assert {r.group_id for r in got} == {0} and len(got) == 350


def test_fifty_thousand_copies_are_one_class(spark):
    text = prose(random.Random(5), 40)
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).unionAll(spark.createDataFrame([(60_000, edited(random.Random(6), text, 3))], "doc_id bigint, text string"))
    groups = neardups.near_groups(docs)
    assert groups.count() == 50_001 and groups.select("group_id").distinct().count() == 1
    assert neardups.keep_one(docs, groups).count() == 1


def test_pages_of_one_template_just_below_the_threshold(spark):
    """All share a key with many classes; only those that are alike are joined, whoever is the least of the key."""
    rng = random.Random(7)
    template = prose(rng, 60)
    texts = [f"{template} {prose(rng, 40, 10**6)}" for _ in range(300)]
    texts += [edited(rng, t, 2) for t in texts[200:260]]
    expected, pairs = brute_groups(texts, neardups.THRESHOLD)
    got = {r.doc_id: r.group_id for r in neardups.near_groups(documents(spark, texts)).collect()}
    assert len(pairs) >= 60 and got == {i: g for i, g in expected.items() if list(expected.values()).count(g) > 1}


def test_blocks_and_pairs_agree(spark):
    rng = random.Random(9)
    texts = [edited(rng, prose(random.Random(1), 60), rng.randrange(4, 14)) for _ in range(90)]
    bags = neardups._bags(documents(spark, texts), spark.range(90).select(F.col("id").alias("doc_id"))).persist()
    keys = spark.range(90).select(F.lit(1).alias("key"), F.col("id").alias("doc_id"), F.col("id").alias("group"), F.lit(90 * neardups.BLOCK // 20).alias("n"))
    pairs = spark.range(90).alias("x").join(spark.range(90).alias("y"), F.expr("x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    got = {tuple(r) for r in neardups._in_blocks(keys, bags, 0.4).collect()}
    assert got == {tuple(r) for r in neardups.verified(bags, pairs, 0.4).collect()} == {(j, i) for j, i in brute_groups(texts, 0.4)[1]}
    assert 0 < len(got) < 90 * 89 / 2


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 30) for _ in range(3000))
    whole = neardups.multisets(pa.array([text]))
    monkeypatch.setattr(neardups, "SLICE_BYTES", 500)
    monkeypatch.setattr(neardups, "ELEMENTS", 700)
    monkeypatch.setattr(neardups, "pieces", lambda batch, overlap: textarrays.pieces(batch, overlap, most=500))
    _, row, element, count = next(neardups.bagged(pa.record_batch({"text": [text]})))
    assert (element == whole[1]).all() and (count == whole[2]).all() and not row.any()
    blocks = neardups.signatures(row, element, count, 1, 64)
    monkeypatch.setattr(neardups, "ELEMENTS", 10**9)
    assert (blocks == neardups.signatures(row, element, count, 1, 64)).all()
    for t, n in (("x" * 5000, 1), ("x" * 5000 + " y", 1), (" " * 5000, 0)):
        assert len(next(neardups.bagged(pa.record_batch({"text": [t]})))[2]) == n


def test_rows_of_one_id_tie_their_texts_together(spark):
    a, b, c = (prose(random.Random(i), 30) for i in range(3))
    docs = spark.createDataFrame([(4, a), (4, b), (2, a), (9, b), (5, c)], "doc_id bigint, text string")
    assert {(r.doc_id, r.group_id) for r in neardups.near_groups(docs).collect()} == {(2, 2), (4, 2), (9, 2)}


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(9)
    errors = []
    for _ in range(30):
        a = Counter({f"w{k}": rng.randrange(1, 40) for k in range(rng.randrange(1, 60))})
        b = Counter({k: max(0, n + rng.randrange(-10, 10)) for k, n in a.items() if rng.random() < 0.8})
        b = +b or Counter(z=1)
        row, element, weight = [], [], []
        for i, x in enumerate((a, b)):
            for k, n in x.items():
                row.append(i)
                element.append(hash(k) & (2**63 - 1))
                weight.append(n)
        order = np.lexsort((element, row))
        s = neardups.signatures(np.array(row)[order], np.array(element, np.uint64)[order], np.array(weight)[order], 2, 2000)
        errors.append(float((s[0] == s[1]).mean()) - weighted(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.06


def test_multisets_count_pairs():
    row, element, count = neardups.multisets(pa.array(["a b a b a", None, "one", "", "a b"]))
    assert sorted(zip(row.tolist(), count.tolist())) == [(0, 2), (0, 2), (2, 1), (4, 1)]
    assert element[row == 4][0] in element[row == 0]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(5, i) for i in range(20)] + [(30, 31), (31, 30), (32, 32)]])
def test_components(spark, edges):
    got = {r.doc_id: r.group_id for r in neardups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("gather", [0, 30, neardups.GATHER])
def test_components_by_steps_and_in_one_task_agree(spark, gather):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(25)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = neardups.components(spark.createDataFrame(edges, "a bigint, b bigint"), gather=gather).collect()
    assert len(got) == len(root) and {r.doc_id: r.group_id for r in got} == root


def test_a_long_chain_costs_no_query_a_step(spark, monkeypatch):
    """The driver keeps memory for each query it has planned and compiled, so their number may not follow the shape of the groups."""
    written = []
    monkeypatch.setattr(neardups, "cut", lambda df, **how: written.append(1) or settle.cut(df, **how))
    edges = [(i, i + 1) for i in range(300)]
    got = neardups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(i, 0) for i in range(301)} and len(written) <= 3


def test_roots_equal_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 20), (50, 60), (400, 390)):
        a, b = rng.integers(0, n, (2, m))
        root = np.arange(n)
        for _ in range(n):
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
        assert (neardups.roots(n, a, b) == root).all()


def test_awkward_texts(spark):
    docs = documents(spark, AWKWARD).withColumns({"key": F.lit(1), "row": F.lit(2), "gone_id": F.lit(3), "group_id": F.lit(4)})
    groups = neardups.near_groups(docs)
    assert {(r.doc_id, r.group_id) for r in groups.collect()} == {(8, 8), (9, 8)}
    kept = neardups.keep_one(docs, groups)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(AWKWARD))) - {9}


def test_empty_table_missing_and_repeated_ids(spark):
    assert neardups.near_groups(empty(spark)).count() == 0
    text = prose(random.Random(1), 30)
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (6, text)], "doc_id bigint, text string")
    groups = neardups.near_groups(docs)
    assert {(r.doc_id, r.group_id) for r in groups.collect()} == {(4, 4), (6, 4)}
    assert sorted(str(r.doc_id) for r in neardups.keep_one(docs, groups).collect()) == ["4", "4", "None"]
