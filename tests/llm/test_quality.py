from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from batchloom.llm import quality, textarrays
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, empty, prose


def corpus(n: int):
    rng = random.Random(4)
    texts, good = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(10, 120), 2000)
        kind = i % 5
        if kind == 0:
            text = " ".join(w + rng.choice(["%%%", "###", "$$$"]) for w in text.split())
        elif kind == 1:
            text = " ".join([text.split()[0].title()] * 60)
        texts.append(text)
        good.append(int(kind > 1))
    return texts, good


def test_held_out_accuracy(spark):
    texts, good = corpus(500)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(good) if i % 3], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.accepted for r in quality.score(docs, model).collect()}
    held = range(0, 500, 3)
    assert np.mean([got[i] == bool(good[i]) for i in held]) > 0.97
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i in got if got[i]}
    small = quality.train(docs, labels, per_class=20)
    assert small.n_positive <= 20 and small.n_negative <= 20


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [rng.choice(40, rng.integers(1, 10), replace=False) for _ in range(60)]
    labels = np.where(rng.random(60) < 0.5, 1, -1)
    ratios = np.zeros(quality.FEATURES)
    ratios[:40] = rng.normal(size=40)
    w, bias = quality._descend(rows, labels, ratios, 1.0, 3000)
    dense = np.zeros((60, 41))
    for i, x in enumerate(rows):
        dense[i, x] = ratios[x] / np.sqrt((ratios[x] ** 2).sum())
        dense[i, 40] = 1
    share = np.where(labels > 0, 60 / (2 * (labels > 0).sum()), 60 / (2 * (labels < 0).sum()))

    def loss(v):
        return 0.5 * v @ v + (share * np.maximum(0, 1 - labels * (dense @ v)) ** 2).sum()

    best = np.append(w[:40], bias)
    base = loss(best)
    for _ in range(300):
        assert loss(best + rng.normal(size=41) * 0.02) >= base - 1e-6


def test_fit_holds_its_values_once():
    rng = np.random.default_rng(3)
    rows = [rng.choice(quality.FEATURES, 2000, replace=False) for _ in range(2000)]
    tracemalloc.start()
    quality.fit(rows, np.where(np.arange(2000) % 2, 1, -1), epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 2000 * 2000 * 8 + 4 * quality.FEATURES * 8


def test_ratios_are_those_of_the_counts():
    rows = [np.array([1, 2]), np.array([1]), np.array([2, 3])]
    model = quality.fit(rows, np.array([1, 1, -1]))
    assert np.isclose(model.ratios[1], np.log(3 / 4) - np.log(1 / 3))
    assert quality.fit(rows, np.array([1, 1, 1])) is None


def test_features_are_distinct_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["abc abc", None, "", "x" * 3_000_000])], ["text"])
    got = dict(quality.features(batch))
    assert len(got) == 4 and not len(got[1]) and not len(got[2])
    assert all(len(set(x.tolist())) == len(x) for x in got.values())


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD).withColumns({"margin": F.lit("m"), "accepted": F.lit(5), "row": F.lit(6)})
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 9), (7, 1), (7, 0), (8, 1), (6, 1), (10, 0)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert model.n_positive == 2 and model.n_negative == 2
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 12 and not any(got[i].accepted for i in (0, 1, 2, 11)) and got[0].margin is None
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got.values())
    none = quality.train(docs, empty(spark, "doc_id bigint, quality int"))
    assert none is None
    assert {r.doc_id for r in quality.keep_good(docs, none).collect()} == {3, 4, 5, 6, 7, 8, 9, 10}
    assert quality.keep_good(empty(spark), none).count() == 0 and quality.train(empty(spark), labels) is None
    twice = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c")], "doc_id bigint, text string")
    assert quality.score(twice, model).count() == 3


def plain_hash(word: bytes) -> int:
    total = sum((b + 1) * pow(textarrays.WORD_BASE, i, 2**64) for i, b in enumerate(word)) + len(word)
    return plain_mix(total % 2**64)


def plain_mix(x: int) -> int:
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain_features(text: str) -> set:
    raw = text.encode()
    out = {raw[i] * 256 + raw[i + 1] for i in range(len(raw) - 1)}
    out |= {(((raw[i] * 256 + raw[i + 1]) * 256 + raw[i + 2]) * 0x9E3779B1 >> 13 & 0xFFFF) + 0x10000 for i in range(len(raw) - 2)}
    ws = [w for w in re.split(b"[ \t\n\v\f\r]+", raw) if w]
    shapes = []
    for k, w in enumerate(ws):
        upper = sum(65 <= b <= 90 for b in w)
        lower = sum(97 <= b <= 122 or b >= 128 for b in w)
        digit = sum(48 <= b <= 57 for b in w)
        size = sum(len(w) >= n for n in (2, 4, 7, 11, 16, 30))
        shapes.append((k > 0 and ws[k - 1] == w) * 128 + (65 <= w[0] <= 90) * 64 + (upper > 1 and not lower) * 32 + min(3, len(w) - upper - lower - digit) * 8 + size)
    out |= {a * 256 + b + 0x20000 for a, b in zip(shapes, shapes[1:])}
    out |= {(((a * 256 + b) * 256 + c) * 0x85EBCA6B >> 11 & 0xFFFF) + 0x30000 for a, b, c in zip(shapes, shapes[1:], shapes[2:])}
    hashes = [plain_hash(w) for w in ws]
    out |= {(h >> 47) + 0x40000 for h in hashes}
    return out | {(plain_mix((a * 3 + b) % 2**64) >> 47) + 0x60000 for a, b in zip(hashes, hashes[1:])}


TEXTS = ["", "a", "One TWO two 3.5 %%% two two", "é日本 x\ty\n\nz", "AB CD AB " * 20, "w" * 40 + " tail"]


def test_features_and_margins_equal_plain_ones():
    batch = pa.record_batch({"text": [*TEXTS, None]})
    got = dict(quality.features(batch))
    for i, t in enumerate([*TEXTS, ""]):
        assert set(got[i].tolist()) == plain_features(t), t
    rng = np.random.default_rng(3)
    model = quality.QualityModel(rng.normal(size=quality.FEATURES), rng.normal(size=quality.FEATURES), 0.25, 1, 1)
    for margin, t in zip(quality.margins(model, batch), [*TEXTS, ""]):
        mine = sorted(plain_features(t))
        norm = sum(model.ratios[x] ** 2 for x in mine) ** 0.5
        assert np.isclose(margin, sum(model.weights[x] * model.ratios[x] for x in mine) / max(norm, 1e-6) + 0.25)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "Bc", "DEF", "1,2", "é" * 9, "\n"]) for _ in range(500))
    monkeypatch.setattr(quality, "SLICE_BYTES", 60)
    got = dict(quality.features(pa.record_batch({"text": ["x y", text, None, "z"]})))
    assert sorted(got) == [0, 1, 2, 3] and set(got[1].tolist()) == plain_features(text) and len(got[1]) == len(plain_features(text))


def test_repeated_rows_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(1, "good text")] * 3000 + [(1, "other")] * 10 + [(2, "bad"), (3, "worse")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels, per_class=1).collect()
    assert len(rows) == 2 and {(r.doc_id, r.text) for r in rows} >= {(1, "good text")}
