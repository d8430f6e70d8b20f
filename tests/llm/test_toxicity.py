from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from batchloom.llm import toxicity
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, empty, prose

HARD = ["idiot", "scum", "moron", "worthless", "trash", "stupid"]
SLURS = ["zugbar", "zugfel", "zugmin", "zugtor", "zugwex"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    texts, toxic = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(20, 80), 500).split()
        bad = i % 6 == 0
        for w in rng.sample(HARD if i % 12 else SLURS, 3) if bad else []:
            words.insert(rng.randrange(len(words)), w.title() if rng.random() < 0.3 else f"{w},")
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy(spark, corpus):
    """Labels are given for three documents of five, toxic or not; only the others are looked at."""
    texts, toxic = corpus
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 5 < 3], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(documents(spark, texts), labels).collect()}
    held = [i for i in range(600) if i % 5 >= 3]
    assert sum(toxic[i] for i in held) == 40
    assert np.mean([got[i].toxic == bool(toxic[i]) for i in held]) > 0.98
    assert not any(got[i].toxic for i in held if not toxic[i])
    assert sum(got[i].toxic for i in held if toxic[i]) >= 38
    assert all(got[i].toxic == (got[i].score > 0.5) for i in range(600))


def plain_tokens(text):
    return [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if w]


def plain_votes(text, induced=()):
    """The rules of the voters, a word at a time."""
    words = plain_tokens(text)
    votes = [2 if any(w in terms for w in words) else 0 for terms in toxicity.LEXICONS.values()]
    known = [any(w in terms for terms in toxicity.LEXICONS.values()) for w in words]
    own = [w in induced for w in words]
    hit = [a or b for a, b in zip(known, own)]
    you = {"you", "your", "du", "vous", "tu", "usted"}
    weight = max(2 * sum(known), sum(own))
    beside = any(w in you and any(0 <= i + d < len(words) and hit[i + d] for d in (-2, -1, 1, 2)) for i, w in enumerate(words))
    return [*votes, 2 if any(own) else 0, 2 if sum(own) > 1 else 0, 2 if any(hit) and sum(hit) * 50 >= len(words) else 0, 2 if beside else 0, 0 if not words else 1 if weight < 2 else 2 if weight > 2 else 0]


def test_votes_equal_the_rules():
    rng = random.Random(4)
    vocabulary = [*HARD, *SLURS, "you", "Your", "usted", "crétin", "estúpido", "Ärger", "dummkopf", *"abcdefghijklmnop"]
    texts = [None, "", " ... ", *(rng.choice([" ", ", ", "!\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 200]))) for _ in range(400))]
    induced = np.sort(toxicity._tokens(pa.record_batch({"text": [" ".join(SLURS[:3])]}))[0])
    got = toxicity.cast_votes(pa.record_batch({"text": texts}), induced)
    assert got.tolist() == [plain_votes(t, SLURS[:3]) for t in texts]


def plain_em(patterns, counts, pairs, q, prior, rounds):
    """The same fit by dictionaries and loops, for given ties."""
    above = {b: a for a, b in pairs}
    for _ in range(rounds):
        cell = defaultdict(float)
        for p, c, x in zip(patterns, counts, q):
            for y, w in ((0, c * (1 - x)), (1, c * x)):
                for v, vote in enumerate(p):
                    cell[v, y, p[above[v]] if v in above else None, vote] += w
        share = (sum(c * x for c, x in zip(counts, q)) + 1) / (sum(counts) + 1 / prior)
        odds = []
        for p in patterns:
            total = math.log(share / (1 - share))
            for v, vote in enumerate(p):
                up = p[above[v]] if v in above else None
                for y, sign in ((1, 1), (0, -1)):
                    total += sign * math.log((cell[v, y, up, vote] + 0.5) / (sum(cell[v, y, up, k] for k in range(3)) + 1.5))
            odds.append(total)
        q = [1 / (1 + math.exp(-o)) for o in odds]
    return odds


def test_fit_equals_plain_loops():
    rng = np.random.default_rng(8)
    y = rng.random(3000) < 0.3
    votes = np.stack([np.where(rng.random(3000) < 0.3, 0, 1 + np.where(rng.random(3000) < a, y, ~y)) for a in (0.9, 0.8, 0.7)] + [np.zeros(3000, int)], axis=1)
    votes[:, 3] = np.where(rng.random(3000) < 0.9, votes[:, 1], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    pairs, q = ((1, 3),), np.where((patterns == 2).sum(axis=1) > 1, 0.9, 0.02)
    expected = plain_em(patterns.tolist(), counts.tolist(), pairs, q.tolist(), 0.2, 15)
    for _ in range(14):
        q = 1 / (1 + np.exp(-toxicity.fit_tables(patterns, counts.astype(float), q, pairs, 0.2).log_odds(patterns)))
    assert np.allclose(toxicity.fit_tables(patterns, counts.astype(float), q, pairs, 0.2).log_odds(patterns), expected)


@pytest.mark.parametrize("copies", [1, 2, 4])
def test_many_copies_of_one_voter_count_once(copies):
    rng = np.random.default_rng(6)
    y = rng.random(30_000) < 0.3
    cast = lambda a: np.where(rng.random(len(y)) < a, y, ~y)
    voters = [cast(0.85), cast(0.85), cast(0.8), cast(0.7)]
    voters += [np.where(rng.random(len(y)) < 0.97, voters[3], ~voters[3]) for _ in range(copies)]
    votes = np.stack(voters, axis=1).astype(int) + 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float), prior=0.3)
    assert len(model.pairs) == copies and {v for p in model.pairs for v in p} == set(range(3, 4 + copies))
    opinion = np.ones((2, len(voters)), int)
    opinion[1, 3:] = 2  # all of the copies against none
    step = np.diff(model.log_odds(opinion))[0]
    assert step == pytest.approx(2 * math.log(0.7 / 0.3), abs=0.6)


def test_the_sample_is_bounded_by_rows(spark, corpus):
    texts, _ = corpus
    docs = documents(spark, texts)
    docs = docs.unionAll(docs.where("doc_id < 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("n"))
    patterns = toxicity.voted(docs, np.zeros(0, np.uint64)).groupBy("votes").count().collect()
    votes = toxicity._votes(np.array([r.votes for r in patterns]))
    likely = [int(r.votes) for r, v in zip(patterns, votes) if (v == 2).any()]
    for most in (20, 100):
        got = toxicity.sample(docs, np.zeros(0, np.uint64), likely, sum(r["count"] for r in patterns if r.votes in likely), sum(r["count"] for r in patterns if r.votes not in likely), most).collect()
        assert 0 < len(got) <= most and len({r.text for r in got}) == len(got)


def test_long_texts_in_pieces():
    rng = random.Random(8)
    text = " ".join(rng.choice(["idiot,", "Wort", "é!", "x" * 50]) for _ in range(200_000))
    parts = [text, "short"]
    alone, _, n = toxicity._tokens(pa.record_batch({"text": [text]}))
    both, row, counts = toxicity._tokens(pa.record_batch({"text": parts}))
    assert (alone == both[row == 0]).all() and n[0] == counts[0]


def test_without_labels(spark, corpus):
    texts, toxic = corpus
    got = {r.doc_id: r.toxic for r in toxicity.judge(documents(spark, texts)).collect()}
    assert all(got[i] for i in range(600) if toxic[i] and i % 12) and not any(got[i] for i in range(600) if not toxic[i])


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.3
    accuracy = [0.9, 0.8, 0.7, 0.75]
    votes = [np.where(rng.random(len(y)) < a, y, ~y) for a in accuracy]
    votes.append(np.where(rng.random(len(y)) < 0.97, votes[2], ~votes[2]))  # nearly a copy of the third
    cast = np.stack(votes, axis=1).astype(int) + 1
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float), prior=0.3)
    assert model.pairs == ((2, 4),)
    for v, a in enumerate(accuracy):
        assert np.exp(model.single[v, 1, 2]) == pytest.approx(a, abs=0.04)
    assert np.mean((model.log_odds(cast) > 0) == y) > 0.9


def test_lexicon_votes():
    part = pa.RecordBatch.from_arrays([pa.array(["You IDIOT! " + "word " * 100, "idiotic idea", None, "", "hello there", "trash, scum."])], ["text"])
    votes = toxicity.cast_votes(part, np.zeros(0, np.uint64))
    at = {name: k for k, name in enumerate(toxicity.VOTERS)}
    assert votes[0, at["insults"]] == 2 and votes[0, at["addressed"]] == 2 and votes[0, at["dense"]] == 0
    assert votes[1].tolist() == votes[4].tolist() and votes[1, at["few_hits"]] == 1
    assert not votes[2].any() and not votes[3].any()
    assert votes[5, at["degrading"]] == 2 and votes[5, at["few_hits"]] == 2 and votes[5, at["dense"]] == 2


def test_induced_words_need_unlike_documents(spark):
    rng = random.Random(7)
    copy = prose(rng, 60, 10**6)
    texts = [copy] * 40 + [f"{prose(rng, 40, 300)} zzslur" for _ in range(20)] + [prose(rng, 40, 300) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, toxic int")
    docs = documents(spark, texts)
    got = toxicity.induce(docs, labels)
    hashes, _, _ = toxicity._tokens(pa.RecordBatch.from_arrays([pa.array(["zzslur"])], ["text"]))
    assert hashes[0] in got
    copied, _, _ = toxicity._tokens(pa.RecordBatch.from_arrays([pa.array([copy])], ["text"]))
    assert not np.isin(copied, got).any()


def test_only_words_of_labelled_documents_are_moved(spark, monkeypatch):
    rng = random.Random(6)
    texts = [f"{prose(rng, 30)} {'zzslur' if i % 40 == 0 else 'fine'}" for i in range(2000)]
    docs, known = documents(spark, texts), spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(0, 2000, 10)], "doc_id bigint, toxic int")
    moved = [r.doc_id for r in toxicity._words_of(docs, toxicity._marks(known)).collect()]
    assert set(moved) >= set(range(0, 2000, 10)) and len(moved) == len(set(moved)) <= 210
    expected = toxicity.induce(docs, known)
    assert len(expected)
    for marks in (1, 100):  # however many share a mark, the join decides
        monkeypatch.setattr(toxicity, "MARKS", marks)
        assert toxicity._words_of(docs, toxicity._marks(known)).count() > 1000
        assert (toxicity.induce(docs, known) == expected).all()


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, "you idiot"]).withColumns({"votes": F.lit("x"), "toxic": F.lit(1)})
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 7), (12, 1), (12, 0), (8, 0)], "doc_id bigint, toxic int")
    rows = toxicity.judge(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and not any(got[i].toxic for i in range(12))
    assert got[0].score is None and got[1].posterior is None and got[3].posterior is not None
    assert toxicity.judge(empty(spark), labels).count() == 0
    assert toxicity.judge(docs, empty(spark, "doc_id bigint, toxic int")).count() == 13
    twice = spark.createDataFrame([(1, "hi"), (1, "hi"), (None, "ho")], "doc_id bigint, text string")
    assert toxicity.judge(twice).count() == 3


def test_induced_words_of_all_labelled_documents(spark):
    n, n_clean = 6000, 18000
    own = lambda i: " ".join(f"{w}{i}" for w in "abcdefgh")
    texts = [f"{own(i)} rare{i // 4}x" for i in range(n)] + [f"{own(i)} fine" for i in range(n, n + n_clean)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < n).cast("int").alias("toxic"))
    got = toxicity.induce(docs, labels)
    hashes, row, _ = toxicity._tokens(pa.RecordBatch.from_arrays([pa.array(texts[:n])], ["text"]))
    least = np.minimum.reduceat(hashes, np.searchsorted(row, np.arange(n)))
    rare = hashes[np.searchsorted(row, np.arange(n), "right") - 1]
    expected = {int(rare[i]) for i in range(0, n, 4) if len(set(least[i : i + 4].tolist())) == 4}
    assert len(expected) > 500 and set(got.tolist()) == expected
