from __future__ import annotations

import random

import numpy as np
import pytest
from batchloom.llm import tokens
from batchloom.llm.queries import vocabulary
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, empty

VOCABULARY = vocabulary()


def brute(text: str, spans: list, rule: str):
    """Tokens of each span, crossing tokens, and tokens in none, a byte at a time."""
    made, size = tokens.encoder(VOCABULARY)
    ids = tokens.encode(text, VOCABULARY)
    edge = np.concatenate([[0], np.cumsum(size[ids])])
    raw = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    counts, crossing, none = [0.0] * len(raw), [0] * len(raw), 0
    for a, b in zip(edge[:-1], edge[1:]):
        held = {k: min(b, e) - max(a, s) for k, (s, e) in enumerate(raw) if min(b, e) > max(a, s)}
        if not held:
            none += 1
            continue
        if rule == "split":
            share = {k: v / sum(held.values()) for k, v in held.items()}
        elif rule == "first":
            share = {min(held): 1.0}
        else:
            share = {max(held, key=lambda k: (held[k], -k)): 1.0}
        for k, v in share.items():
            counts[k] += v
            crossing[k] += held[k] < b - a
    return counts, crossing, none


@pytest.mark.parametrize("rule", tokens.RULES)
def test_equals_brute_force(spark, rule):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the ", "naïve", "日本", " 12", "\n", "\n\n", "  ", "x", "é", "'s ", "\t"]) for _ in range(rng.randrange(0, 80))) for _ in range(25)]
    spans = []
    for t in texts:
        cuts = sorted(rng.randrange(len(t) + 1) for _ in range(rng.randrange(0, 9)))
        spans.append([(a, b) for a, b in zip(cuts, cuts[1:])])
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, spans))], "doc_id bigint, text string, parts array<struct<start:int,end:int>>")
    got = tokens.section_tokens(docs, vocabulary=VOCABULARY, rule=rule, sections="parts").collect()
    by = {(r.doc_id, r.section): r for r in got}
    assert len(by) == len(got)
    for i, t in enumerate(texts):
        counts, crossing, none = brute(t, spans[i], rule)
        for k in range(len(spans[i])):
            assert by[i, k].n_tokens == pytest.approx(counts[k]) and by[i, k].n_crossing == crossing[k]
            assert (by[i, k].start_char, by[i, k].end_char) == spans[i][k]
        assert (by[i, -1].n_tokens if (i, -1) in by else 0) == none
        total = sum(r.n_tokens for r in got if r.doc_id == i)
        assert total == pytest.approx(len(tokens.encode(t, VOCABULARY)))


def test_lines_are_the_default_sections(spark):
    got = tokens.section_tokens(documents(spark, ["ab cd\n\nef\n"]), vocabulary=VOCABULARY).collect()
    assert [(r.section, r.start_char, r.end_char) for r in sorted(got, key=lambda r: r.section)] == [(-1, -1, -1), (0, 0, 5), (1, 7, 9)]


def test_tokens_are_those_of_the_plain_encoder():
    made, _ = tokens.encoder(VOCABULARY)
    for text in ["", " ", "a b\n c", "x" + " " * 1500 + "y", "x" + "\n" * 1200, "\t" * 1100 + " z", "a  " + " " * 1001 + "b"]:
        assert tokens.encode(text, VOCABULARY).tolist() == made.encode_ordinary(text)
    assert len(tokens.encode(" " * 2_000_000 + "q", VOCABULARY)) > 0


def test_awkward_texts(spark):
    docs = documents(spark, [*AWKWARD, " " * 300_000]).withColumns({"section": F.lit(1), "n_tokens": F.lit("x")})
    got = tokens.section_tokens(docs, vocabulary=VOCABULARY).collect()
    assert {r.doc_id for r in got} == set(range(13))
    for i, t in enumerate([*AWKWARD, " " * 300_000]):
        assert sum(r.n_tokens for r in got if r.doc_id == i) == len(tokens.encode(t or "", VOCABULARY))
    assert {(r.section, r.n_tokens) for r in got if r.doc_id in (0, 1)} == {(-1, 0.0)}
    assert tokens.section_tokens(empty(spark), vocabulary=VOCABULARY).count() == 0


def test_null_sections_and_unknown_rules(spark):
    docs = spark.createDataFrame([(1, "a b c", [None, (None, 3), (0, 99), (-5, 1)]), (None, "a", None), (1, "a b c", [None, (None, 3), (0, 99), (-5, 1)])], "doc_id bigint, text string, s array<struct<start:int,end:int>>")
    got = tokens.section_tokens(docs, vocabulary=VOCABULARY, sections="s").collect()
    assert sorted((r.section, r.start_char, r.end_char) for r in got if r.doc_id == 1) == [(2, 0, 5), (2, 0, 5), (3, 0, 1), (3, 0, 1)]
    assert [(r.section, r.n_tokens) for r in got if r.doc_id is None] == [(-1, 1.0)]
    with pytest.raises(ValueError):
        tokens.section_tokens(docs, vocabulary=VOCABULARY, rule="other")
