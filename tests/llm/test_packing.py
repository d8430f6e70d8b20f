from __future__ import annotations

import random
from collections import Counter, defaultdict

from batchloom.llm import packing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, documents, empty, prose


def brute(pieces, capacity):
    bins, out = [], []
    for n, source, cluster in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and source not in b[1] and (cluster is None or cluster not in b[2])]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append([capacity, set(), set()])
        bins[at][0] -= n
        bins[at][1].add(source)
        bins[at][2].add(cluster)
        out.append(at)
    return out, [b[0] for b in bins]


piece = st.tuples(st.integers(1, 30), st.integers(0, 4), st.one_of(st.none(), st.integers(0, 3)))


@settings(max_examples=300, deadline=None)
@given(st.lists(piece, max_size=60))
def test_equals_brute_force(pieces):
    assert packing.pack(pieces, 30) == brute(pieces, 30)


def test_whole_texts_and_conflicts(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(200)]
    texts += [texts[i].upper() + " " for i in range(30)]
    sources = [f"s{min(rng.randrange(8), rng.randrange(8))}" if i % 9 else None for i in range(230)]
    docs = documents(spark, texts, sources)
    for shard_docs in (1000, 40):
        rows = packing.pack_documents(docs, capacity=128, shard_docs=shard_docs).collect()
        placed = defaultdict(list)
        total = Counter()
        for r in rows:
            total[r.doc_id] += r.n_words
            if r.n_words:
                placed[r.bin_id].append(r)
            else:
                assert r.bin_id is None and r.piece is None and r.room is None
        assert total == {i: len(t.split()) for i, t in enumerate(texts)}
        for held in placed.values():
            assert held[0].room == 128 - sum(r.n_words for r in held) >= 0
            assert len({sources[r.doc_id] for r in held}) == len(held)
            assert len({texts[r.doc_id].lower().strip() for r in held}) == len(held)


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, "last"], [None] * 13).withColumns({"shard": F.lit(1), "cluster": F.lit("c"), "n_words": F.lit("n")})
    rows = packing.pack_documents(docs, capacity=1000).collect()
    assert Counter(r.doc_id for r in rows if r.n_words) == {3: 1, 4: 1, 5: 1, 6: 1, 7: 60, 8: 1, 9: 1, 10: 1, 12: 1}
    assert packing.pack_documents(empty(spark)).count() == 0


def test_given_lengths_and_clusters(spark):
    docs = spark.createDataFrame([(1, "x", "a", 5, 1), (2, "x", "b", 5, 1), (3, "x", "c", 5, None), (None, "x", "d", None, None), (4, "x", "e", -3, 2)], "doc_id bigint, text string, source string, n int, c int")
    rows = packing.pack_documents(docs, capacity=10, length=F.col("n"), cluster=F.col("c")).collect()
    by = {r.doc_id: r.bin_id for r in rows}
    assert by[1] != by[2] and by[3] == by[1] and by[None] is None and by[4] is None


def test_repeated_rows_lie_apart(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "t")], "doc_id bigint, text string, source string")
    assert len({r.bin_id for r in packing.pack_documents(docs).collect()}) == 2


def test_documents_equal_brute_force(spark):
    """All of pack_documents in one shard: lengths, splits, order, sources and clusters, by plain Python."""
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([0, 3, 20, 40, 90, 250]), 50) for _ in range(120)] + [None, "a B", "A  b"]
    sources = [rng.choice(["x", "y", "z", None]) for _ in texts]
    docs = documents(spark, texts, sources)
    rows = [(len((t or "").split()), i, s, " ".join((t or "").lower().split())) for i, (t, s) in enumerate(zip(texts, sources)) if (t or "").split()]
    rows.sort(key=lambda r: (-r[0], r[1]))
    pieces = sorted(((min(100, n - k * 100), s, c, i, k) for n, i, s, c in rows for k in range(-(-n // 100))), key=lambda p: -p[0])
    bins, room = brute([p[:3] for p in pieces], 100)
    got = packing.pack_documents(docs, capacity=100).where("n_words > 0").collect()
    assert sorted((int(r.bin_id.split("-")[1]), r.doc_id, r.piece, r.n_words, r.room) for r in got) == sorted((b, p[3], p[4], p[0], room[b]) for b, p in zip(bins, pieces))


def test_rows_repeated_many_times_are_spread(spark):
    docs = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = packing.pack_documents(docs, shard_docs=100).collect()
    sizes = Counter(r.bin_id.split("-")[0] for r in rows)
    assert len(rows) == len({r.bin_id for r in rows}) == 3000 and len(sizes) == 30 and max(sizes.values()) < 200
