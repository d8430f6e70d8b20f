from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from batchloom.operators import collate, lengths, metrics
from batchloom.plans import batches, ranks
from pyspark.sql import functions as F


def md5(seed, *keys):
    return hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 3])
def test_global_rank(spark, digits):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"))
    got = ranks.global_rank(df, ranks.order_key(7, 1, F.col("k")), ["k"], by=["g"], digits=digits).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append(r)
    for rows in groups.values():
        order = sorted(rows, key=lambda r: (md5(8, r.k), r.k))
        assert [r.pos for r in order] == list(range(len(rows)))
    assert len(got) == 500


def test_ties_and_repeated_rows_have_ranks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(r.pos for r in ranks.global_rank(df, F.md5(F.lit("x").cast("binary")), ["k"]).collect()) == [0, 1, 2]
    assert ranks.global_rank(df.limit(0), ranks.order_key(1, 0, F.col("k")), ["k"]).count() == 0


def test_dense_index(spark):
    keys = [-5000, -1, 0, 3, 4095, 4096, 10**12]
    got = ranks.dense_index(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k").collect()
    assert {r.k: r.idx for r in got} == {k: i for i, k in enumerate(keys)}


@pytest.mark.parametrize(("n", "world", "pad", "expected"), [(10, 4, "cyclic", [9, 0, 1]), (10, 4, "first", [9, 0, 0]), (2, 5, "cyclic", [0]), (2, 5, "first", [0])])
def test_rank_shards(spark, n, world, pad, expected):
    got = batches.rank_shards(spark.range(n).withColumnRenamed("id", "k"), "k", world, shuffle=False, pad=pad).orderBy("pos").collect()
    assert [r.k for r in got if r.rank == world - 1] == expected
    if n == 2:
        assert [r.k for r in got] == ([0, 1, 0, 1, 0] if pad == "cyclic" else [0, 1, 0, 0, 0])
    assert len({r.rank for r in got}) == world and len(set(Counter(r.rank for r in got).values())) == 1


def test_rank_shards_of_nothing(spark):
    assert batches.rank_shards(spark.range(0).withColumnRenamed("id", "k"), "k", 4).count() == 0
    with pytest.raises(ValueError):
        batches.rank_shards(spark.range(1), "id", 2, pad="last")


def test_buckets(spark):
    df = spark.createDataFrame([(0,), (64,), (65,), (3000,)], "n int")
    bounds = (64, 128, 2048)
    assert [r.b for r in df.select(batches.bucket(F.col("n"), bounds).alias("b")).collect()] == [0, 0, 1, 2]
    assert [r.b for r in df.select(batches.bucket(F.col("n"), bounds, overflow=True).alias("b")).collect()] == [0, 0, 1, 3]
    assert [r.b for r in df.select(batches.bucket_label(F.col("n"), bounds).alias("b")).collect()] == ["<=64", "<=64", "<=128", ">2048"]


def test_every_row_in_one_batch(spark):
    df = spark.range(203).select(F.col("id").alias("k"), (F.col("id") % 3).alias("bucket"))
    plan = lambda **kw: {r.k: (r.bucket, r.batch, r.slot) for r in batches.bucket_batches(df, "k", 8, by=["bucket"], **kw).collect()}
    first = plan()
    assert len(first) == 203 and first == plan() and first != plan(epoch=1) and first != plan(seed=1)
    sizes = Counter((b, c) for b, c, _ in first.values())
    assert max(sizes.values()) == 8 and all(n == 8 or c == max(x for y, x in sizes if y == b) for (b, c), n in sizes.items())
    ordered = plan(shuffle=False)
    assert [k for k in range(0, 203, 3)] == sorted((k for k in ordered if ordered[k][0] == 0), key=lambda k: ordered[k][1:])


def shards(spark, sizes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))], "idx bigint, shard int")


def test_shard_aware_batches(spark):
    got = batches.shard_aware_batches(shards(spark, [5, 9, 3]), "idx", 4).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(17)) and [r.batch for r in got] == [i // 4 for i in range(17)]
    order = [r.shard for r in got]
    assert sum(a != b for a, b in zip(order, order[1:])) == 2
    hits = metrics.cache_hits(batches.shard_aware_batches(shards(spark, [5, 9, 3]), "idx", 4), slices=4).first()
    assert (hits.hits, hits.misses) == (14, 3)


def test_window_batches(spark):
    got = batches.window_batches(shards(spark, [5, 9, 3, 4]), "idx", 4, 3, shuffle=False).collect()
    by = defaultdict(list)
    for r in got:
        by[r.window, r.batch].append(r)
    assert {k: len(v) for k, v in by.items()} == {(0, 0): 4, (0, 1): 4, (0, 2): 4, (0, 3): 4, (0, 4): 1, (1, 0): 4}
    assert [r.shard for r in sorted(by[0, 0], key=lambda r: r.slot)] == [0, 1, 2, 0]


def test_locate(spark):
    offsets = batches.shard_offsets(batches.shard_sizes(shards(spark, [5, 9, 3])))
    asked = spark.createDataFrame([(0,), (4,), (5,), (16,), (17,), (-1,)], "idx bigint")
    got = [(r.idx, r.shard, r.place) for r in batches.locate(asked, offsets).collect()]
    assert sorted(got) == [(0, 0, 0), (4, 0, 4), (5, 1, 0), (16, 2, 2)]
    assert batches.locate(asked, offsets.limit(0)).count() == 0


def test_zip_wants_equal_counts(spark):
    a = spark.range(3).withColumnRenamed("id", "seq_idx")
    assert batches.zip_sequences(a, a.withColumn("x", F.lit(1))).count() == 3
    with pytest.raises(ValueError):
        batches.zip_sequences(a, a.limit(2))


def test_collation(spark):
    df = spark.createDataFrame([(0, 0, [5, 6], [7, 2]), (0, 1, [8], [2])], "batch int, slot int, prompt_ids array<int>, response_ids array<int>")
    got = collate.collate_pairs(df, ["batch"]).orderBy("slot").collect()
    assert [r.input_ids for r in got] == [[5, 6, 7, 2], [8, 2, 0, 0]]
    assert [r.attention_mask for r in got] == [[1, 1, 1, 1], [1, 1, 0, 0]]
    assert [r.labels for r in got] == [[-100, -100, 7, 2], [-100, 2, -100, -100]]
    wide = collate.stack(collate.collate_pairs(df, ["batch"]), ["batch"], ["input_ids", "labels"]).first()
    assert wide.input_ids == [[5, 6, 7, 2], [8, 2, 0, 0]] and wide.labels[1] == [-100, 2, -100, -100]
    trimmed = collate.collate_trimmed(df, ["batch"], 2).orderBy("slot").collect()
    assert [r.input_ids for r in trimmed] == [[5, 6], [8, 2]] and trimmed[0].labels == [-100, -100]


def test_preference_sides_pad_apart(spark):
    df = spark.createDataFrame([(0, [1], [2, 3], [4]), (0, [1, 1], [2], [4, 5, 6])], "batch int, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    got = collate.collate_preference(df, ["batch"], labels=True).collect()
    assert {(len(r.chosen_input_ids), len(r.rejected_input_ids), len(r.chosen_labels)) for r in got} == {(3, 5, 3)}


def test_metrics(spark):
    samples = spark.createDataFrame([(0, 0, 4), (0, 1, 2)], "batch int, slot int, len int")
    table = metrics.batch_table(samples, ["batch"], "len")
    cost = metrics.proxy_cost(table, alpha=1, beta=0.5).first()
    assert cost.proxy == 8.5 and cost.padding_pct == 25.0
    summary = metrics.epoch_summary(table.withColumn("step", F.lit(0))).first()
    assert summary.std_len == 0 and summary.token_slots == 8 and summary.mean_padding == 0.25
    ties = spark.createDataFrame([(0, 4, 3, 4, 0.25), (1, 4, 3, 8, 0.25)], "step int, n int, real int, L int, padding double")
    both = metrics.epoch_summary(ties).first()
    assert both.worst_step == both.best_step == 0 and both.std_len == 2.0
    rows = {r.label: (r.batches, r.samples) for r in metrics.bucket_breakdown(ties, (4, 16)).collect()}
    assert rows == {"<=4": (1, 4), "<=16": (1, 4), ">16": (0, 0)}


def test_percentiles_and_histogram(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "len int")
    row = lengths.length_stats(df, ["len"], (50, 99)).first()
    assert (row.p50, row.p99, row.n, row.mean_len) == (6, 10, 10, 5.5)
    assert lengths.length_stats(df.limit(0), ["len"]).count() == 0
    got = {r.label: r.n for r in lengths.length_histogram(df.unionAll(spark.sql("SELECT 0")), F.col("len"), (4, 8)).collect()}
    assert got == {"<=4": 4, "<=8": 4, ">8": 2}
    assert lengths.long_ratio(df, F.col("len"), 8).first().strategy == "COMPRESS"
    assert lengths.long_ratio(df, F.col("len"), 9).first().strategy == "TRUNCATE"
    assert lengths.long_ratio(df, F.col("len"), 9, force="COMPRESS").first().strategy == "COMPRESS"
    assert lengths.long_ratio(df.limit(0), F.col("len"), 9).first().ratio == 0


@pytest.mark.parametrize("keys", [[0, 1, 2], [10**15 * (i * 37 % 101 - 50) for i in range(101)], [i * i for i in range(300)], []])
def test_ordered_rank_of_any_keys(spark, keys):
    df = spark.createDataFrame([(k, k % 3 if k % 5 else None) for k in keys], "k bigint, g bigint").repartition(7)
    assert [r.k for r in ranks.dense_index(df, "k").orderBy("idx").collect()] == sorted(keys)
    by = ranks.ordered_rank(df, "k", by=["g"], name="pos").collect()
    for g in {r.g for r in by}:
        mine = sorted((r.pos, r.k) for r in by if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(r.k for r in by if r.g == g)


def test_slices_are_even(spark):
    """Rows of a slice: by hash of 1e5 rows, and by range of keys of which none has a leading hex digit."""
    df = spark.range(100_000).select((F.col("id") * 3).alias("k"))
    hashed = df.select(F.substring(ranks.order_key(1, 0, F.col("k")), 1, 4).alias("s")).groupBy("s").count()
    assert hashed.agg(F.max("count")).first()[0] < 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = df.repartitionByRange("k").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 40_000
    placed = batches.bucket_batches(df.withColumn("bucket", F.lit(0)), "k", 10, by=["bucket"], shuffle=False)
    assert placed.where("batch * 10 + slot <> k / 3").count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 5])
@pytest.mark.parametrize("slices", [3, 50, 4096])
def test_cache_of_the_shards_read_last(spark, capacity, slices):
    rng = random.Random(capacity)
    reads = [rng.randrange(8) for _ in range(200)]
    cache, hits = [], 0
    for s in reads:
        hits += s in cache
        cache = [x for x in cache if x != s] + [s]
        cache = cache[-capacity:]
    placed = spark.createDataFrame(list(enumerate(reads)), "pos bigint, shard int")
    row = metrics.cache_hits(placed, capacity=capacity, slices=slices).first()
    assert (row.hits, row.misses, row.hit_rate) == (hits, 200 - hits, pytest.approx(hits / 2))
    assert tuple(metrics.cache_hits(placed.limit(0)).first()) == (0, 0, None)
