from __future__ import annotations

from collections import Counter

import pytest
from batchloom import loader
from batchloom.config import LoaderConfig
from batchloom.operators import metrics
from pyspark.sql import functions as F

CFG = LoaderConfig(max_seq_len=16, max_prompt_len=6, max_gen_len=3, batch_size=4, boundaries=(4, 8, 16), world_size=3)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, [100 + i] * (i % 7), [200 + i] * (i % 11) + [2], [300 + i] * (i % 5) + [2], [400 + i] * (i % 9) + [2]) for i in range(50)]
    return spark.createDataFrame(rows, "idx bigint, prompt_ids array<int>, response_ids array<int>, chosen_ids array<int>, rejected_ids array<int>").cache()


@pytest.mark.parametrize("mode", list(loader.TENSORS))
def test_ranks_share_the_samples(samples, mode):
    seen = Counter()
    for rank in range(3):
        planned = loader.plan(samples, mode, CFG, rank=rank).collect()
        seen.update(r.idx for r in planned)
        assert len(planned) == 17
        sizes = Counter(r.step for r in planned)
        assert sorted(sizes) == list(range(len(sizes))) and max(sizes.values()) <= 4
    assert set(seen) == set(range(50)) and sum(seen.values()) == 51


@pytest.mark.parametrize("mode", list(loader.TENSORS))
def test_batches(samples, mode):
    steps = 0
    for batch in loader.iterate(loader.build_dataloader(samples, CFG, mode, rank=1)):
        assert batch.step == steps
        steps += 1
        for name in loader.TENSORS[mode]:
            assert len({len(row) for row in batch[name]}) == 1
        if mode == "sft":
            for ids, mask, labels in zip(batch.input_ids, batch.attention_mask, batch.labels):
                assert len(ids) <= 16 and [i for i, m in zip(ids, mask) if not m] == [0] * (len(ids) - sum(mask))
                assert all(y in (-100, i) for y, i in zip(labels, ids)) and any(y != -100 for y in labels)
        if mode == "rollout":
            assert {len(row) for row in batch.ids} == {9}
    assert steps


def test_epochs_differ_and_repeat(samples):
    order = lambda epoch: [(r.idx, r.step) for r in loader.plan(samples, "sft", CFG, epoch=epoch).orderBy("step", "slot").collect()]
    assert order(0) == order(0) != order(1)
    assert loader.with_epoch(CFG, 3).epoch == 3


def test_any_collator_and_wrong_settings(samples):
    count = loader.build_dataloader(samples, CFG, "sft", collator=lambda df: df.groupBy("step").agg(F.count("*").alias("n")))
    assert sum(r.n for r in count.collect()) == 17
    with pytest.raises(ValueError):
        loader.plan(samples, "other", CFG)
    with pytest.raises(ValueError):
        loader.plan(samples, "sft", CFG, rank=3)
    assert loader.build_dataloader(samples.limit(0), CFG, "dpo").count() == 0


def test_factories(samples):
    made = (loader.build_sft_dataloader, loader.build_reward_model_dataloader, loader.build_dpo_dataloader, loader.build_rollout_dataloader)
    for build, mode in zip(made, loader.TENSORS):
        assert build(samples, CFG).columns == ["step", *loader.TENSORS[mode]]


def test_throughput(spark):
    table = spark.createDataFrame([(4, 10), (4, 6)], "n int, real int")
    rows = metrics.throughput(table, {"read": 1.0, "collate": 3.0}).collect()
    assert {(r.phase, r.share_pct, r.samples_per_sec, r.tokens_per_sec) for r in rows} == {("read", 25.0, 2.0, 4.0), ("collate", 75.0, 2.0, 4.0)}


def made(spark, n=50):
    return spark.range(n).select(F.col("id").alias("idx"), F.array_repeat(F.lit(7), (F.col("id") % 9 + 1).cast("int")).alias("prompt_ids"), F.array(F.lit(5), F.lit(2)).alias("response_ids"))


def test_epochs_differ_and_repeat(spark):
    cfg = LoaderConfig(batch_size=4)
    plans = [[tuple(r) for r in loader.plan(made(spark), "sft", loader.with_epoch(cfg, e)).orderBy("step", "slot").collect()] for e in (0, 1, 1)]
    assert plans[0] != plans[1] == plans[2]
    assert [tuple(r) for r in loader.plan(made(spark), "sft", cfg, epoch=1).orderBy("step", "slot").collect()] == plans[1]


@pytest.mark.parametrize("order", ["sharded", "windowed"])
@pytest.mark.parametrize("rank", [0, 1])
def test_shard_orders(spark, order, rank):
    cfg = LoaderConfig(batch_size=4, shard_size=8, window_size=2, world_size=2)
    rows = loader.plan(made(spark), "sft", cfg, rank=rank, order=order).orderBy("step", "slot").collect()
    assert len(rows) == 25 and [r.step for r in rows] == sorted(r.step for r in rows) and {r.step for r in rows} == set(range(max(r.step for r in rows) + 1))
    shards = [r.idx // 8 for r in rows]
    width = 1 if order == "sharded" else 2
    runs = [s for i, s in enumerate(shards) if s not in shards[:i]]
    for i in range(0, len(runs), width):  # a group of shards is read in one go
        at = [k for k, s in enumerate(shards) if s in runs[i : i + width]]
        assert at == list(range(at[0], at[-1] + 1))
    found = loader.build_sft_dataloader(made(spark), cfg, rank=rank, order=order).orderBy("step").collect()
    assert sum(len(b.input_ids) for b in found) == 25
    with pytest.raises(ValueError):
        loader.plan(made(spark), "sft", cfg, order="other")
