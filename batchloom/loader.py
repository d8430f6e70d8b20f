"""Data loaders of the four training modes, as DataFrames of batches.

A loader has one row a batch: ``step`` and a matrix for each tensor, and yields
them in order to the training process. It takes samples (idx and the mode's id columns).
Plans are made on idx and lengths; ids are joined to them at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.config import MODES, LoaderConfig
from batchloom.operators import collate, truncate
from batchloom.plans import batches
from batchloom.plans.settle import cut

TENSORS = {
    "sft": ["input_ids", "attention_mask", "labels"],
    "reward_model": ["chosen_input_ids", "chosen_mask", "rejected_input_ids", "rejected_mask"],
    "dpo": ["chosen_input_ids", "chosen_mask", "chosen_labels", "rejected_input_ids", "rejected_mask", "rejected_labels"],
    "rollout": ["ids", "mask"],
}


def sample_length(mode: str, cfg: LoaderConfig) -> Column:
    """The length by which a mode's samples are bucketed."""
    n = {c: F.size(f"{c}_ids") for c in ("prompt", "response", "chosen", "rejected")}
    if mode == "sft":
        return batches.pair_length(n["prompt"], n["response"], cfg.max_seq_len)
    if mode == "rollout":
        return batches.rollout_length(n["prompt"], cfg.max_prompt_len)
    return batches.preference_length(n["prompt"], n["chosen"], n["rejected"], cfg.max_seq_len)


def items(samples: DataFrame, mode: str, cfg: LoaderConfig) -> DataFrame:
    """Samples cut as the mode wants."""
    p = F.col("prompt_ids")
    if mode == "sft":
        a, b = truncate.response_first(p, F.col("response_ids"), cfg.max_seq_len, cfg.eos_id)
        return samples.select("idx", a.alias("prompt_ids"), b.alias("response_ids"))
    if mode == "rollout":
        ids, mask = truncate.rollout_prompt(p, cfg.max_prompt_len, cfg.max_gen_len, cfg.pad_id)
        return samples.select("idx", ids.alias("ids"), mask.alias("mask"))
    a, c, j = truncate.preference(p, F.col("chosen_ids"), F.col("rejected_ids"), cfg.max_seq_len, cfg.eos_id)
    return samples.select("idx", a.alias("prompt_ids"), c.alias("chosen_ids"), j.alias("rejected_ids"))


ORDERS = ("bucketed", "sharded", "windowed")


def plan(samples: DataFrame, mode: str, cfg: LoaderConfig, *, rank: int = 0, epoch: int | None = None, pad: str = "first", order: str = "bucketed") -> DataFrame:
    """(idx, bucket, batch, slot, step) of a rank; every sample of its share is in one batch.

    ``order`` bucketed takes batches of like lengths in a seeded order; sharded takes shards in a seeded order and their
    samples together, so that a shard is read once; windowed mixes the samples of ``cfg.window_size`` shards at a time. The latter
    read ``shard`` where samples have it, or take runs of ``cfg.shard_size``; their bucket is 0 or the window.
    The epoch is that of ``cfg`` unless one is given.
    """
    epoch = cfg.epoch if epoch is None else epoch
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if not 0 <= rank < cfg.world_size:
        raise ValueError(f"rank {rank} of {cfg.world_size}")
    shard = F.col("shard") if "shard" in samples.columns else F.floor(F.col("idx") / max(cfg.shard_size, 1)).cast("int")
    keyed = cut(samples.select("idx", sample_length(mode, cfg).alias("len"), shard.alias("shard")))  # ranks read it several times
    ranked = batches.rank_shards(keyed, "idx", cfg.world_size, seed=cfg.seed, epoch=epoch, shuffle=cfg.shuffle, pad=pad).where(F.col("rank") == rank)
    if order != "bucketed":
        return _by_shard(ranked.select("pos", "idx", "shard"), cfg, epoch, order)
    bucketed = ranked.select("pos", "idx", batches.bucket(F.col("len"), cfg.boundaries, overflow=True).alias("bucket"))
    placed = batches.bucket_batches(bucketed, "pos", cfg.batch_size, by=["bucket"], seed=cfg.seed, epoch=epoch, shuffle=cfg.shuffle)
    steps = batches.batch_order(placed, ["bucket", "batch"], seed=cfg.seed, epoch=epoch)
    return placed.join(steps, ["bucket", "batch"]).select("idx", "bucket", "batch", "slot", "step")


def _by_shard(ranked: DataFrame, cfg: LoaderConfig, epoch: int, order: str) -> DataFrame:
    """(idx, bucket, batch, slot, step) of a rank's samples, shard by shard or window by window; steps follow the shards."""
    args = {"seed": cfg.seed, "epoch": epoch, "shuffle": cfg.shuffle}
    if order == "sharded":
        placed = batches.shard_aware_batches(ranked.withColumnRenamed("pos", "place"), "place", cfg.batch_size, **args)
        return placed.select("idx", F.lit(0).alias("bucket"), "batch", (F.col("pos") % cfg.batch_size).cast("int").alias("slot"), F.col("batch").cast("bigint").alias("step"))
    placed = batches.window_batches(ranked, "pos", cfg.batch_size, cfg.window_size, **args).select("idx", F.col("window").alias("bucket"), "batch", "slot")
    each = placed.groupBy("bucket").agg((F.max("batch") + 1).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each window
    starts = each.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "bucket").select("idx", "bucket", "batch", "slot", (F.col("start") + F.col("batch")).cast("bigint").alias("step"))


def build_dataloader(samples: DataFrame, cfg: LoaderConfig, mode: str = "sft", *, rank: int = 0, epoch: int | None = None, order: str = "bucketed", collator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(step, tensors) of a rank's epoch. ``collator`` takes the planned, cut samples and replaces the mode's own."""
    held = plan(samples, mode, cfg, rank=rank, epoch=epoch, order=order).join(items(samples, mode, cfg), "idx")
    if collator is not None:
        return collator(held)
    if mode == "sft":
        held = collate.collate_pairs(held, ["step"], pad=cfg.pad_id)
    elif mode != "rollout":
        held = collate.collate_preference(held, ["step"], pad=cfg.pad_id, labels=mode == "dpo")
    return collate.stack(held, ["step"], TENSORS[mode])


def build_sft_dataloader(samples: DataFrame, cfg: LoaderConfig, *, rank: int = 0, epoch: int | None = None, order: str = "bucketed") -> DataFrame:
    return build_dataloader(samples, cfg, "sft", rank=rank, epoch=epoch, order=order)


def build_reward_model_dataloader(samples: DataFrame, cfg: LoaderConfig, *, rank: int = 0, epoch: int | None = None, order: str = "bucketed") -> DataFrame:
    return build_dataloader(samples, cfg, "reward_model", rank=rank, epoch=epoch, order=order)


def build_dpo_dataloader(samples: DataFrame, cfg: LoaderConfig, *, rank: int = 0, epoch: int | None = None, order: str = "bucketed") -> DataFrame:
    return build_dataloader(samples, cfg, "dpo", rank=rank, epoch=epoch, order=order)


def build_rollout_dataloader(samples: DataFrame, cfg: LoaderConfig, *, rank: int = 0, epoch: int | None = None, order: str = "bucketed") -> DataFrame:
    return build_dataloader(samples, cfg, "rollout", rank=rank, epoch=epoch, order=order)


def with_epoch(cfg: LoaderConfig, epoch: int) -> LoaderConfig:
    """``cfg`` for an epoch: its loaders shuffle anew."""
    return replace(cfg, epoch=epoch)


def iterate(loader: DataFrame) -> Iterator[Row]:
    """Batches in order, the next partition fetched while one is used; the driver holds two partitions at most."""
    yield from loader.orderBy("step").toLocalIterator(prefetchPartitions=True)
