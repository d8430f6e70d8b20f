"""Padding, proxy cost, storage and cache metrics, from lengths alone.

``samples`` have the keys of their batch and their real length; ``batches`` have
one row each: n, real and L (the padded length).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.plans.batches import bucket_label


def batch_table(samples: DataFrame, by: list[str], length: str) -> DataFrame:
    """(by, n, real, L, padding, first_padding): padding of the batch, and of its sample in slot 0."""
    n, real, longest = F.count("*"), F.sum(length), F.max(length)
    out = samples.groupBy(*by).agg(n.alias("n"), real.cast("bigint").alias("real"), longest.cast("bigint").alias("L"), F.min_by(length, "slot").alias("first"))
    return out.select(*by, "n", "real", "L", (1 - F.col("real") / (F.col("n") * F.col("L"))).alias("padding"), (1 - F.col("first") / F.col("L")).alias("first_padding"))


def _std(x: Column | str) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def epoch_summary(batches: DataFrame, order: str = "step") -> DataFrame:
    """Counts, token slots, spread of L (population), and padding: mean, spread, worst and best batch, of equals the first."""
    pad, first = F.col("padding"), F.col(order)
    return batches.agg(
        F.count("*").alias("batches"),
        F.sum("n").alias("samples"),
        F.sum(F.col("n") * F.col("L")).alias("token_slots"),
        F.avg("L").alias("mean_len"),
        _std("L").alias("std_len"),
        F.min("L").alias("min_len"),
        F.max("L").alias("max_len"),
        F.avg(pad).alias("mean_padding"),
        _std(pad).alias("std_padding"),
        F.max_by(order, F.struct(pad, -first)).alias("worst_step"),
        F.max_by("L", F.struct(pad, -first)).alias("worst_len"),
        F.min_by(order, F.struct(pad, first)).alias("best_step"),
        F.min_by("L", F.struct(pad, first)).alias("best_len"),
    )


def bucket_breakdown(batches: DataFrame, boundaries: tuple[int, ...]) -> DataFrame:
    """(label, batches, samples, mean_padding) by bucket of the padded length; buckets without batches are there."""
    labels = [f"<={b}" for b in boundaries] + [f">{boundaries[-1]}"]
    mine = bucket_label(F.col("L"), boundaries)
    sums = [x for i, name in enumerate(labels) for x in (F.count_if(mine == name).alias(f"b{i}"), F.sum(F.when(mine == name, F.col("n"))).alias(f"s{i}"), F.avg(F.when(mine == name, F.col("padding"))).alias(f"p{i}"))]
    each = F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"b{i}").alias("batches"), F.coalesce(f"s{i}", F.lit(0)).alias("samples"), F.coalesce(f"p{i}", F.lit(0.0)).alias("mean_padding")) for i, name in enumerate(labels)])
    return batches.agg(*sums).select(F.explode(each).alias("x")).select("x.*")


def proxy_cost(batches: DataFrame, *, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """(batches, padded, real, padding_pct, proxy, hours): alpha * slots + beta * batches + gamma * sum of n * L * L."""
    slots = F.sum(F.col("n") * F.col("L"))
    proxy = alpha * slots + beta * F.count("*") + gamma * F.sum(F.col("n") * F.col("L") * F.col("L"))
    return batches.agg(F.count("*").alias("batches"), slots.alias("padded"), F.sum("real").alias("real"), F.coalesce(F.try_divide(100.0 * (slots - F.sum("real")), slots), F.lit(0.0)).alias("padding_pct"), proxy.alias("proxy"), (proxy / 3600.0).alias("hours"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """What plan b saves against plan a, in percent of a, and whether their real tokens agree within 2 %; rows of ``proxy_cost``."""
    joined = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns]).join(b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns]))
    saved = lambda c: 100.0 * (F.col(f"{c}_a") - F.col(f"{c}_b")) / F.col(f"{c}_a")
    drift = F.abs(saved("real"))
    return joined.select("padded_a", "padded_b", saved("padded").alias("padded_saved_pct"), saved("hours").alias("hours_saved_pct"), drift.alias("real_drift_pct"), (drift < 2).alias("comparable"))


def sample_sizes(samples: DataFrame, *, struct_bytes: int = 56) -> DataFrame:
    """``samples`` with the bytes of each on disk and in memory, from p and r."""
    n = F.col("p") + F.col("r")
    return samples.withColumns({"disk_bytes": 4 + 4 * n, "ram_bytes": 4 * n + struct_bytes})


def storage_by_shard(samples: DataFrame, *, cached_shards: int = 4) -> DataFrame:
    """(shards, disk_bytes, ram_bytes, avg_disk, avg_ram, peak_ram): totals, means by shard, and a cache of some shards."""
    each = sample_sizes(samples).groupBy("shard").agg((F.sum("disk_bytes") + 4).alias("d"), F.sum("ram_bytes").alias("m"))
    return each.agg(F.count("*").alias("shards"), F.sum("d").alias("disk_bytes"), F.sum("m").alias("ram_bytes"), F.avg("d").alias("avg_disk"), F.avg("m").alias("avg_ram"), (F.avg("m") * cached_shards).alias("peak_ram"))


def vram(batches: DataFrame) -> DataFrame:
    """(vram_bytes, avg_vram): three tensors of 64-bit integers for each batch."""
    size = 3 * F.col("n") * F.col("L") * 8
    return batches.agg(F.sum(size).alias("vram_bytes"), F.avg(size).alias("avg_vram"))


def _recent(before: list[int], shards: list[int], capacity: int) -> list[int]:
    """The shards that a cache holds after some reads, the latest last."""
    out: list[int] = []
    for s in chain(reversed(shards), reversed(before)):
        if s not in out:
            out.append(s)
            if len(out) == capacity:
                break
    return out[::-1]


def cache_hits(placed: DataFrame, *, capacity: int = 1, slices: int = 4096) -> DataFrame:
    """(hits, misses, hit_rate) of a cache of the ``capacity`` shards read last, in order of pos.

    Runs of ``slices`` positions are looked at apart: first what each leaves in the cache (a row a slice, gone
    through in order), then its reads against what the slices before have left.
    """
    held = placed.select(F.col("pos").cast("bigint").alias("pos"), F.col("shard").cast("bigint").alias("shard")).withColumn("slice", F.floor(F.col("pos") / slices))

    def leave(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        return pa.table({"slice": table.column("slice")[:1], "left": pa.array([_recent([], table.column("shard").to_pylist(), capacity)], pa.list_(pa.int64()))})

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] = []
        for batch in batches:
            found = []
            for left in batch.column("left").to_pylist():
                found.append(now)
                now = _recent(now, left, capacity)
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(found, pa.list_(pa.int64()))], ["slice", "found"])

    def count(reads: pa.Table, found: pa.Table) -> pa.Table:
        cache = dict.fromkeys(found.column("found")[0].as_py())
        hits = 0
        for s in reads.sort_by("pos").column("shard").to_pylist():
            hits += s in cache
            cache.pop(s, None)
            cache[s] = None
            if len(cache) > capacity:
                del cache[next(iter(cache))]
        return pa.table({"reads": [reads.num_rows], "hits": [hits]})

    left = held.groupBy("slice").applyInArrow(leave, "slice bigint, left array<bigint>")
    found = left.coalesce(1).sortWithinPartitions("slice").mapInArrow(carry, "slice bigint, found array<bigint>")
    each = held.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(count, "reads bigint, hits bigint")
    reads, hits = F.coalesce(F.sum("reads"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))
    return each.agg(hits.alias("hits"), (reads - hits).alias("misses"), (100.0 * hits / F.nullif(reads, F.lit(0))).alias("hit_rate"))


def sweep_choice(sweep: DataFrame, *, most_padding: float = 35.0) -> DataFrame:
    """(fewest_batches, least_padding, balanced): batch sizes by rows of (batch_size, batches, padding_pct).

    Without a clock, fewer batches for the same samples stand for higher throughput. Ties go to the smaller size.
    """
    few = F.struct("batches", "batch_size")
    return sweep.agg(F.min_by("batch_size", few).alias("fewest_batches"), F.min_by("batch_size", F.struct("padding_pct", "batch_size")).alias("least_padding"), F.min_by(F.when(F.col("padding_pct") < most_padding, F.col("batch_size")), F.when(F.col("padding_pct") < most_padding, few)).alias("balanced"))


def throughput(batches: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """(samples_per_sec, tokens_per_sec, phase, seconds, share_pct) of an epoch, from measured seconds by phase."""
    total = sum(seconds.values())
    if total <= 0:
        raise ValueError("no time was measured")
    each = F.array(*[F.struct(F.lit(k).alias("phase"), F.lit(float(v)).alias("seconds"), F.lit(100.0 * v / total).alias("share_pct")) for k, v in seconds.items()])
    row = batches.agg((F.sum("n") / total).alias("samples_per_sec"), (F.sum("real") / total).alias("tokens_per_sec"))
    return row.select("samples_per_sec", "tokens_per_sec", F.explode(each).alias("x")).select("samples_per_sec", "tokens_per_sec", "x.*")


def manifest_totals(samples: DataFrame) -> DataFrame:
    """(shards, n_samples, bytes_per_sample, avg_shard_mb)."""
    each = sample_sizes(samples).groupBy("shard").agg(F.count("*").alias("c"), (F.sum("disk_bytes") + 4).alias("d"))
    return each.agg(F.count("*").alias("shards"), F.sum("c").alias("n_samples"), (F.sum("d") / F.sum("c")).alias("bytes_per_sample"), (F.avg("d") / 1e6).alias("avg_shard_mb"))


def mixing(samples: DataFrame, length: str, *, least: float = 30.0) -> DataFrame:
    """(std_len, mixed): the sample deviation of lengths, and whether it tells a mixed corpus."""
    std = F.coalesce(F.stddev_samp(length), F.lit(0.0))
    return samples.agg(std.alias("std_len"), (std > least).alias("mixed"))
