"""The loader's planner: shards by rank, length buckets, batches and their order.

Plans hold keys and lengths only; ids are joined to them when tensors are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.plans.ranks import global_rank, order_key, ordered_rank


def pair_length(p: Column, r: Column, most: int) -> Column:
    return F.least(p + r, F.lit(most))


def preference_length(p: Column, chosen: Column, rejected: Column, most: int) -> Column:
    """min(P, M/4) and the longer side, without a cap."""
    return F.least(p, F.lit(most // 4)) + F.greatest(chosen, rejected)


def rollout_length(p: Column, max_prompt: int) -> Column:
    return F.least(p, F.lit(max_prompt))


def rank_shards(df: DataFrame, key: str, world_size: int, *, seed: int = 42, epoch: int = 0, shuffle: bool = True, pad: str = "cyclic") -> DataFrame:
    """Rows with pos and rank: a permutation, padded to a multiple of ``world_size``, in equal runs.

    ``pad`` "cyclic" repeats the order from its start, "first" its first row.
    """
    if pad not in ("cyclic", "first"):
        raise ValueError(f"pad {pad!r}")
    if shuffle:
        placed = global_rank(df, order_key(seed, epoch, F.col(key)), [key])
    else:
        placed = ordered_rank(df, key)
    # one row, so the broadcast has a fixed size
    total = df.agg(F.count("*").alias("n_rows"))
    sized = placed.join(F.broadcast(total)).withColumn("per_rank", F.ceil(F.col("n_rows") / world_size).cast("bigint"))
    last = F.col("per_rank") * world_size
    if pad == "cyclic":
        places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(world_size)), lambda k: F.col("pos") + k * F.col("n_rows")), lambda x: x < last)
    else:
        rest = F.when(last > F.col("n_rows"), F.sequence(F.col("n_rows"), last - 1)).otherwise(F.array().cast("array<bigint>"))
        places = F.when(F.col("pos") == 0, F.concat(F.array("pos"), rest)).otherwise(F.array("pos"))
    return sized.withColumn("pos", F.explode(places)).withColumn("rank", F.floor(F.col("pos") / F.col("per_rank")).cast("int")).drop("n_rows", "per_rank")


def bucket(length: Column, boundaries: tuple[int, ...], *, overflow: bool = False) -> Column:
    """Number of the first boundary that isn't less; beyond the last, that one's, or a number of its own."""
    chain = None
    for i, b in enumerate(boundaries):
        chain = F.when(length <= b, i) if chain is None else chain.when(length <= b, i)
    return chain.otherwise(len(boundaries) if overflow else len(boundaries) - 1)


def bucket_label(length: Column, boundaries: tuple[int, ...]) -> Column:
    chain = None
    for b in boundaries:
        chain = F.when(length <= b, f"<={b}") if chain is None else chain.when(length <= b, f"<={b}")
    return chain.otherwise(f">{boundaries[-1]}")


def bucket_batches(df: DataFrame, key: str, batch_size: int, *, by: list[str], seed: int = 42, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """Rows with batch and slot: each group in a seeded order, cut into runs, the remainder kept."""
    if shuffle:
        placed = global_rank(df, order_key(seed, epoch, F.col(key)), [key], by=by, name="place")
    else:
        placed = ordered_rank(df, key, by=by, name="place")
    return placed.withColumn("batch", F.floor(F.col("place") / batch_size).cast("int")).withColumn("slot", (F.col("place") % batch_size).cast("int")).drop("place")


def batch_order(batches: DataFrame, by: list[str], *, seed: int = 42, epoch: int = 0, within: list[str] | None = None) -> DataFrame:
    """One row for each batch, with step: its place in the seeded order of all batches (of a rank, with ``within``)."""
    each = batches.select(*by).distinct()
    return global_rank(each, order_key(seed, epoch, *[F.col(c) for c in by]), by, by=within, name="step")


def shard_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("shard").agg(F.count("*").alias("n_samples"))


def shard_offsets(manifest: DataFrame) -> DataFrame:
    """(shard, n_samples, begin, end): running totals over the shards, of which there are few."""
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return manifest.withColumn("end", F.sum("n_samples").over(upto)).withColumn("begin", F.col("end") - F.col("n_samples")).select("shard", "n_samples", "begin", "end")


def locate(indexes: DataFrame, offsets: DataFrame, *, index: str = "idx") -> DataFrame:
    """Rows with shard and place of a global index; rows beyond the shards are left out.

    A range lookup as an equi-join: both sides fall into bins as wide as a shard is
    on average, so a shard lies in few, and its bounds decide. The planner
    broadcasts the list of shards where it is small.
    """
    width = offsets.agg(F.greatest(F.ceil(F.avg("n_samples")), F.lit(1)).cast("bigint")).first()[0] or 1
    bins = F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))
    listed = offsets.where("end > begin").select("shard", "begin", "end", F.explode(bins).alias("shard_bin"))
    held = indexes.withColumn("index_bin", F.floor(F.col(index) / width))
    joined = held.join(listed, (F.col("index_bin") == F.col("shard_bin")) & (F.col("begin") <= F.col(index)) & (F.col(index) < F.col("end")))
    return joined.withColumn("place", F.col(index) - F.col("begin")).drop("begin", "end", "shard_bin", "index_bin")


def shard_positions(df: DataFrame, *, seed: int = 42, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """(shard, n_samples, shard_pos, shard_start) in the seeded order of shards, or in their own."""
    order = [order_key(seed, epoch, F.col("shard")), "shard"] if shuffle else ["shard"]
    sizes = shard_sizes(df)  # one row for each shard from here on
    placed = sizes.withColumn("shard_pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    before = Window.orderBy("shard_pos").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("shard_start", F.coalesce(F.sum("n_samples").over(before), F.lit(0)))


def shard_aware_batches(df: DataFrame, key: str, batch_size: int, *, seed: int = 42, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """Rows with shard_pos, pos and batch: shards in order, rows in order within, runs that may cross shards."""
    inner = [order_key(seed, epoch, F.col(key)), key] if shuffle else [key]
    local = df.withColumn("in_shard", F.row_number().over(Window.partitionBy("shard").orderBy(*inner)) - 1)
    placed = local.join(shard_positions(df, seed=seed, epoch=epoch, shuffle=shuffle).drop("n_samples"), "shard")
    return placed.withColumn("pos", F.col("shard_start") + F.col("in_shard")).withColumn("batch", F.floor(F.col("pos") / batch_size).cast("int")).drop("shard_start", "in_shard")


def window_batches(df: DataFrame, key: str, batch_size: int, window: int, *, seed: int = 42, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """Rows with window, batch and slot: windows of shards, their rows taken in turn; a window's last batch may be short."""
    inner = [order_key(seed, epoch, F.col(key)), key] if shuffle else [key]
    local = df.withColumn("in_shard", F.row_number().over(Window.partitionBy("shard").orderBy(*inner)) - 1)
    placed = local.join(shard_positions(df, seed=seed, epoch=epoch, shuffle=shuffle).drop("n_samples", "shard_start"), "shard")
    placed = placed.withColumn("window", F.floor(F.col("shard_pos") / window).cast("int"))
    turn = F.row_number().over(Window.partitionBy("window").orderBy("in_shard", "shard_pos")) - 1
    return placed.withColumn("turn", turn).withColumn("batch", F.floor(F.col("turn") / batch_size).cast("int")).withColumn("slot", (F.col("turn") % batch_size).cast("int")).drop("turn", "in_shard", "shard_pos")


def num_batches(df: DataFrame, batch_size: int, by: list[str]) -> DataFrame:
    """(by_total, exact): ceil(n / size) over all, and the sum of that over groups."""
    each = df.groupBy(*by).agg(F.count("*").alias("n"))
    return each.agg(F.ceil(F.sum("n") / batch_size).cast("bigint").alias("by_total"), F.sum(F.ceil(F.col("n") / batch_size)).cast("bigint").alias("exact"))


def group_expand(df: DataFrame, group_size: int) -> DataFrame:
    """Each row ``group_size`` times, with its copy's number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))


def zip_sequences(left: DataFrame, right: DataFrame, *, on: str = "seq_idx") -> DataFrame:
    """The one-to-one join of two files by place; an error where the counts differ."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} sequences against {b}")
    return left.join(right, on)
