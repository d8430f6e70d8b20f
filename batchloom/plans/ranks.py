"""Seeded orders and exact ranks that need no single partition.

An order is that of md5(seed + epoch : key), ties by key: the same for the same
seed and epoch, another in the next epoch. As the sort key is uniform, its
leading hex digits cut it into even slices; a row's rank is its place in its
slice plus the sizes of the slices before. Orders that aren't even are cut into slices by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.plans.settle import cut


def order_key(seed: int, epoch: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), *[k.cast("string") for k in keys]).cast("binary"))


def global_rank(df: DataFrame, order: Column, ties: list[str], *, by: list[str] | None = None, name: str = "pos", digits: int = 4) -> DataFrame:
    """``df`` with the place of each row, from 0, in its group's order; ``order`` is hex text that is evenly spread.

    16 ** digits slices a group, so that 1e12 rows make slices of 15 million; the running sums over them are the only
    part that isn't spread by slice.
    """
    by = by or []
    # one key for group and slice, so that the rows stay where the window put them when they meet the sums; nulls in a struct are equal
    cell = F.struct(F.substring("rank_order", 1, digits).alias("slice"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)])
    held = df.withColumn("rank_order", order).withColumn("rank_cell", cell)
    local = Window.partitionBy("rank_cell").orderBy("rank_order", *ties)
    sizes = held.groupBy("rank_cell", F.substring("rank_order", 1, digits).alias("rank_slice"), *by).agg(F.count("*").alias("cell_size"))
    before = Window.partitionBy(*by).orderBy("rank_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("rank_cell").alias("start_cell"), F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_start"))
    placed = held.withColumn("cell_place", F.row_number().over(local) - 1).join(starts, F.col("rank_cell") == F.col("start_cell"))
    return placed.withColumn(name, (F.col("cell_start") + F.col("cell_place")).cast("bigint")).drop("rank_order", "rank_cell", "cell_place", "cell_start", "start_cell")


def ordered_rank(df: DataFrame, key: str, *, by: list[str] | None = None, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row, from 0, in its group's order of ``key``, whatever its values are.

    Rows are written once, parted by ranges of the key: a slice is a partition as it was written, so that
    sparse, clustered and negative keys make slices as even as dense ones.
    """
    by = by or []
    held = cut(df.repartitionByRange(*by, key).withColumn("rank_slice", F.spark_partition_id()))
    local = Window.partitionBy("rank_slice", *by).orderBy(key)
    sizes = held.groupBy(*by, "rank_slice").agg(F.count("*").alias("slice_rows"))
    before = Window.partitionBy(*by).orderBy("rank_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice and group
    cell = lambda: F.struct("rank_slice", *by)  # noqa: E731  nulls in a struct are equal
    starts = sizes.select(cell().alias("start_cell"), F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("slice_start"))
    placed = held.withColumn("slice_place", F.row_number().over(local) - 1).withColumn("rank_cell", cell()).join(starts, F.col("rank_cell") == F.col("start_cell"))
    return placed.withColumn(name, (F.col("slice_start") + F.col("slice_place")).cast("bigint")).drop("rank_slice", "rank_cell", "start_cell", "slice_start", "slice_place")


def dense_index(df: DataFrame, key: str, *, name: str = "idx") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of a key."""
    return ordered_rank(df, key, name=name)
