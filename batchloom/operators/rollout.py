"""Rollout buffers: append, seal, normalise, minibatches, group baselines and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.plans.ranks import global_rank, order_key
from batchloom.plans.settle import cut


def normalise_advantages(df: DataFrame, column: str = "advantages") -> DataFrame:
    """(a - mean) / (std + 1e-8) over all elements of all rows, by the sample deviation; one element alone gives 0."""
    total = df.select(F.explode(column).alias("a")).agg(F.avg("a").alias("adv_mean"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("adv_std"))
    joined = df.join(F.broadcast(total))  # one row
    return joined.withColumn(column, F.transform(column, lambda a: (a - F.col("adv_mean")) / (F.col("adv_std") + 1e-8))).drop("adv_mean", "adv_std")


def group_baseline(df: DataFrame, group: str, reward: str) -> DataFrame:
    """``df`` with advantage: the reward less its group's mean."""
    return df.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(group)))


def minibatches(df: DataFrame, key: str, size: int, *, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Rows with minibatch and slot in the epoch's permutation; the remainder is kept."""
    placed = global_rank(df, order_key(seed, epoch, F.col(key)), [key], name="place")
    return placed.withColumn("minibatch", F.floor(F.col("place") / size).cast("int")).withColumn("slot", (F.col("place") % size).cast("int")).drop("place")


class RolloutBuffer:
    """Append until sealed, then read minibatches by epoch; sealing writes the rows once, and each epoch its plan."""

    def __init__(self, key: str = "row_id", minibatch_size: int = 8, normalize_adv: bool = True):
        self.key, self.minibatch_size, self.normalize_adv = key, minibatch_size, normalize_adv
        self.clear()

    def clear(self) -> None:
        self.rows: DataFrame | None = None
        self.is_sealed, self.total_samples, self.epoch, self.cursor = False, 0, 0, 0
        self._plan: DataFrame | None = None

    def push(self, rows: DataFrame) -> None:
        if self.is_sealed:
            raise RuntimeError("the buffer is sealed")
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)

    def seal(self) -> None:
        total = self.rows.count() if self.rows is not None else 0
        if not total:
            raise RuntimeError("the buffer is empty")
        if self.normalize_adv:
            self.rows = normalise_advantages(self.rows)
        self.rows = cut(self.rows)
        self.is_sealed, self.total_samples = True, total

    def num_minibatches(self) -> int:
        return -(-self.total_samples // self.minibatch_size) if self.is_sealed else 0

    def planned(self) -> DataFrame:
        if not self.is_sealed:
            raise RuntimeError("the buffer isn't sealed")
        if self._plan is None:  # written by minibatch, so that each reads its own rows
            self._plan = cut(minibatches(self.rows, self.key, self.minibatch_size, epoch=self.epoch).repartitionByRange("minibatch").sortWithinPartitions("minibatch", "slot"))
        return self._plan

    def next_minibatch(self) -> DataFrame | None:
        if self.cursor >= self.num_minibatches():
            return None
        self.cursor += 1
        return self.planned().where(F.col("minibatch") == self.cursor - 1)

    def rest(self) -> DataFrame:
        """All minibatches that the pass has left, in order, as one scan: a union of single ones costs the driver a scan each."""
        begin, self.cursor = self.cursor, self.num_minibatches()
        return self.planned().where(F.col("minibatch") >= begin).orderBy("minibatch", "slot")

    def reset_cursor(self) -> None:
        """A new permutation for the next pass."""
        self.epoch, self.cursor, self._plan = self.epoch + 1, 0, None


def reward_model_loss(chosen: Column, rejected: Column) -> Column:
    """-log sigmoid(chosen - rejected), without overflow."""
    gap = chosen - rejected
    return F.greatest(-gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)


def preference_loss(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid of beta times the gap between log ratios; arguments are arrays of log probabilities."""
    ratio = lambda a, b: array_sum(a) - array_sum(b)
    return reward_model_loss(beta * ratio(policy_chosen, ref_chosen), beta * ratio(policy_rejected, ref_rejected))
