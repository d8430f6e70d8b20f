"""Streams of several sources, merged and shuffled.

A failing source fails the query. Each micro-batch is written in a seeded order
of its rows, so nothing is lost or repeated, and memory is bounded by the micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from batchloom.plans.ranks import order_key


def stream_sources(spark: SparkSession, paths: dict[str, str], schema: StructType, *, kind: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """One stream of all folders, each row with its ``source``."""
    out = None
    for name, path in paths.items():
        mine = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path).withColumn("source", F.lit(name))
        out = mine if out is None else out.unionByName(mine)
    if out is None:
        raise ValueError("no source")
    return out


def shuffle_rows(df: DataFrame, key: str, *, seed: int = 42, epoch: int = 0) -> DataFrame:
    return df.orderBy(order_key(seed, epoch, F.col(key)), key)


def write_shuffled(stream: DataFrame, key: str, path: str, checkpoint: str, *, seed: int = 42, shuffle: bool = True) -> StreamingQuery:
    """Everything available, in shuffled micro-batches; each is a folder of its own, so a repeated one replaces itself.

    ``shuffle`` is off for a single source in its own order.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = shuffle_rows(batch, key, seed=seed, epoch=number) if shuffle else batch
        rows.write.mode("overwrite").parquet(f"{path}/micro_batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
