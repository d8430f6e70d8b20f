"""Sources and sinks of records: JSON lines, Parquet, shards with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.config import MODES, LoaderConfig
from batchloom.functions.text import filled
from batchloom.operators.extract import ADAPTERS, adapt, extract_pairs
from batchloom.sources import storage

#: What a mode reads: other columns are pruned from the scan.
MODE_COLUMNS = {
    "sft": ("prompt_ids", "response_ids"),
    "reward_model": ("prompt_ids", "chosen_ids", "rejected_ids"),
    "dpo": ("prompt_ids", "chosen_ids", "rejected_ids"),
    "rollout": ("prompt_ids",),
}
MODE_TEXTS = {"sft": ("prompt", "response"), "reward_model": ("prompt", "chosen", "rejected"), "dpo": ("prompt", "chosen", "rejected"), "rollout": ("prompt",)}
#: Logical names of sources: (path, adapter, split that "train" stands for).
REGISTRY: dict[str, tuple[str, str, str]] = {}


def register_source(name: str, path: str, adapter: str, train_split: str = "train") -> None:
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}")
    REGISTRY[name] = (path, adapter, train_split)


def read_jsonl(spark: SparkSession, path: str, *, mode: str = "dpo") -> DataFrame:
    """Rows with all texts that the mode needs; blank lines are skipped."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    raw = spark.read.json(path)
    lacking = [c for c in MODE_TEXTS[mode] if c not in raw.columns]
    if lacking:
        return raw.limit(0)
    out = raw
    for c in MODE_TEXTS[mode]:
        out = out.where(F.length(F.col(c)) > 0)
    return out


def read_jsonl_pairs(spark: SparkSession, path: str, prompt_column: str | None = None, response_column: str | None = None) -> DataFrame:
    """(prompt, response) of whatever rule fits; a file that has both columns filled in is taken as it is."""
    raw = spark.read.json(path)
    return extract_pairs(raw, prompt_column, response_column).select("prompt", "response")


def resolve(spark: SparkSession, source: str, split: str = "train") -> DataFrame:
    """A JSON lines file or a Parquet path where there is one, or else a registered source."""
    if source.endswith(".jsonl") or source.endswith(".json"):
        return spark.read.json(source)
    if source not in REGISTRY and ("/" in source or storage.exists(source)) and storage.exists(source):
        return spark.read.parquet(source)
    if source not in REGISTRY:
        raise ValueError(f"{source!r} is no file and no source; there are {', '.join(sorted(REGISTRY)) or 'none'}")
    path, adapter, train_split = REGISTRY[source]
    return adapt(adapter, spark.read.parquet(f"{path}/split={train_split if split == 'train' else split}"))


def union_sources(sources: dict[str, DataFrame], *, limits: dict[str, int] | None = None) -> DataFrame:
    """All sources below each other with their name in ``source``; a limit of n > 0 keeps the first n rows of a source as it is read."""
    if not sources:
        raise ValueError("no source")
    out = None
    for name, df in sources.items():
        most = (limits or {}).get(name, 0)
        mine = (df.limit(most) if most > 0 else df).withColumn("source", F.lit(name))
        out = mine if out is None else out.unionByName(mine, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str, *, limit: int = 0) -> None:
    (df.limit(limit) if limit > 0 else df).write.mode("overwrite").json(path)


def with_shard(df: DataFrame, shard_size: int, *, index: str = "idx") -> DataFrame:
    """Rows with shard = index div size; a size of 0 makes one flat shard."""
    return df.withColumn("shard", F.floor(F.col(index) / shard_size).cast("int") if shard_size > 0 else F.lit(0))


def write_shards(df: DataFrame, path: str, *, manifest: dict | None = None) -> None:
    """Rows with ``shard`` as one folder a shard, and manifest.json beside them."""
    df.repartition("shard").sortWithinPartitions("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    counts = df.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()  # one row for each shard
    body = dict(manifest or {}) | {"shards": [{"shard": r.shard, "n_samples": r.n, "dir": f"{path}/shard={r.shard}"} for r in counts]}
    storage.write(f"{path}/manifest.json", json.dumps(body).encode())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, n_samples, dir) and whatever settings there are, by shard."""
    raw = spark.read.json(path, multiLine=True)
    if "shards" not in raw.columns:
        raise ValueError(f"{path} has no shards")
    rest = [c for c in raw.columns if c != "shards"]
    return raw.select(*rest, F.explode("shards").alias("s")).select(*rest, F.col("s.shard").cast("int").alias("shard"), F.col("s.n_samples").cast("bigint").alias("n_samples"), F.col("s.dir").alias("dir")).orderBy("shard")


SETTINGS = {"max_seq_len": "max_seq_len", "pad_token_id": "pad_id", "eos_token_id": "eos_id", "vocab_size": "vocab_size", "shard_size": "shard_size"}


def manifest_settings(path: str, cfg: LoaderConfig) -> LoaderConfig:
    """``cfg`` with whatever settings the manifest of a sharded table names."""
    system, at = storage.open_system(f"{path}/manifest.json")
    with system.open_input_stream(at) as f:
        said = json.loads(f.read())
    return replace(cfg, **{ours: int(said[theirs]) for theirs, ours in SETTINGS.items() if said.get(theirs) is not None})


def load_samples(spark: SparkSession, path: str, mode: str, *, shard: int | None = None, check: bool = True) -> DataFrame:
    """The mode's columns of a sharded table; one shard is a pruned partition. Counts are held against the manifest."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    held = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    if check and storage.exists(f"{path}/manifest.json"):
        said = {r.shard: r.n_samples for r in read_manifest(spark, f"{path}/manifest.json").collect()}
        found = {r["shard"]: r["count"] for r in held.groupBy("shard").count().collect()}
        if not said:
            raise ValueError(f"{path} has no shards")
        if said != found:
            raise ValueError(f"the manifest says {said}, the shards have {found}")
    if shard is not None:
        held = held.where(F.col("shard") == shard)
    return held.select("idx", *MODE_COLUMNS[mode], "shard")


def usable(df: DataFrame, mode: str) -> DataFrame:
    out = df
    for c in MODE_TEXTS[mode]:
        out = out.where(filled(F.col(c)))
    return out


Collator = Callable[[DataFrame], DataFrame]


def build_loader(samples: DataFrame, collate: Collator) -> DataFrame:
    """Batches of planned samples by any collator; hand over by toLocalIterator(prefetchPartitions=True)."""
    return collate(samples)
